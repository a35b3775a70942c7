"""Where what a call writes comes from: tokens and lines by their first occurrence.

Everything is an inverted index with the earliest place of each token or line in a run, an aggregate, so that a common token is one row a run however often
it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts: paths, file names, flags and numbers (fixed values), by kind.
FACTS = {
    "path": r"(?<![\w./-])/(?:[\w.+-]+/)+[\w.+-]+", "file": r"(?<![\w./-])[\w-]+\.(?:py|json|txt|csv|toml|yaml|yml|sh|c|h|cpp|md)\b",
    "flag": r"(?<![\w-])--[a-z][\w-]+", "number": r"(?<![\w.])\d{3,}(?:\.\d+)?(?![\w.])",
}
#: Characters from which on a line counts.
MIN_LINE = 12


def facts(text: Column) -> Column:
    """Array of (token, kind), each token once, under the first kind that has it. Linear in the text."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in FACTS.values()]

    def of(kind: str, tokens: Column) -> Column:
        return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.lit(kind).alias("kind")))

    # As a variable of a lambda the arrays are made once; written out, every mention of them would run the patterns again.
    def each(kinds: Column) -> Column:
        return F.concat(*[of(kind, F.array_except(kinds.getItem(i), F.flatten(F.slice(kinds, 1, i))) if i else kinds.getItem(i)) for i, kind in enumerate(FACTS)])

    return F.flatten(F.transform(F.array(F.array(*found)), each))


def lines(text: Column) -> Column:
    """The lines of a text that say something: long enough, with a word in them, trimmed, each once."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), F.trim)
    return F.array_distinct(F.filter(trimmed, lambda x: (F.length(x) >= MIN_LINE) & x.rlike("[A-Za-z]{3}")))


def sources(calls: DataFrame, prompts: DataFrame, run: str = "run", n: str = "n", said: str = "text", shown: str = "result", record: str = "is_record") -> DataFrame:
    """(run, token, kind, n, source): the first call that uses each fact of a run, and where it has it from.

    `given`: the run's prompt has it as a fact; `record` or `own`: the first earlier call whose result has it is a look at the record, or not;
    `unsourced`: none. calls: (run, n, text, result, is_record), (run, n) unique; prompts: (run, text), one a run."""
    used = calls.select(run, n, F.explode(facts(F.col(said))).alias("f")).groupBy(run, F.col("f.token").alias("token")).agg(F.min(F.struct(F.col(n).alias("n"), F.col("f.kind").alias("kind"))).alias("u"))
    seen = calls.select(run, F.explode(facts(F.col(shown))["token"]).alias("token"), F.struct(F.col(n).alias("n"), F.coalesce(F.col(record), F.lit(False)).alias("record")).alias("at"))
    first = seen.groupBy(run, "token").agg(F.min("at").alias("s"))
    given = prompts.select(run, F.explode(facts(F.col("text"))["token"]).alias("token")).distinct().withColumn("given", F.lit(True))
    rows = used.join(first, [run, "token"], "left").join(given, [run, "token"], "left")
    source = F.when(F.col("given"), "given").when(F.col("s.n") < F.col("u.n"), F.when(F.col("s.record"), "record").otherwise("own")).otherwise("unsourced")
    return rows.select(run, "token", "u.kind", F.col("u.n").alias("n"), source.alias("source"))


def record_lines(calls: DataFrame, prompts: DataFrame, run: str = "run", n: str = "n", written: str = "text", shown: str = "result", record: str = "is_record") -> DataFrame:
    """(run, line, n): lines that a call writes first at `n`, that the prompt does not have, and that earlier results have only where they show
    the record."""
    is_record = F.coalesce(F.col(record), F.lit(False))
    wrote = calls.where(~is_record).select(run, n, F.explode(lines(F.col(written))).alias("line")).groupBy(run, "line").agg(F.min(n).alias("n"))
    seen = calls.select(run, F.explode(lines(F.col(shown))).alias("line"), F.col(n).alias("_n"), is_record.alias("_r"))
    # The first look at the record, and the first other result; a line counts if the former comes before it and the latter does not.
    first = seen.groupBy(run, "line").agg(F.min(F.when(F.col("_r"), F.col("_n"))).alias("r"), F.min(F.when(~F.col("_r"), F.col("_n"))).alias("o"))
    given = prompts.select(run, F.explode(lines(F.col("text"))).alias("line")).distinct()
    rows = wrote.join(first, [run, "line"]).where((F.col("r") < F.col("n")) & (F.col("o").isNull() | (F.col("o") >= F.col("n"))))
    return rows.join(given, [run, "line"], "left_anti").select(run, "line", "n")
