"""Operator 10: quality rules.

A table of thresholds is compiled into one projection over ratios of length, symbols, stop words and
lines. Everything is a built-in expression on one row: no shuffle, no user function.

Defined results: a null text is an empty text (0 words, base_failed, not kept); texts of any length are measured
whole; repeated rows and ids are judged each for itself; an empty table gives no rows; other columns of the input stay, whatever
their names, except that a measure, base_failed or kept replaces an input column of its own name in any case of letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import WORD

#: Frequent function words of four languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that be was for it with as on by at this are from or an "
    "der die und das von zu mit sich ist ein eine des den dem nicht auf für im "
    "de la que el y los del se las por un para con no una su al lo en "
    "le et les du est dans qui pour au sur par pas plus ne ce il"
).split()

#: Measure over measure, and the closed range in which a document stays (fixed values).
THRESHOLDS = (
    ("n_words", None, 50, float("inf")),
    ("word_chars", "n_words", 1.5, 16.0),
    ("n_symbols", "n_words", 0.0, 0.25),
    ("n_stop_words", "n_words", 0.01, 1.0),
    ("n_dup_lines", "n_lines", 0.0, 0.5),
    ("n_repeat_words", "n_words", 0.0, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the seven MEASURES as longs."""
    return _measured(docs, text).select(*_others(docs, MEASURES), "_m.*")


def _others(docs: DataFrame, names) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in names]


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """(_row, _m): the row, and a struct of its MEASURES.

    Three-word windows are sorted by two 64-bit hashes and their position, so that equal windows are neighbours. A window
    counts if it has its words in common with the one before it or the one after."""
    repeated = f"filter(grams, (x, k) -> coalesce({_same('k - 1')}, false) or coalesce({_same('k + 1')}, false))"
    at = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    at = at.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    at = at.withColumn("lines", F.filter(F.split("body", "\n", -1), lambda x: x.rlike(WORD)))
    three = "get(words, i), get(words, i + 1), get(words, i + 2)"
    at = at.withColumn("grams", F.expr(
        f"case when size(words) > 2 then sort_array(transform(sequence(0, size(words) - 3), i -> "
        f"struct(xxhash64({three}) as h, xxhash64(7, {three}) as h2, i as i))) else array() end"))
    at = at.withColumn("starts", F.expr(f"sort_array(transform({repeated}, x -> x.i))"))
    row = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(starts, named_struct('last', -3L, 'sum', 0L), "
               "(a, s) -> named_struct('last', cast(s as bigint), 'sum', a.sum + least(3L, s - a.last)), a -> a.sum)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # inline() of one struct: a filter on a measure stays above it, so that no text is measured twice.
    return at.select("_row", F.inline(F.array(F.struct(row.alias("_m")))))


def _same(k: str) -> str:
    """SQL: window x has the words of the window at position k."""
    y = f"get(grams, {k})"
    words = " and ".join(f"get(words, x.i + {n}) = get(words, {y}.i + {n})" for n in range(3))
    return f"(x.h = {y}.h and x.h2 = {y}.h2 and {words})"


def base_failed() -> Column:
    return (F.col("_m.n_words") < 50) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the measures."""
    tests = []
    for over, under, low, high in thresholds:
        value = F.col(f"_m.{over}") if under is None else F.col(f"_m.{over}") / F.greatest(F.col(f"_m.{under}"), F.lit(1))
        tests.append(value.between(low, high))
    return reduce(lambda a, b: a & b, tests)


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """`docs` with MEASURES, base_failed and kept."""
    kept = (~base_failed() & verdict(thresholds)).alias("kept")
    return _measured(docs, text).select(*_others(docs, (*MEASURES, "base_failed", "kept")), "_m.*", base_failed().alias("base_failed"), kept)


def keep_good(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that pass, with all their own columns, whatever these are named."""
    rows = _measured(docs, text).where(~base_failed() & verdict(thresholds))
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
