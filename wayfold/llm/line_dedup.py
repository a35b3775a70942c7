"""Lines that many documents share stay in one of them: levelled sorted runs of line hashes.

A run is a table of (k1, k2, docs, last): a line's key as 128 bits of hash, the documents that hold it and the largest of
their ids. Runs are bucketed and sorted by the key, all into the same buckets, so that runs are merged, and a batch is joined to
them, without dealing a run out again. A new batch is counted by key (combined before its shuffle), anti-joined to the keys that a
run has settled already (enough documents, and none of the batch has a larger id), and what is left becomes a run of its own;
`fanout` runs of a level are merged into one of the next. So a line that is everywhere enters the runs with its first batches only.

A line's key is the line without blanks (the six ASCII ones) at both ends and with A-Z lower-cased.

Defined results: every row is a document, rows of one id too; equal rows have equal results. A null text is an empty one and has
one empty line. A null id is smaller than any other; where only rows without id hold a line, they all keep it. Rows that share the
largest id all keep the line. An empty table gives no rows. Columns beside the text come through, whatever their names; the
measures n_lines and n_dropped replace columns of those names."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import row_id

#: Fixed by the result contract: code points of a key, and documents that hold it, from which on a line is shared.
MIN_CHARS, MIN_DOCS = 40, 5
#: Parts of the documents that dedup() adds one after another, by descending id.
BATCHES = 4
#: Keys in at least one of so many long lines go by a broadcast of their own; by that count there are never more of them.
HEAVY = 10_000
_BLANKS, _UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def _hashes(key: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key).alias("k1"), F.xxhash64(F.lit(2), key).alias("k2")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnsRenamed({"docs": "docs2", "last": "last2"})
    docs = F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))
    return a.join(b, ["k1", "k2"], "full").select("k1", "k2", docs.alias("docs"), F.greatest("last", "last2").alias("last"))


class LineRuns:
    """Levelled sorted runs of line hashes in the session's warehouse, for batches that come one after another."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, fanout: int = 2):
        self.spark, self.min_chars, self.min_docs, self.fanout = spark, min_chars, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.chars = 0

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def heavy(self, chars: int) -> int:
        """Documents from which on a key is heavy. Texts of so many characters hold at most chars / min_chars long lines."""
        return max(self.min_docs, chars // (self.min_chars * HEAVY) + 1)

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        run.select("k1", "k2", "docs", "last").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _merge(self, names: list[str], level: int) -> None:
        """One run of `level` in place of the named ones, by full joins of their buckets. (A union of bucketed tables is no way:
        grouped without an exchange, as Spark 4.1 plans it, it lost keys.)"""
        self._write(reduce(_both, [self.spark.table(n) for n in names]), level)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[x for x in at if x not in names] for at in self.levels]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch."""
        chars = docs.agg(F.sum(F.length(f"`{text_col}`"))).first()[0] or 0
        keys = F.array_distinct(F.transform(_lines(F.col(f"`{text_col}`")), _key))
        own = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(keys).alias("key")).where(F.length("key") >= self.min_chars)
        own = own.select("id", *_hashes("key")).groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
        heavy = self.heavy(chars)
        for name in self.runs:
            run = self.spark.table(name).where(F.col("docs") >= self.min_docs).select("k1", "k2", F.col("last").alias("upto"))
            settled = F.col("last").isNull() | (F.col("last") <= F.col("upto"))
            own = own.join(run, (own["k1"] == run["k1"]) & (own["k2"] == run["k2"]) & settled & (F.col("docs") < heavy), "left_anti")
        self._write(own, 0)
        self.chars += chars
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level + 1)

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            self._merge(self.runs, len(self.levels))

    def shared(self) -> DataFrame:
        """(k1, k2, docs, last) of the lines that enough documents hold. docs leaves out batches in which a settled line was not heavy."""
        self.compact()
        return self.spark.table(self.runs[0]).where(F.col("docs") >= self.min_docs)

    def dropped(self, docs: DataFrame, id_col: str, row: tuple[Column, Column]) -> DataFrame:
        """(r1, r2, gone): by row, the places of its lines that stay in a document of a larger id only.

        Keys in a great share of the lines are met in place, so that no task of the join gets all their lines: of keys that
        are not heavy here, fewer than two in HEAVY of the long lines have any one."""
        shared = self.shared()
        heavy = shared.where(F.col("docs") >= self.heavy(self.chars)).select("k1", "k2", F.col("last").alias("a"), F.lit(True).alias("in_a"))
        other = shared.where(F.col("docs") < self.heavy(self.chars)).select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("last").alias("b"), F.lit(True).alias("in_b"))
        # Hashes of a row come before its lines do: beside them, they would be taken again for each line.
        at = docs.select(row[0].alias("r1"), row[1].alias("r2"), F.col(f"`{id_col}`").alias("id"), F.col("`text`").alias("text"))
        at = at.select("r1", "r2", "id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        at = at.withColumn("key", _key(F.col("line"))).where(F.length("key") >= self.min_chars).select("r1", "r2", "id", "pos", *_hashes("key"))
        at = at.join(F.broadcast(heavy), ["k1", "k2"], "left")
        own = F.col("in_a").isNotNull()  # no need to look further: a key of its own, that no run has
        at = at.select("r1", "r2", "pos", "id", "a", "in_a", F.when(own, F.xxhash64("r1", "pos")).otherwise(F.col("k1")).alias("x1"),
                       F.when(own, F.xxhash64("r2", "pos", F.lit(3))).otherwise(F.col("k2")).alias("x2"))
        at = at.join(other, ["x1", "x2"], "left")
        gone = at.where(F.when(own, ~F.col("id").eqNullSafe(F.col("a"))).otherwise(F.col("in_b") & ~F.col("id").eqNullSafe(F.col("b"))))
        return gone.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))

    def close(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """The documents by descending id in about equal parts. Where exactly they are cut does not change results."""
    cuts = docs.agg(F.percentile_approx("`doc_id`", [i / n for i in range(1, n)])).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    if not cuts:
        return [docs]
    i = F.col("`doc_id`")
    parts = [docs.where(i > cuts[0]), *[docs.where((i <= a) & (i > b)) for a, b in zip(cuts, cuts[1:])]]
    return [*parts, docs.where((i <= cuts[-1]) | i.isNull())]


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents with their texts less shared lines, with n_lines (before) and n_dropped.

    A line of at least `min_chars` code points in at least `min_docs` documents stays in the document of the largest id only."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_chars, min_docs)
    for part in _batches(docs, batches):
        runs.add(part)
    row = row_id(docs, "doc_id", "text")
    gone = runs.dropped(docs, "doc_id", row).select(F.struct("r1", "r2").alias("r"), "gone")  # a struct: dealt out anew, so that a hot row can be split
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(row[0].alias("r1"), row[1].alias("r2")).alias("r"))
    out = whole.join(gone, "r", "left").select("row", "gone", _lines(F.col("row.text")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    n_lines, n_dropped = F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in names], n_lines, n_dropped)
