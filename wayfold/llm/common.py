"""What the text operators share: table reading, checkpoints, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.lineage import checkpointed
from wayfold.operators.lineage import shared_folder as checkpoint_dir  # noqa: F401  (the pipeline writes there)

#: A word: a run of anything but the six ASCII blanks. Fixed by the result contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder all executors share, and go on from there."""
    return checkpointed(df)


def written(df: DataFrame) -> DataFrame:
    """As cut(), through Parquet: for loops, as what a plan knows of its columns grows with each checkpoint, and planning with it."""
    at = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


class Kept:
    """Rows written to the shared folder as Parquet, until drop() takes them away again."""

    def __init__(self, df: DataFrame):
        self.spark, self.at = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(self.at)
        self.rows = self.spark.read.parquet(self.at)

    def drop(self) -> None:
        """For rows that no result needs any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run here go when it has ended, and not when the driver's collector gets to them. Frames that are made here are for one run only."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)


def n_words(text: Column | str) -> Column:
    """Words of a text as a long; null counts 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_key(*cols: str) -> Column:
    """Tells rows apart that share an id but not a text; equal rows are equal in it."""
    return F.xxhash64(*cols)


def row_id(docs: DataFrame, *cols: str) -> tuple[Column, Column]:
    """Two hashes that tell any two different rows apart, or rows that differ in `cols`; maps, which have no hash, are left out."""
    named = [F.col(f"`{c}`") for c, kind in docs.dtypes if (c in cols if cols else "map<" not in kind)]
    return F.xxhash64(F.lit(1), *named), F.xxhash64(F.lit(2), *named)


def with_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """`rows` joined to `totals`, an aggregate by `key`, where one key may have a great share of the rows.

    They meet under a key of its own (a struct of the key). On the key itself the aggregate would not be dealt
    out again for the join, and adaptive execution splits a hot key only if both sides are."""
    named = totals.select(F.struct(key).alias("_own"), *[c for c in totals.columns if c != key])
    return rows.join(named, F.struct(rows[key].alias(key)) == named["_own"]).drop("_own")
