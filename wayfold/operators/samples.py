"""Seeded samples that do not depend on partitioning, and assertions that cost no pass of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def lot(seed: int, *key: str) -> Column:
    """A row's lot: hex digits that the seed and the row's key decide. Nulls are empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))


def bottom_k(rows: DataFrame, strata: Sequence[str], key: Sequence[str], n: int | Column, seed: int) -> DataFrame:
    """The n rows of each stratum with the smallest lots; n may be a column, the stratum's quota. `key` is unique in a stratum.

    With a number for n, tasks pass on no more than n rows of a stratum."""
    w = Window.partitionBy(*strata).orderBy(lot(seed, *key), *key)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def review_sample(rows: DataFrame, must: Column, strata: Sequence[str], key: Sequence[str], share: float, seed: int) -> DataFrame:
    """`rows` with why: `must` for all that must be looked at, `stratum` for one of each stratum of the others, `share` for those of the rest whose
    lot is below `share` of all lots; other rows are left out. Lots are compared by their first 15 hex digits."""
    first = F.row_number().over(Window.partitionBy(*strata, "_must").orderBy(lot(seed, *key), *key)) == 1
    low = F.conv(F.left(lot(seed + 1, *key), F.lit(15)), 16, 10).cast("long") < F.lit(int(share * 16**15))
    why = F.when(F.col("_must"), "must").when(F.col("_first"), "stratum").when(low, "share")
    marked = rows.withColumn("_must", F.coalesce(must, F.lit(False))).withColumn("_first", first)
    return marked.withColumn("why", why).where("why is not null").drop("_must", "_first")


def queues(rows: DataFrame, strata: Sequence[str], key: Sequence[str], sizes: dict[str, int], seed: int) -> DataFrame:
    """`rows` with queue and place: rows in the order of their lots, one of each stratum in turn, dealt into the queues in their order;
    rows beyond all queues are left out."""
    of = Window.partitionBy(*strata).orderBy(lot(seed, *key), *key)
    total = sum(sizes.values())
    turns = rows.withColumn("_turn", F.row_number().over(of)).where(F.col("_turn") <= total)
    first = turns.orderBy("_turn", lot(seed, *key), *key).limit(total)
    # At most as many rows as the queues have places, so one task numbers them.
    placed = first.withColumn("_n", F.row_number().over(Window.orderBy("_turn", lot(seed, *key), *key)))
    queue, start, upto = F.lit(None).cast("string"), F.lit(None).cast("int"), total
    for name in reversed(sizes):
        upto -= sizes[name]
        inside = F.col("_n") > upto
        queue, start = F.coalesce(queue, F.when(inside, name)), F.coalesce(start, F.when(inside, upto))
    return placed.withColumns({"queue": queue, "place": (F.col("_n") - start).cast("int")}).drop("_turn", "_n")


class Disagreement(ValueError):
    """A source says something else than the others."""


def single_value(rows: DataFrame, value: str, holder: str, show: int = 5) -> str | None:
    """The one value that all rows have, from one aggregate; Disagreement names up to `show` holders of each of two values. No rows: None."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("null"))
    got = rows.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    if got.low == got.high:
        return got.low
    names = {x: [r[0] for r in rows.where(v == x).select(holder).limit(show).collect()] for x in (got.low, got.high)}
    raise Disagreement(f"{value}: " + "; ".join(f"{x} in {', '.join(map(str, h))}" for x, h in names.items()))


def digest_conflicts(rows: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """(by, digests, first, last): groups with more than one digest."""
    return rows.groupBy(*by).agg(F.count_distinct(digest).alias("digests"), F.min(digest).alias("first"), F.max(digest).alias("last")).where("digests > 1")


def watched(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """`rows` unchanged, with metrics that are counted while they pass; read them after an action by check() or .get."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def check(seen: Observation, **most: int) -> dict:
    """The metrics of watched() after its action; Disagreement if one is larger than it may be."""
    got = seen.get
    over = {k: got[k] for k, n in most.items() if (got[k] or 0) > n}
    if over:
        raise Disagreement(", ".join(f"{k} is {v}, at most {most[k]}" for k, v in over.items()))
    return got


def capped(rows: DataFrame, by: Sequence[str], order: Sequence[str], capacity: int) -> DataFrame:
    """(by, kept, overflow): what a queue of so many places keeps of each group and how much runs over."""
    n = F.count("*")
    return rows.groupBy(*by).agg(F.least(n, F.lit(capacity)).alias("kept"), F.greatest(n - capacity, F.lit(0)).alias("overflow"))
