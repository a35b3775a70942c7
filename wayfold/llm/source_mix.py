"""Operator 6: mixing sources to target weights with a low-discrepancy schedule.

1. Sizes in words; sources by code point (null last) get the weights in turn. Targets share `share` of all
   words by weight and stop at `most` times their source's size; what is over goes to the others by weight,
   which is one water level: target = least(most * size, level * weight).
2. Within a source, documents are laid end to end in the order of a hash of the row (the shuffle) and cut
   into blocks of equal words: `block`, or fewer where a source has not `least` such blocks. The running sum has
   two levels: sums of hash buckets, then rows of a bucket, so a source with a third of all rows is spread over
   its buckets.
3. The schedule has a slot for each block that the targets ask for. Slot k has the point frac(k * golden ratio),
   and the cumulative shares of the sources map the point to a source. The slots of a source are ranked, slot r takes
   the source's block r, and block r mod n from the second round on; it takes the block whole. So the points decide how many blocks
   of a source are taken and in what order: a source has its share of the slots to within a few, and of any stretch of
   them too. A slot that comes after all `most` rounds of its source stays empty.

Only built-in functions. Reruns agree: the order is a hash of the row, the points are a formula.

Defined results: a null or blank text has size 0 and is taken 0 times; null is a source of its own; repeated
rows are laid one after the other; an empty table, or one without words, gives targets of 0; other columns
of the input stay with mix(), whatever their names (map columns do not tell rows apart)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, n_words, row_id

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Words of a block, and the blocks that a source is cut into at the least, if it has as many words.
BLOCK_WORDS = 128
LEAST_BLOCKS = 512
#: frac(golden ratio), and frac(2^20 * golden ratio): a slot's number is split at 2^20 so that doubles hold its point.
GOLDEN, GOLDEN_HIGH = 0.6180339887498949, 0.607787409740351


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, h, h2): size in words, h the place in the shuffle; (h, h2) tells rows apart."""
    h, h2 = row_id(docs)
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), h.alias("h"), h2.alias("h2"))


def _all() -> "Window":
    return Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_rows, source_size, weight, target): one row for each source.

    The windows without a key run over one row for each source, not over documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((place - 1) % len(weights)) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size"))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    words = share * F.sum("source_size").over(_all())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level if all sources before this one, by ratio, are at their caps: right for the first one below its own.
    by = by.withColumn("level", (words - capped) / rest)
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(_all())
    target = F.least(F.col("cap"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))
    return by.select("source", "source_rows", "source_size", "weight", target.alias("target"))


def _with(rows: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """Join on keys of which source may be null."""
    other = small.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = F.col("source").eqNullSafe(F.col("_source"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(other, on).drop(*[f"_{k}" for k in keys])


def running(rows: DataFrame, value, order: list, out: str) -> DataFrame:
    """`rows` (source, bucket, ...) with `out`: the sum of `value` over the rows before, in the order of
    bucket, then `order`. Sums of buckets first, then rows within a bucket: no window holds a whole source."""
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy("source", "bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return _with(rows, sums, "source", "bucket").withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner", "_value")


def laid(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """Each row with its source's goal and `start`, the words before it in its source. Buckets are ranges of the
    hash, as many as the root of a source's rows: neither level of the sum has more than that in one group."""
    rows = _with(sized, goal.select("source", "source_rows", "source_size", "target"), "source")
    n = F.ceil(F.sqrt("source_rows")).cast("double")
    rows = rows.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * n).cast("long"))
    return running(rows, F.col("size"), ["h", "h2", "size"], "start").drop("bucket")


def block_of(source_size, block: int = BLOCK_WORDS, least: int = LEAST_BLOCKS):
    """Words of a block of a source."""
    return F.greatest(F.lit(1), F.least(F.lit(block), F.floor(source_size / least)))


def points(n: int, goal: DataFrame):
    """(place, point): the points of `n` slots, in [0, 1)."""
    high, low = F.shiftright("id", 20), F.col("id").bitwiseAND((1 << 20) - 1)
    return goal.sparkSession.range(n).select(F.col("id").alias("place"), ((high * GOLDEN_HIGH + low * GOLDEN) % 1.0).alias("point"))


def schedule(goal: DataFrame, block: int = BLOCK_WORDS, most: float = MOST, least: int = LEAST_BLOCKS) -> DataFrame:
    """(source, rank, place, blocks): the rank-th slot of a source, which has `blocks` blocks, is the place-th of all.

    A place is one slot's alone. Points meet the cumulative shares in cells of the unit interval, by an equal-key join; there are
    more cells than sources, so that few sources share one."""
    words = block_of(F.col("source_size"), block, least)
    goal = goal.where("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / words))
    goal = goal.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    high = F.sum("want").over(by_source.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("want").over(_all())
    shares = cut(goal.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(by_source), F.lit(0.0))))
    size = shares.agg(F.ceil(F.coalesce(F.sum("want"), F.lit(0.0))).alias("slots"), F.count("*").alias("sources")).first()
    cells = 1024 + 4 * size.sources
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    shares = shares.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * cells), F.lit(cells - 1)), last)))
    # The last source ends at 1, whatever the sums were rounded to.
    top = F.when(F.col("high") > 1 - 1e-9, F.lit(1.0)).otherwise(F.col("high"))
    slots = points(size.slots, goal).withColumn("cell", F.floor(F.col("point") * cells)).join(shares, "cell")
    slots = slots.where((F.col("point") >= F.col("low")) & (F.col("point") < top))
    slots = slots.select("source", "place", "blocks", F.floor(F.col("place") / (int(size.slots**0.5) + 1)).alias("bucket"))
    slots = running(slots, F.lit(1), ["place"], "rank")
    return slots.where(F.col("rank") < F.ceil(most * F.col("blocks"))).select("source", "rank", "place", "blocks")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
          share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS, least: int = LEAST_BLOCKS) -> DataFrame:
    """(key, h, h2, source, size, source_size, target, taken, first_slot, places) of every row: taken counts repeats; places
    holds the first slot that takes from the row in each round, null where none does."""
    sized = cut(sizes(docs, key, text, source))
    goal = cut(targets(sized, weights, share, most))
    rows = laid(sized, goal).withColumn("unit", block_of(F.col("source_size"), block, least))
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("unit")), F.floor((F.col("start") + F.col("size") - 1) / F.col("unit")))))
    slots = schedule(goal, block, most, least).select("source", (F.col("rank") % F.col("blocks")).alias("block"), "place")
    slots = slots.groupBy("source", "block").agg(F.sort_array(F.collect_list("place")).alias("slots"))
    slots = slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "slots")
    met = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    low = F.greatest(F.col("start"), F.col("block") * F.col("unit"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("unit"))
    words = (high - low) * F.greatest(F.size("slots"), F.lit(0))
    columns = ["key", "h", "h2", "source", "size", "source_size", "target"]
    by_round = [F.min(F.get("slots", F.lit(i))).alias(f"_{i}") for i in range(ceil(most))]
    taken = met.withColumn("words", words).groupBy(*columns, "start").agg(F.sum("words").alias("taken"), *by_round)
    taken = taken.select(*columns, "taken", F.array(*[f"_{i}" for i in range(ceil(most))]).alias("places"))
    none = rows.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("array<bigint>").alias("places"))
    out = taken.unionByName(none)
    return out.select(F.col("key").alias(key), *columns[1:], "taken", F.array_min("places").alias("first_slot"), "places")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix, whole, with all their columns, in the order of the schedule (in a slot, of the shuffle): as often as the mix takes from them,
    at most ceil(most) times. A document that a source's last block cuts is taken whole."""
    plan = mixed(docs, key, text, source, **how).select("h", "h2", F.explode("places").alias("place")).where("place is not null")
    many = plan.groupBy("h", "h2").agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("x"), F.max("place").alias("y"))
    h, h2 = row_id(docs)
    rows = docs.select(F.struct("*").alias("row"), h.alias("h"), h2.alias("h2")).join(many, ["h", "h2"])
    # A row of one or two slots carries them. Rows that repeat have more: one row of each kind meets its slots one by one.
    few = rows.where("n <= 2").select("row", "h", "h2", F.explode(F.when(F.col("n") == 1, F.array("x")).otherwise(F.array("x", "y"))).alias("place"))
    rest = rows.where("n > 2").select("row", "h", "h2")
    out = few.dropDuplicates(["h", "h2", "place"]).select("row", "place", "h", "h2").unionByName(_spread(rest, plan.join(many.where("n > 2").select("h", "h2"), ["h", "h2"])))
    return out.repartitionByRange("place", "h", "h2").sortWithinPartitions("place", "h", "h2").select("row.*")


def _spread(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, place, h, h2) for every row of `plan`, from one row of each (h, h2); the join may split a row with many slots."""
    one = rows.dropDuplicates(["h", "h2"]).select(F.struct("h", "h2").alias("id"), "row")
    return plan.select(F.struct("h", "h2").alias("at"), "place").join(one, F.col("at") == F.col("id")).select("row", "place", "id.h", "id.h2")
