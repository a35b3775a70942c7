"""Tables a trial or a job at a time: usage and its price, call totals, phases, points and the calls they cover, flags and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of tokens that are paid for.
TOKENS = ("input", "cache_write_5m", "cache_write_1h", "cache_read", "output")


def last_usage(events: DataFrame, by: Sequence[str], message: str, order: Sequence[str], tokens: Sequence[str] = TOKENS, price: dict[str, float] | None = None) -> DataFrame:
    """(by, api_calls, tok_*, cost): each message's last usage, summed; the price is dollars a million tokens. Rows without a message or without usage
    (all tokens null) do not count."""
    told = F.coalesce(*[F.col(t) for t in tokens]).isNotNull() & F.col(message).isNotNull()
    last = events.where(told).groupBy(*by, message).agg(F.max(F.struct(*order, *[F.coalesce(F.col(t), F.lit(0)).alias(f"_{t}") for t in tokens])).alias("u"))
    sums = last.groupBy(*by).agg(F.count("*").alias("api_calls"), *[F.sum(f"u._{t}").alias(f"tok_{t}") for t in tokens])
    cost = sum((F.col(f"tok_{t}") * p for t, p in (price or {}).items()), F.lit(0.0))
    return sums.withColumn("cost", F.round(cost / 1e6, 4))


def call_totals(calls: DataFrame, by: Sequence[str], tool: str, seconds: Column, size: Column, digits: int = 1) -> DataFrame:
    """(by, tools, calls, seconds, bytes, largest): a map of calls by tool, and the sums over all calls."""
    per = calls.groupBy(*by, F.coalesce(F.col(tool), F.lit("?")).alias("t")).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"), F.sum(size).alias("b"), F.max(size).alias("m"))
    tools = F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n"))))
    return per.groupBy(*by).agg(tools.alias("tools"), F.sum("n").alias("calls"), F.round(F.sum("s"), digits).alias("seconds"), F.sum("b").alias("bytes"), F.max("m").alias("largest"))


def flag_prefixes(rows: DataFrame, flags: str) -> DataFrame:
    """(flag, items): items that carry a flag, by what stands before its colon, each item once."""
    return rows.select(F.explode(F.array_distinct(F.transform(flags, lambda f: F.substring_index(f, ":", 1)))).alias("flag")).groupBy("flag").agg(F.count("*").alias("items"))


def busiest(events: DataFrame, calls: DataFrame, by: Sequence[str], at: str, start: str, end: str, n: int = 3) -> DataFrame:
    """(by, start, end, events, rate): the n calls of each group with the most events a second, of those within them; a call counts as a second at least.

    Calls of one group do not overlap: an event belongs to the last call that began, if it had not ended, so this is one ordered pass over both and no range
    join."""
    e = events.select(*by, F.col(at).alias("_at"), F.lit(None).cast("struct<s: bigint, e: bigint>").alias("_call"))
    c = calls.select(*by, F.col(start).alias("_at"), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("_call"))
    order = Window.partitionBy(*by).orderBy("_at", F.col("_call").isNull())
    both = e.unionByName(c).withColumn("_in", F.last("_call", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = both.where(F.col("_call").isNull() & (F.col("_at") <= F.col("_in.e")))
    per = inside.groupBy(*by, "_in").agg(F.count("*").alias("events"))
    per = per.select(*by, F.col("_in.s").alias(start), F.col("_in.e").alias(end), "events", F.round(F.col("events") / F.greatest((F.col("_in.e") - F.col("_in.s")) / 1e6, F.lit(1.0)), 4).alias("rate"))
    top = Window.partitionBy(*by).orderBy(F.desc("rate"), F.desc("events"), start)
    return per.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= n).drop("_n")


def resumes(steps: DataFrame, by: Sequence[str], order: str, at: Column, answered: Column) -> DataFrame:
    """`steps` with resumed_at: when the agent went on, which is when the step before was answered, else when it was; carried on over steps without either."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(F.coalesce(answered, at)).over(w)
    return steps.withColumn("_before", before).withColumn("resumed_at", F.last("_before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before")


def covering_points(points: DataFrame, by: Sequence[str], index: str, covered: str) -> DataFrame:
    """(by, call, point): the last point that covers each call."""
    return points.select(*by, index, F.explode(covered).alias("call")).groupBy(*by, "call").agg(F.max(index).alias("point"))


def uncovered(calls: DataFrame, points: DataFrame, by: Sequence[str], call: str, covered: str, unchanged: Column) -> DataFrame:
    """Answered calls that no point covers, without those measured to have changed nothing."""
    known = points.select(*by, F.explode(covered).alias(call)).distinct()
    return calls.where(~F.coalesce(unchanged, F.lit(False))).join(known, [*by, call], "left_anti")


def confusion(rows: DataFrame, told: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, told, truth, n): how often each verdict met each truth; a missing one is `none`."""
    return rows.groupBy(*by, F.coalesce(F.col(told), F.lit("none")).alias("told"), F.coalesce(F.col(truth), F.lit("none")).alias("truth")).agg(F.count("*").alias("n"))


def first_positions(calls: DataFrame, by: Sequence[str], order: str, kinds: dict[str, Column]) -> DataFrame:
    """(by, one column a kind): the number, from 1, of the first call of each kind."""
    numbered = calls.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return numbered.groupBy(*by).agg(*[F.min(F.when(c, F.col("_n"))).alias(k) for k, c in kinds.items()])


def best_run(runs: DataFrame, by: Sequence[str], passed: str, failed: str, order: str) -> DataFrame:
    """The run of each group with the most passed, of those the fewest failed, then the last."""
    best = F.max_by(F.struct("*"), F.struct(F.col(passed), -F.col(failed), F.col(order))).alias("b")
    return runs.groupBy(*by).agg(best).select("b.*")


def quiet_first(changes: DataFrame, by: Sequence[str], noisy: Column, path: str, cap: int) -> DataFrame:
    """At most `cap` changes of each group, quiet ones first, then by path, with `total`, what there was."""
    w = Window.partitionBy(*by)
    ranked = changes.withColumn("_n", F.row_number().over(w.orderBy(F.coalesce(noisy, F.lit(False)), path)))
    totals = changes.groupBy(*by).agg(F.count("*").alias("total"))
    return ranked.where(F.col("_n") <= cap).drop("_n").join(totals, list(by))


def bins(value: Column, edges: Sequence[float]) -> Column:
    """Which half-open bin [edge, next edge) a value is in, from 0; null outside of all."""
    found = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return F.when(value.isNull() | (value < edges[0]) | (value >= edges[-1]), F.lit(None).cast("int")).otherwise(found.cast("int"))


def geometric(low: float, high: float, n: int) -> list[float]:
    """Edges of n bins, each as much wider than the one before."""
    return [low * (high / low) ** (i / n) for i in range(n + 1)]


def job_summary(trials: DataFrame, by: Sequence[str], finished: Column, passed: Column, captured: Column) -> DataFrame:
    """(by, trials, finished, passed, captured)."""
    return trials.groupBy(*by).agg(F.count("*").alias("trials"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in (("finished", finished), ("passed", passed), ("captured", captured))])
