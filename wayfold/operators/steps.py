"""Trajectory documents to step rows, and what the capture's records say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A trajectory document, as far as steps are made from it.
DOCUMENT = (
    "trial_id string, steps array<struct<step_id: int, timestamp: string, source: string, message: string, reasoning_content: string, "
    "tool_calls: array<struct<tool_call_id: string, function_name: string, arguments: string>>, "
    "observation: struct<results: array<struct<source_call_id: string, content: string, is_error: boolean>>>>>"
)


def flatten(documents: DataFrame) -> DataFrame:
    """One row for each tool call, else for each step: (trial_id, step_idx, atif_step_id, source, tool_call_id, tool,
    args_json, output, is_error, message, reasoning, t_start). Message and reasoning stand on a step's first row;
    a user's first message is the prompt and no row."""
    steps = documents.select("trial_id", F.posexplode("steps").alias("at", "s"))
    first = steps.where("s.source = 'user'").groupBy("trial_id").agg(F.min("at").alias("prompt_at"))
    steps = steps.join(first, "trial_id", "left").where("prompt_at is null or at <> prompt_at")
    calls = steps.select("trial_id", "at", "s", F.posexplode_outer("s.tool_calls").alias("pos", "call"))
    results = steps.select("trial_id", "at", F.explode("s.observation.results").alias("r")).select("trial_id", "at", F.col("r.source_call_id").alias("call_id"), "r.content", "r.is_error")
    results = results.groupBy("trial_id", "at", "call_id").agg(F.first("content").alias("output"), F.first("is_error").alias("is_error"))
    rows = calls.withColumn("call_id", F.col("call.tool_call_id")).join(results, ["trial_id", "at", "call_id"], "left")
    opening = F.coalesce(F.col("pos"), F.lit(0)) == 0
    number = F.row_number().over(Window.partitionBy("trial_id").orderBy("at", F.col("pos").asc_nulls_first()))
    return rows.select(
        "trial_id", number.alias("step_idx"), F.col("s.step_id").alias("atif_step_id"), F.col("s.source").alias("source"), F.col("call_id").alias("tool_call_id"),
        F.col("call.function_name").alias("tool"), F.col("call.arguments").alias("args_json"), "output", "is_error", F.when(opening, F.col("s.message")).alias("message"),
        F.when(opening, F.col("s.reasoning_content")).alias("reasoning"), F.to_timestamp("s.timestamp").alias("t_start"))


def repeated_results(documents: DataFrame) -> DataFrame:
    """Call ids that two results of a step answer: an error of the document."""
    r = documents.select("trial_id", F.posexplode("steps").alias("at", "s")).select("trial_id", "at", F.explode("s.observation.results").alias("r"))
    return r.groupBy("trial_id", "at", "r.source_call_id").agg(F.count("*").alias("n")).where("n > 1")


def call_states(calls: DataFrame, answered: DataFrame, timeouts: DataFrame) -> DataFrame:
    """calls (trial_id, tool_call_id, output, is_last) with `state`: answered, timed_out, rejected, interrupted or unanswered."""
    key = ["trial_id", "tool_call_id"]
    rows = calls.join(answered.select(*key, F.lit(True).alias("_a")).distinct(), key, "left").join(timeouts.select(*key, F.lit(True).alias("_t")).distinct(), key, "left")
    state = (
        F.when(F.col("_a"), "answered").when(F.col("_t"), "timed_out").when(F.col("output").startswith("<tool_use_error>"), "rejected")
        .when(F.col("output").isNull() & F.col("is_last"), "interrupted").otherwise("unanswered"))
    return rows.withColumn("state", state).drop("_a", "_t")


def chain_report(states: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(trial_id, hooked_calls, answered_calls, timed_out_calls, ..., checkpoints, reasons, complete)."""
    pick = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("tool_call_id")))).alias(f"{s}_calls")
    per = states.groupBy("trial_id").agg(
        F.count("*").cast("int").alias("hooked_calls"), F.count_if(F.col("state") == "answered").cast("int").alias("answered"), *[pick(s) for s in ("timed_out", "unanswered", "interrupted", "rejected")])
    per = per.withColumnRenamed("answered", "answered_calls").join(checkpoints.groupBy("trial_id").agg(F.count("*").cast("int").alias("checkpoints")), "trial_id", "left")
    per = per.withColumn("checkpoints", F.coalesce("checkpoints", F.lit(0)))
    reason = lambda cond, *text: F.when(cond, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]))
    reasons = F.array_compact(F.array(
        reason(F.size("timed_out_calls") > 0, F.size("timed_out_calls").cast("string"), " calls timed out"),
        reason(F.size("unanswered_calls") > 0, F.size("unanswered_calls").cast("string"), " calls without an answer"),
        reason(F.col("checkpoints") == 0, "no checkpoint")))
    return per.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0)


def state_walk(rows: DataFrame) -> DataFrame:
    """rows (trial_id, step_idx, seq, covered, changed) with `checkpoint_seq`: the checkpoint a row's state is known by.

    A row that names a checkpoint has it; later rows keep the highest seen; a change that no checkpoint covers
    makes the state unknown (null) until the next checkpoint. Running aggregates in step order."""
    w = Window.partitionBy("trial_id").orderBy("step_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_group", F.count("seq").over(upto)).withColumn("_high", F.max("seq").over(upto))
    lost = F.col("changed") & ~F.col("covered") & F.col("seq").isNull()
    within = Window.partitionBy("trial_id", "_group").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("checkpoint_seq", F.when(~F.coalesce(F.bool_or(lost).over(within), F.lit(False)), F.col("_high"))).drop("_group", "_high")


def enrich(steps: DataFrame, checkpoints: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One order of steps (trial_id, step_id, at), checkpoints (trial_id, owner, at) and context boundaries (trial_id, at):
    (trial_id, number, kind, step_id). A checkpoint follows its owner, a boundary precedes the first later step."""
    rows = steps.select("trial_id", F.col("step_id").cast("double").alias("anchor"), F.lit(1).alias("rank"), "at", F.lit("step").alias("kind"), "step_id")
    marks = checkpoints.select("trial_id", F.col("owner").cast("double").alias("anchor"), F.lit(2).alias("rank"), "at", F.lit("checkpoint").alias("kind"), F.col("owner").alias("step_id"))
    later = boundaries.select("trial_id", F.col("at").alias("b_at")).join(steps.select("trial_id", "step_id", F.col("at").alias("s_at")), "trial_id").where("s_at >= b_at")
    firsts = boundaries.select("trial_id", F.col("at").alias("b_at")).join(later.groupBy("trial_id", "b_at").agg(F.min("step_id").alias("f")), ["trial_id", "b_at"], "left")
    breaks = firsts.select("trial_id", F.coalesce(F.col("f").cast("double"), F.lit(float("inf"))).alias("anchor"), F.lit(0).alias("rank"), F.col("b_at").alias("at"), F.lit("boundary").alias("kind"), F.lit(None).cast("int").alias("step_id"))
    every = rows.unionByName(marks).unionByName(breaks)
    number = F.row_number().over(Window.partitionBy("trial_id").orderBy("anchor", "rank", "at"))
    return every.select("trial_id", number.alias("number"), "kind", "step_id")
