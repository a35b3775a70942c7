"""Retry chains: attempts in order, outcomes, solved by k, what a chain needs next, scores carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcome(reward: str = "reward", kind: str = "failure_kind"):
    """passed, failed, infra or lost."""
    return F.when(F.col(reward) >= 1, "passed").when(F.col(kind) == "infra_error", "infra").when(F.col(reward).isNull() & F.col(kind).isNull(), "lost").otherwise("failed")


#: How an attempt's exception is filed (fixed values).
TIMEOUTS = ("AgentTimeoutError", "VerifierTimeoutError")
AGENT_ERRORS = ("NonZeroAgentExitCodeError",)
INFRA_ERRORS = ("EnvironmentStartTimeoutError", "AgentSetupTimeoutError", "DockerError", "CancelledError")


def failure_kind(reward: str = "reward", exception: str = "exception_type"):
    e = F.col(exception)
    return F.when(F.coalesce(F.col(reward) >= 1, F.lit(False)), F.lit(None)).when(e.isNull(), "ended_turn").when(e.isin(*TIMEOUTS), "timeout").when(e.isin(*AGENT_ERRORS), "agent_error").when(e.isin(*INFRA_ERRORS), "infra_error").otherwise("unclassified")


def broken_chains(attempts: DataFrame) -> DataFrame:
    """(chain): chains whose attempts are not 0..k-1, each with the one before as its parent."""
    w = Window.partitionBy("chain").orderBy("attempt_idx")
    rows = attempts.withColumn("_i", F.row_number().over(w) - 1).withColumn("_p", F.lag("trial_id").over(w))
    wrong = (F.col("_i") != F.col("attempt_idx")) | ~F.col("parent_trial_id").eqNullSafe(F.col("_p"))
    return rows.where(wrong).select("chain").distinct()


def solved_by(attempts: DataFrame, by: list[str], budget: int) -> DataFrame:
    """(by, k, solved, known): chains solved within k attempts, and those of which k attempts are known.

    attempts: (by, chain, attempt from 1, passed); a chain that ended unsolved early is known up to its end."""
    chains = attempts.groupBy(*by, "chain").agg(F.min(F.when(F.col("passed"), F.col("attempt"))).alias("first"), F.max("attempt").alias("tried"))
    rows = chains.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(budget))))
    solved = F.coalesce(F.col("first") <= F.col("k"), F.lit(False))
    return rows.groupBy(*by, "k").agg(F.count_if(solved).alias("solved"), F.count_if(solved | (F.col("tried") >= F.col("k"))).alias("known"))


def next_step(attempts: DataFrame, budget: int) -> DataFrame:
    """(chain, needs): done if passed, stopped after a lost attempt, ingest if the last is not yet in the store, launch, or done at the budget."""
    last = attempts.groupBy("chain").agg(F.max(F.struct("attempt_idx", "outcome", "ingested")).alias("l"), F.count_if(F.col("outcome").isin("passed", "failed")).alias("counted"))
    needs = F.when(F.col("l.outcome") == "passed", "done").when(F.col("l.outcome") == "lost", "stopped").when(F.col("counted") >= budget, "done").when(~F.col("l.ingested"), "ingest").otherwise("launch")
    return last.select("chain", needs.alias("needs"), "counted")


def seen_before(attempts: DataFrame, by: list[str], answer: str = "answer") -> DataFrame:
    """Attempts with `repeat`: whether the chain had the same answer before."""
    return attempts.withColumn("repeat", F.row_number().over(Window.partitionBy(*by, answer).orderBy("attempt")) > 1)


def carried_scores(scores: DataFrame, by: list[str], budget: int, mark: float) -> DataFrame:
    """(by, attempt, score): normalised to 0..1 by `mark`; after a chain's end its last score goes on to the budget."""
    score = F.least(F.greatest(F.col("score") / mark, F.lit(0.0)), F.lit(1.0))
    per = scores.where(F.col("attempt") <= budget).withColumn("score", score)
    last = per.groupBy(*by).agg(F.max(F.struct("attempt", "score")).alias("l"))
    rest = last.where(F.col("l.attempt") < budget).select(*by, F.explode(F.sequence(F.col("l.attempt") + 1, F.lit(budget))).alias("attempt"), "l.score")
    return per.select(*by, "attempt", "score").unionByName(rest)


def root_choice(attempts: DataFrame, n: int = 2) -> DataFrame:
    """Per task, the `n` failed attempts whose score is nearest the task's median, the earlier start first."""
    median = attempts.groupBy("task").agg(F.median("score").alias("median"))
    rows = attempts.where("not passed").join(median, "task").withColumn("off", F.abs(F.col("score") - F.col("median")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("off", "started", "name"))).where(F.col("place") <= n)


def funnel(rows: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """One row: how many rows pass each predicate and all those before it."""
    passed, out = F.lit(True), []
    for name, predicate in steps:
        passed = passed & F.coalesce(F.expr(predicate), F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return rows.agg(*out)
