"""Counting rules per trial and the fixed reports over the record tables and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.plans.views import Tables, is_call, micros, prompt_paths

KEY = ["trial_id", "step_idx"]


def calls(t: Tables) -> DataFrame:
    return t["steps"].where(is_call())


def changed_steps(t: Tables) -> DataFrame:
    return t["deltas"].select(*KEY).distinct()


def mutating(t: Tables) -> DataFrame:
    return calls(t).join(changed_steps(t), KEY, "left_semi")


def probes(t: Tables) -> DataFrame:
    return calls(t).join(changed_steps(t), KEY, "left_anti")


def edits_after_probe(t: Tables) -> DataFrame:
    """Changing calls right after a call that changed nothing."""
    rows = calls(t).select(*KEY).join(changed_steps(t).withColumn("changed", F.lit(True)), KEY, "left")
    rows = rows.withColumn("before", F.lag(F.coalesce("changed", F.lit(False))).over(Window.partitionBy("trial_id").orderBy("step_idx")))
    return rows.where("changed and not before")


def loops(t: Tables, same_output: bool = False) -> DataFrame:
    """Calls with the tool and arguments (and output) of an earlier step that changed nothing."""
    on = ["trial_id", "tool", "args_json", *(["output"] if same_output else [])]
    first = t["steps"].dropna(subset=on).groupBy(*on).agg(F.min("step_idx").alias("first"))
    return calls(t).join(first, on).where("step_idx > first").join(changed_steps(t), KEY, "left_anti")


def reverts(t: Tables) -> DataFrame:
    """Rows whose content a path had before an earlier row, changed there or not."""
    seen = t["deltas"].groupBy("trial_id", "path", F.col("sha256_before").alias("sha256_after")).agg(F.min("step_idx").alias("first"))
    return t["deltas"].join(seen, ["trial_id", "path", "sha256_after"]).where("step_idx > first")


def retries(t: Tables, back: int = 3) -> DataFrame:
    """Calls that repeat one of the `back` calls before that had failed."""
    number = F.row_number().over(Window.partitionBy("trial_id").orderBy("step_idx"))
    rows = calls(t).select(*KEY, "tool", "args_json", "is_error", number.alias("n"))
    failed = rows.where("is_error").select("trial_id", "tool", "args_json", F.explode(F.sequence(F.col("n") + 1, F.col("n") + back)).alias("n"))
    return rows.join(failed, ["trial_id", "tool", "args_json", "n"], "left_semi")


def rejected(t: Tables) -> DataFrame:
    return calls(t).where(F.col("output").like("<tool_use_error>%"))


def idle_waits(t: Tables) -> DataFrame:
    return probes(t).withColumn("seconds", (micros("t_end") - micros("t_start")) / 1e6).where("seconds > 120")


def scripts_added(t: Tables) -> DataFrame:
    return t["deltas"].where("op = 'add' and path like '%.py' and path not like '%/__pycache__/%'").select("trial_id", "path").distinct()


def prompt_versions(t: Tables) -> DataFrame:
    return t["deltas"].join(prompt_paths(t["trials"], strip=False), ["trial_id", "path"], "left_semi")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trial_id").agg(F.count("*").alias("n"))


RULES = {
    "rule_tool_calls": calls, "rule_mutating": mutating, "rule_probes": probes, "rule_edits_after_probe": edits_after_probe, "rule_loops": loops,
    "rule_loops_same_output": lambda t: loops(t, True), "rule_reverts": reverts, "rule_retries": retries, "rule_rejected": rejected,
    "rule_cache_rows": lambda t: t["deltas"].where("path like '%__pycache__%'"), "rule_delta_rows": lambda t: t["deltas"],
    "rule_idle_waits": idle_waits, "rule_scripts_added": scripts_added, "rule_prompt_path_versions": prompt_versions,
}


def idle_seconds(t: Tables) -> DataFrame:
    """Whole seconds, halves rounded up; summed as microseconds, so that the order of the rows does not tell."""
    idle = F.sum(micros("t_end") - micros("t_start"))
    return idle_waits(t).groupBy("trial_id").agg(F.floor((idle + 500_000) / 1_000_000).cast("long").alias("n"))


def churn(t: Tables, n: int = 10) -> DataFrame:
    """The most often rewritten paths."""
    return t["deltas"].groupBy("path").agg(F.count("*").alias("versions")).orderBy(F.desc("versions"), "path").limit(n)


def large_rewrites(t: Tables, modifies: int = 3, min_bytes: int = 5000) -> DataFrame:
    """Failed first attempts with a large file that was modified often: path, modifications, last size."""
    per = t["deltas"].groupBy("trial_id", "path").agg(
        F.count_if(F.col("op") == "modify").alias("modifies"), F.max(F.when(F.col("bytes_after").isNotNull(), F.struct("step_idx", "bytes_after")))["bytes_after"].alias("bytes"))
    first = t["trials"].where("attempt_idx = 0 and reward < 1").select("trial_id", "task")
    return first.join(per.where((F.col("modifies") >= modifies) & (F.col("bytes") >= min_bytes)), "trial_id")


def share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 6)


def jobs_per_trial(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("trial_id").agg(F.count_if("backgrounded").alias("backgrounded"), F.count_if("launches_job").alias("by_hand"), F.count_if(F.col("job_status").isNotNull()).alias("noticed")).where("backgrounded + by_hand > 0")


def attribution_counts(a: DataFrame) -> DataFrame:
    return a.groupBy("attribution", "is_late").agg(F.count("*").alias("n"), F.countDistinct("trial_id").alias("trials"))


def late_lags(a: DataFrame) -> DataFrame:
    return a.where("is_late").groupBy((F.col("step_idx") - F.col("launched_by_step")).alias("lag")).agg(F.count("*").alias("n"))


def rule_agreement(a: DataFrame) -> DataFrame:
    """Per time rule: the rows that the write record settles, and how often both name one step."""
    recorded = F.col("attribution") == "recorded"
    agree = recorded & (F.col("rule_causal_step") == F.col("causal_step"))
    return a.groupBy("rule_attribution").agg(
        F.count("*").alias("n"), F.count_if(recorded).alias("recorded"), F.count_if(agree).alias("agree"), F.count_if(F.col("attribution") == "multi_writer").alias("multi"),
        share(F.count_if(agree), F.count_if(recorded)).alias("share"))
