"""Check timelines: statuses per check and point, their class, regressions, replays that are missing, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import checkpointed

#: Samples of a state that must agree before its verdict counts.
QUORUM = 3


def verdicts(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, state, check, status, samples) from rows (by, state, sample, check, status): one status if all samples
    of a state agree, flaky if not, unknown if no sample says, absent for a check the samples leave out."""
    said = samples.groupBy(*by, "state", "check").agg(
        (F.min("status") != F.max("status")).alias("mixed"), F.min("status").alias("status"), F.countDistinct("sample").alias("samples"))
    states = samples.groupBy(*by, "state").agg(F.countDistinct("sample").alias("all_samples"))
    checks = samples.select(*by, "check").distinct()
    rows = states.join(checks, by).join(said, [*by, "state", "check"], "left")
    status = (
        F.when(F.coalesce("samples", F.lit(0)) == 0, "absent").when(F.col("samples") < F.col("all_samples"), "flaky")
        .when(F.col("mixed"), "flaky").otherwise(F.coalesce("status", F.lit("unknown"))))
    return rows.select(*by, "state", "check", status.alias("status"), F.coalesce("samples", F.lit(0)).alias("samples"))


def check_timelines(points: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, check, index, status): every check at every point of `points` (by, index, state); null where a state
    has no verdict."""
    checks = found.select(*by, "check").distinct()
    return points.join(checks, by).join(found, [*by, "state", "check"], "left").select(*by, "check", "index", "status")


def classify(rows: DataFrame, by: list[str], index: str = "index", status: str = "status") -> DataFrame:
    """(by, verdict, point, last_pass): what became of each check over its timeline, one aggregate.

    incomplete: a point without a status, or an unknown one. passes: passed to the end, from `point` on; unstable
    if a flaky point comes right before. Else never_passed without a pass, regression with one, broken from
    `point` on; both are unstable if a flaky point leaves that open."""
    at, s = F.col(index), F.col(status)
    ok = F.coalesce(s == "passed", F.lit(False))
    per = rows.groupBy(*by).agg(
        F.max(F.when(ok, at)).alias("_pass"), F.max(F.when(~ok, F.struct(at, s)))[status].alias("_other"), F.max(F.when(~ok, at)).alias("_other_at"),
        F.max(F.when(s == "flaky", at)).alias("_flaky"), F.max(at).alias("_last"), F.min(at).alias("_first"), F.count_if(s.isNull() | (s == "unknown")).alias("_gaps"))
    to_end = F.coalesce(F.col("_pass") == F.col("_last"), F.lit(False))
    verdict = (
        F.when(F.col("_gaps") > 0, "incomplete")
        .when(to_end, F.when(F.col("_other") == "flaky", "unstable").otherwise("passes"))
        .when(F.col("_pass").isNull(), F.when(F.col("_flaky").isNotNull(), "unstable").otherwise("never_passed"))
        .when(F.col("_flaky") > F.col("_pass"), "unstable").otherwise("regression"))
    point = F.when(F.col("verdict") == "passes", F.coalesce(F.col("_other_at") + 1, F.col("_first"))).when(F.col("verdict") == "regression", F.col("_pass") + 1)
    return per.withColumn("verdict", verdict).select(*by, "verdict", point.alias("point"), F.when(F.col("verdict") == "regression", F.col("_pass")).alias("last_pass"))


def regressions(classes: DataFrame, by: list[str]) -> DataFrame:
    """(by, broke_at): the point right after the last pass of each regression."""
    return classes.where("verdict = 'regression'").select(*by, F.col("point").alias("broke_at"))


def missing_replays(points: DataFrame, samples: DataFrame, by: list[str], quorum: int = QUORUM) -> DataFrame:
    """(by, state, wave): one row for each replay that a state still needs, in waves: the first of every state first."""
    have = samples.groupBy(*by, "state").agg(F.countDistinct("sample").alias("n"))
    need = points.select(*by, "state").distinct().join(have, [*by, "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return need.where(F.col("n") < quorum).withColumn("wave", F.explode(F.sequence(F.col("n") + 1, F.lit(quorum).cast("long")))).drop("n")


def interleave(rows: DataFrame, wave: str, task: str, name: str) -> DataFrame:
    """`rows` with `place`: waves in turn, within a wave one row of each task in turn."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(wave, task).orderBy(name)))
    return ranked.orderBy(wave, "_rank", name).drop("_rank")


def gates(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, checks): how many checks of a trial agree with themselves: steady, flaky or unknown."""
    kind = F.when(F.bool_or(F.col("status") == "flaky"), "flaky").when(F.bool_or(F.col("status") == "unknown"), "unknown").otherwise("steady")
    return found.groupBy(*by, "check").agg(kind.alias("kind")).groupBy(*by, "kind").agg(F.count("*").alias("checks"))


def fix_sets(base: DataFrame, tried: DataFrame, by: list[str]) -> DataFrame:
    """(by, fixed, broken, still_failing): sorted checks of a fix's statuses against those before it."""
    rows = base.where("status <> 'flaky'").select(*by, "check", F.col("status").alias("was")).join(tried.select(*by, "check", F.col("status").alias("now")), [*by, "check"])
    was, now = F.col("was") == "passed", F.col("now") == "passed"
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("check"))))
    return rows.groupBy(*by).agg(pick(~was & now).alias("fixed"), pick(was & ~now).alias("broken"), pick(~was & ~now).alias("still_failing"))


def status_marks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, check, marks): a timeline as one mark for each point."""
    mark = F.when(F.col("status") == "passed", "P").when(F.col("status") == "failed", "F").when(F.col("status") == "absent", "-").when(F.col("status") == "flaky", "~").otherwise("?")
    return rows.groupBy(*by, "check").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", mark.alias("m")))), lambda x: x["m"]), "").alias("marks"))


def state_changes(points: DataFrame, by: list[str], index: str = "index", state: str = "state") -> DataFrame:
    """Points whose state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(index))
    return points.withColumn("_b", before).where(F.col("_b").isNotNull() & ~F.col("_b").eqNullSafe(F.col(state))).drop("_b")


def state_letters(points: DataFrame, by: list[str], index: str = "index", state: str = "state") -> DataFrame:
    """(by, state, letter): 1 for the state seen first, 2 for the next new one."""
    first = points.groupBy(*by, state).agg(F.min(index).alias("_first"))
    return first.select(*by, state, F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")).alias("letter"))


def state_id(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, state_id): one digest of the sorted entries (path, kind, sha256), equal for equal states."""
    rows = F.sort_array(F.collect_list(F.struct("path", "kind", "sha256")))
    return entries.groupBy(*by).agg(F.sha2(F.to_json(rows), 256).alias("state_id"))


def check_components(needs: DataFrame, by: list[str]) -> DataFrame:
    """(by, check, component): checks that share a hunk they need (by, check, hunk), directly or through others, have one
    component, named by its least check. Labels go over hunks and back until none changes; only a flag reaches the driver."""
    edges = needs.select(*by, "check", "hunk").where("check is not null and hunk is not null").distinct()
    edges = checkpointed(edges)
    labels = edges.select(*by, "check", F.col("check").alias("component")).distinct()
    while True:
        per_hunk = edges.join(labels, [*by, "check"]).groupBy(*by, "hunk").agg(F.min("component").alias("component"))
        found = edges.join(per_hunk, [*by, "hunk"]).groupBy(*by, "check").agg(F.min("component").alias("_now"))
        step = labels.join(found, [*by, "check"]).withColumn("_moved", F.col("_now") < F.col("component")).checkpoint()
        labels = step.select(*by, "check", F.col("_now").alias("component"))
        if step.where("_moved").isEmpty():
            return labels
