"""Which step a write event comes from: by the command its shell ran, by when the shell began, by the shell of its session, by the tool's window.

A shell is attributed once, however many events it has; events take what was found for their own shell and for the shell of their session.
Steps are met by equal (trial, hash) and cells of time, never all steps of a trial by all its events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import patterns
from wayfold.operators.joins import asof, in_one_span, interval
from wayfold.operators.lineage import written

#: Microseconds by which a window may be missed (fixed value).
SLACK = 1_000_000
#: Width of the cells of time in which shells meet steps, microseconds.
CELL = 60_000_000
#: A redirect to the null device under its other name, which a shell records under the usual one (fixed value).
NUL_REDIRECT = r"(\d?&?>+[ \t]*)[Nn][Uu][Ll](?=\s|\z|[|&;)\n])"
_SHELL = ["trial_id", "pid", "started_at", "command_sha256"]


def command_hashes(command: Column) -> Column:
    """Array of the SHA-256 values that a shell may record for a command: of its text, and with the null device renamed where nothing quotes
    or expands."""
    renamed = F.regexp_replace(command, NUL_REDIRECT, "$1/dev/null")
    # Most commands name no null device: their text is hashed once.
    return F.array_compact(F.when(command.rlike(NUL_REDIRECT) & ~command.rlike("[<$`]"), F.array(F.sha2(command, 256), F.sha2(renamed, 256))).otherwise(F.array(F.sha2(command, 256))))


def _with(rows: DataFrame, found: DataFrame, by: Sequence[str], values: Sequence[str], how: str = "left") -> DataFrame:
    """`rows` with `values` of `found`, keys compared null-safe."""
    other = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *values)
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    return rows.join(other, on, how).drop(*[f"_k{i}" for i in range(len(by))])


def _windows(steps: DataFrame) -> DataFrame:
    """Steps with their window, give or take SLACK."""
    upto = F.coalesce("t_end", "t_start")
    return steps.where("t_start is not null").withColumns({"_upto": upto, "_from": F.col("t_start") - SLACK, "_to": upto + SLACK})


def by_command(shells: DataFrame, steps: DataFrame) -> DataFrame:
    """`shells` with `command_step`: the step whose command has the shell's hash.

    Of several: the one that was running when the shell began and ended first, else the latest that had begun; the first where it is not
    known when the shell began. Ties go to the smaller step of those running, to the larger of those that had begun. `shells` is read several times; commands
    are hashed once and written."""
    runs = written(_windows(steps.where("tool = 'Bash' and command is not null")).select(
        "trial_id", F.explode(command_hashes(F.col("command"))).alias("command_sha256"), "step_idx", "t_start", "_upto", "_from", "_to"))
    key = ["trial_id", "command_sha256"]
    of_hash = runs.groupBy(*key).agg(F.count("*").alias("_n"), F.min("step_idx").alias("_first"))
    known = shells.join(of_hash, key)
    sure = known.where("_n = 1 or started_at is null").select(*_SHELL, F.col("_first").alias("command_step"))
    timed = known.where("_n > 1 and started_at is not null").select(*_SHELL)
    met = interval(timed, runs, key, "started_at", "_from", "_to", CELL)
    running = met.groupBy(*_SHELL).agg(F.min(F.struct("_upto", "step_idx"))["step_idx"].alias("_running"))
    begun = runs.groupBy(*key, F.col("_from").alias("started_at")).agg(F.max("step_idx").alias("_begun"))
    before = _with(asof(timed, begun, key, "started_at", ["_begun"]), running, _SHELL, ["_running"])
    found = sure.unionByName(before.select(*_SHELL, F.coalesce("_running", "_begun").alias("command_step")))
    return _with(shells, found, _SHELL, ["command_step"])


def by_start(points: DataFrame, steps: DataFrame, key: Sequence[str], at: str, name: str, tool: Column) -> DataFrame:
    """(key, name): the points (trial_id, key, at) whose time lies in the window of exactly one step of the tool."""
    spans = _windows(steps.where(tool)).select("trial_id", F.col("step_idx").alias(name), "_from", "_to")
    return in_one_span(points.where(F.col(at).isNotNull()), spans, ["trial_id"], key, at, "_from", "_to", CELL, name)


def session_shells(events: DataFrame, shells: DataFrame) -> DataFrame:
    """(trial_id, event_id, pid, started_at, command_sha256): the latest shell whose pid is the event's session.

    A pid that was used again is another shell: where the event's process has a start, only shells begun by then (SLACK over) count. A shell
    whose start is not known counts as begun at the event, after any that began no later. Ties go to the smallest hash."""
    asked = events.where("sid is not null").select("trial_id", "event_id", "at", F.col("sid").alias("pid"), (F.coalesce("started_at", F.lit((1 << 62) - SLACK)) + SLACK).alias("_by"))
    dated = shells.where("started_at is not null").groupBy("trial_id", "pid", F.col("started_at").alias("_by")).agg(F.min("command_sha256").alias("_sha"))
    dated = dated.withColumn("_started", F.col("_by"))
    undated = shells.where("started_at is null").groupBy("trial_id", "pid").agg(F.min("command_sha256").alias("_undated"))
    rows = asof(asked, dated, ["trial_id", "pid"], "_by", ["_started", "_sha"]).join(undated, ["trial_id", "pid"], "left")
    late = F.col("_undated").isNotNull() & (F.col("_started").isNull() | (F.col("at") > F.col("_started")))
    rows = rows.where(F.col("_started").isNotNull() | F.col("_undated").isNotNull())
    return rows.select("trial_id", "event_id", "pid", F.when(~late, F.col("_started")).alias("started_at"), F.when(late, F.col("_undated")).otherwise(F.col("_sha")).alias("command_sha256"))


def attributed(events: DataFrame, steps: DataFrame) -> DataFrame:
    """`events` with `writer_step` and `mapped_by`: command, start_time, session or tool_window; both null where no rule has a step.

    events: trial_id, event_id (unique in a trial), at, agent (boolean), sid, started_at, origin_started (of the first process above that is
    not the container's own), shell (struct of pid, started_at, command_sha256; null for none). steps: trial_id, step_idx, tool, command,
    t_start, t_end. Times are microseconds. Rules in order: the shell's command; the one Bash step in whose window the shell began; both
    again for the session's shell; for the agent's own process without a shell the one writing tool that was at work; for other processes
    the one Bash step in whose window the outermost process began. Both tables are read several times; shells, and what is found for them, are written once."""
    bash, writing = F.col("tool") == "Bash", F.col("tool").isin(*patterns.WRITE_TOOLS)
    own = events.where("shell is not null").select("trial_id", "event_id", "shell.pid", "shell.started_at", "shell.command_sha256")
    shells = written(own.select(*_SHELL).distinct())
    found = written(_with(by_command(shells, steps), by_start(shells, steps, _SHELL, "started_at", "start_step", bash), _SHELL, ["start_step"]))

    def of(rows: DataFrame, command: str, start: str) -> DataFrame:
        both = _with(rows, found, _SHELL, ["command_step", "start_step"], "inner")
        return both.select("trial_id", "event_id", F.col("command_step").alias(command), F.col("start_step").alias(start))

    key = ["trial_id", "event_id"]
    alone = by_start(events.where("agent and shell is null").select(*key, "at"), steps, key, "at", "_tool", writing)
    origin = events.where("not coalesce(agent, false)").select(*key, F.coalesce("origin_started", "started_at").alias("_began"))
    rows = events.join(of(own, "_command", "_start"), key, "left").join(of(session_shells(events, found), "_session", "_session_start"), key, "left")
    rows = rows.join(alone, key, "left").join(by_start(origin, steps, key, "_began", "_origin", bash), key, "left")
    ladder = [("command", "_command"), ("start_time", "_start"), ("session", "_session"), ("session", "_session_start"), ("tool_window", "_tool"), ("start_time", "_origin")]
    return rows.select(*events.columns, F.coalesce(*[F.col(c) for _, c in ladder]).alias("writer_step"), F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(rule)) for rule, c in ladder]).alias("mapped_by"))
