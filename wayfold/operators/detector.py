"""Failure patterns of tool calls, as joins and regular expressions over the record tables.

Each flag depends only on the rows of its trial up to its step, so flags of the first N steps are the same
whether later steps are there or not. The command text is read with patterns, not parsed: what quoting or
nesting hides is not flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import patterns as P
from wayfold.plans.views import Tables, is_call, prompt_paths, step_flags

#: Exit codes of a shell that was killed (fixed values).
KILLED = (143, 144)
#: Lines that show a crash (fixed values): an exception's line, which counts after a traceback only, and lines that count anywhere.
TRACEBACK = "Traceback (most recent call last)"
EXCEPTION = r"^(?:[\w.]+\.)?(\w*(?:Error|Exception|Exit)): "
CRASH = (
    r"^\s*(?:SyntaxError|IndentationError|TabError): |can't open file .*\[Errno 2\]|Segmentation fault|core dumped|^npm ERR! "
    r"|^\S+:\d+:\d+: (?:fatal )?error: |^make(?:\[\d+\])?: \*\*\* "
)
#: The exception that is no crash, output cut off by its reader; what a probe for modules may say, and the statements of one (fixed values).
NO_CRASH = "BrokenPipeError"
PROBE_ANSWER = r"^(?:[\w.]+\.)?(?:ModuleNotFoundError|ImportError): "
PROBE_CODE = r"python[\d.]*\s+-c\s+([\"'])(.*?)\1"
PROBE_STATEMENT = r"^\s*(?:import\s+[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*|from\s+[\w.]+\s+import\s+[\w\s,*()]+|print\([\w.,\s]*\)|)\s*$"
KILL_BY_PATTERN = r"\b(?:pkill|pgrep)\s+(?:-[A-Za-z0-9]+\s+)*-\w*f\w*\s+(?:-[A-Za-z0-9]+\s+)*(?:\"([^\"]+)\"|'([^']+)'|([^\s;|&)]+))"
REDIRECT = r"(?:^|[^0-9&>])>>?\s*(/[^\s;&|()\"']+)"


def exit_code() -> Column:
    """The code an output tells: its [exit_code] line, its `Exit code N`, else 0 for a call that is no error."""
    told = [F.regexp_extract("output", p, 1) for p in (r"(?dm)^\[exit_code\] (-?\d+)", r"(?dm)^Exit code (-?\d+)")]
    return F.coalesce(*[F.when(c != "", c.cast("int")) for c in told], F.when(~F.coalesce("is_error", F.lit(False)), F.lit(0)))


def command() -> Column:
    return F.coalesce(F.get_json_object("args_json", "$.command"), F.lit(""))


def _flag(rows: DataFrame, pattern: str, subtype: Column | None, detail: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("trial_id", "step_idx", F.lit(pattern).alias("pattern"), (none if subtype is None else subtype).alias("subtype"), detail.alias("detail"))


def self_kill(t: Tables) -> DataFrame:
    """A kill by pattern whose pattern is in the call's own command, on a call that was killed."""
    sought = F.coalesce(*[F.nullif(F.regexp_extract(command(), KILL_BY_PATTERN, i), F.lit("")) for i in (1, 2, 3)])
    rows = t["steps"].where((F.col("tool") == "Bash") & exit_code().isin(*KILLED)).withColumn("sought", sought)
    return _flag(rows.where("sought is not null"), "self_kill", None, F.col("sought"))


def crash_lines(output: Column) -> Column:
    """The lines of an output that show a crash, in order. A traceback without any exception's line is one itself; one whose only exception
    is a broken pipe is none."""
    lines = F.split(F.coalesce(output, F.lit("")), "\n", -1)
    traced = F.coalesce(output.contains(TRACEBACK), F.lit(False))
    raised = lambda x: x.rlike(EXCEPTION)
    bare = traced & ~F.exists(lines, raised)
    shows = lambda x: x.rlike(CRASH) | (traced & raised(x) & (F.regexp_extract(x, EXCEPTION, 1) != NO_CRASH)) | (bare & x.contains(TRACEBACK))
    return F.transform(F.filter(lines, shows), lambda x: F.when(bare & x.contains(TRACEBACK), TRACEBACK).otherwise(F.btrim(x, F.lit(" \t\r\x0b\x0c"))))


def _probes(command: Column) -> Column:
    """Whether a command is Python code given in place that only imports modules and prints."""
    code = F.regexp_extract(command, PROBE_CODE, 2)
    return (code != "") & F.forall(F.split(code, "[;\n]", -1), lambda x: x.rlike(PROBE_STATEMENT))


def masked_error(t: Tables) -> DataFrame:
    """A call that exits 0 and shows a crash; that a module is not there is the answer to a probe for it."""
    shown = F.filter(crash_lines(F.col("output")), lambda x: ~(_probes(command()) & x.rlike(PROBE_ANSWER)))
    rows = t["steps"].where((F.col("tool") == "Bash") & (exit_code() == 0)).withColumn("line", F.get(shown, F.lit(0)))
    return _flag(rows.where("line is not null"), "masked_error", None, F.left("line", F.lit(300)))


def silent_no_write(t: Tables) -> DataFrame:
    """A call that exits 0, was to write a file, and left it as it was; later steps may still say otherwise."""
    target = F.when(F.col("tool").isin(*P.WRITE_TOOLS), F.array(F.get_json_object("args_json", "$.file_path"))).otherwise(F.regexp_extract_all(command(), F.lit(REDIRECT), F.lit(1)))
    background = command().rlike(P.JOB_LAUNCH) | F.coalesce("output", F.lit("")).rlike(P.BACKGROUNDED)
    rows = t["steps"].where(is_call() & (exit_code() == 0) & ~background).select("trial_id", "step_idx", "tool", F.explode(F.array_distinct(target)).alias("path"))
    rows = rows.where("path like '/%' and path not like '/dev/%'").join(t["deltas"].select("trial_id", "step_idx", "path"), ["trial_id", "step_idx", "path"], "left_anti")
    return _flag(rows, "silent_no_write", F.when(F.col("tool") == "Bash", "quiet").otherwise("tool"), F.col("path"))


def missing_output(t: Tables) -> DataFrame:
    """At the trial's last step: files the prompt names that the trial never wrote, or deleted last."""
    last = t["steps"].groupBy("trial_id").agg(F.max("step_idx").alias("step_idx"))
    named = prompt_paths(t["trials"]).where(F.regexp_extract("path", r"[^/]+\z", 0).contains("."))
    state = t["deltas"].groupBy("trial_id", "path").agg(F.max_by("op", "step_idx").alias("op"))
    rows = named.join(state, ["trial_id", "path"], "left").where("op is null or op = 'delete'").join(last, "trial_id")
    return _flag(rows, "missing_output", F.when(F.col("op").isNull(), "never_written").otherwise("deleted"), F.col("path"))


def unverified_completion(t: Tables) -> DataFrame:
    """At the last step of a trial that changed files: no test after its last change, or that test failed."""
    flags = step_flags(t)
    last = F.max("step_idx").alias("step_idx")
    per = flags.groupBy("trial_id").agg(last, F.max(F.when(F.col("is_mutating"), F.col("step_idx"))).alias("change"), F.max(F.when(F.col("is_test_command"), F.struct("step_idx", "has_error_marker"))).alias("test"))
    tested = F.coalesce(F.col("test.step_idx") > F.col("change"), F.lit(False))
    rows = per.where(F.col("change").isNotNull()).where(~tested | F.col("test.has_error_marker"))
    return _flag(rows, "unverified_completion", F.when(tested, "last_test_failed").otherwise("no_test"), F.col("change").cast("string"))


PATTERNS = {
    "self_kill": self_kill, "masked_error": masked_error, "silent_no_write": silent_no_write, "missing_output": missing_output, "unverified_completion": unverified_completion,
}


def flags(t: Tables) -> DataFrame:
    """(trial_id, step_idx, pattern, subtype, detail) of all patterns."""
    parts = [f(t) for f in PATTERNS.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeats(t: Tables) -> DataFrame:
    """(trial_id, step_idx, before, times, changed_since): each call against the last one with the same command.

    changed_since: whether a call in between changed a file, from running counts of changes."""
    f = step_flags(t).select("trial_id", "step_idx", "is_mutating")
    rows = t["steps"].where(is_call()).join(f, ["trial_id", "step_idx"]).withColumn("key", F.concat_ws(" ", "tool", F.regexp_replace(F.coalesce("args_json", F.lit("")), r"\s+", " ")))
    upto = Window.partitionBy("trial_id").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("trial_id", "key").orderBy("step_idx")
    rows = rows.withColumn("done", F.coalesce(F.count_if("is_mutating").over(upto), F.lit(0)))
    rows = rows.select("trial_id", "step_idx", F.lag("step_idx").over(same).alias("before"), F.row_number().over(same).alias("times"), (F.col("done") > F.lag("done").over(same)).alias("changed_since"))
    return rows.where("before is not null")
