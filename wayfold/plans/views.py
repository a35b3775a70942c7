"""The six derived views: each a function from the record tables to a DataFrame.

Every view is a function of one trial's rows. Values per trial or path come from combined aggregates joined
back, not from windows over a whole trial, wherever an aggregate can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import patterns as P

Tables = dict[str, DataFrame]


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def is_call(tool: str = "tool") -> Column:
    return F.coalesce(~F.col(tool).isin(*P.STOP_TOOLS), F.lit(False))


def step_flags(t: Tables) -> DataFrame:
    touched = t["deltas"].groupBy("trial_id", "step_idx").agg(
        F.count("*").alias("files_touched"), F.count_if(~F.col("path").rlike(P.CACHE_PATH)).alias("own"))
    command = F.coalesce(F.get_json_object("args_json", "$.command"), F.lit(""))
    took = micros("t_end") - micros("t_start")
    calls = t["steps"].join(touched, ["trial_id", "step_idx"], "left").select(
        "trial_id", "step_idx", is_call().alias("is_tool_call"), F.coalesce("files_touched", F.lit(0)).alias("files_touched"),
        (F.coalesce("own", F.lit(0)) > 0).alias("changed"),
        (F.coalesce("is_error", F.lit(False)) | F.coalesce("output", F.lit("")).rlike(P.ERROR_MARKER)).alias("error"),
        F.coalesce(took > P.IDLE_SECONDS * 1_000_000, F.lit(False)).alias("slow"),
        F.coalesce((F.col("tool") == "Bash") & command.rlike(P.TEST_COMMAND), F.lit(False)).alias("tests"))
    call, changed = F.col("is_tool_call"), F.col("changed")
    last = calls.groupBy("trial_id").agg(F.coalesce(F.max(F.when(call & changed, F.col("step_idx"))), F.lit(0)).alias("last"))
    return calls.join(last, "trial_id").select(
        "trial_id", "step_idx", "is_tool_call", "files_touched", (call & changed).alias("is_mutating"), (call & F.col("error")).alias("has_error_marker"),
        (call & ~changed & (F.col("step_idx") > F.col("last"))).alias("is_tail_probe"), (call & ~changed & F.col("slow")).alias("is_idle_wait"),
        (call & F.col("tests")).alias("is_test_command"))


def prompt_paths(trials: DataFrame, strip: bool = True) -> DataFrame:
    """(trial_id, path): the distinct paths that each prompt names."""
    paths = F.regexp_extract_all("prompt", F.lit(P.PROMPT_PATH), F.lit(0))
    if strip:
        paths = F.transform(F.filter(paths, lambda p: ~p.startswith("//")), lambda p: F.regexp_replace(p, r"/+\z", ""))
    return trials.select("trial_id", F.explode(F.array_distinct(paths)).alias("path"))


def script_adds(deltas: DataFrame) -> DataFrame:
    """(trial_id, step_idx, path, lines): scripts as first written; lines are distinct, trimmed and not empty."""
    added = F.filter(F.split("hunk", "\n", -1), lambda x: x.startswith("+") & ~x.startswith("+++"))
    lines = F.array_distinct(F.filter(F.transform(added, lambda x: F.trim(F.substring(x, 2, 1 << 30))), lambda x: x != ""))
    rows = deltas.where((F.col("op") == "add") & F.col("path").rlike(P.SCRIPT_PATH) & ~F.col("path").rlike(P.CACHE_PATH))
    return rows.select("trial_id", "step_idx", "path", lines.alias("lines"))


def script_variants(adds: DataFrame) -> DataFrame:
    """(trial_id, step_idx, path, variant_of): overlap is counted by an equal join on single lines."""
    lines = adds.select("trial_id", "step_idx", "path", F.size("lines").alias("n"), F.explode("lines").alias("line"))
    earlier = lines.select("trial_id", "line", F.col("step_idx").alias("e_step"), F.col("path").alias("e_path"))
    shared = lines.where(F.col("n") >= P.VARIANT_MIN_LINES).join(earlier, ["trial_id", "line"]).where("e_step < step_idx")
    shared = shared.groupBy("trial_id", "step_idx", "path", "n", "e_step", "e_path").agg(F.count("*").alias("common"))
    best = F.min(F.struct((-F.col("common")).alias("c"), F.col("e_step"), F.col("e_path")))
    return shared.where(F.col("common") >= P.VARIANT_OVERLAP * F.col("n")).groupBy("trial_id", "step_idx", "path").agg(best["e_path"].alias("variant_of"))


def delta_flags(t: Tables) -> DataFrame:
    deltas, key = t["deltas"], ["trial_id", "step_idx", "path"]
    changes = ~F.col("sha256_before").eqNullSafe(F.col("sha256_after"))
    # The first step that changed a path away from a content: going back to that content later is a revert.
    left = deltas.where(changes & F.col("sha256_before").isNotNull()).groupBy("trial_id", "path", F.col("sha256_before").alias("sha256_after")).agg(F.min("step_idx").alias("left_at"))
    named = prompt_paths(t["trials"]).select("trial_id", "path", F.lit(True).alias("named")).distinct()
    adds = script_adds(deltas)
    version = F.row_number().over(Window.partitionBy("trial_id", "path").orderBy("step_idx")).cast("long")
    rows = deltas.select(*key, "sha256_before", "sha256_after", version.alias("version"))
    rows = rows.join(left, ["trial_id", "path", "sha256_after"], "left").join(named, ["trial_id", "path"], "left")
    rows = rows.join(adds.select(*key, F.lit(True).alias("script")), key, "left").join(script_variants(adds), key, "left")
    return rows.select(
        *key, F.col("path").rlike(P.CACHE_PATH).alias("is_cache"), F.coalesce("named", F.lit(False)).alias("names_prompt_path"), "version",
        (F.col("sha256_after").isNotNull() & changes & F.coalesce(F.col("left_at") < F.col("step_idx"), F.lit(False))).alias("is_revert"),
        F.coalesce("script", F.lit(False)).alias("is_script_add"), "variant_of")


def path_versions(t: Tables, flags: DataFrame | None = None) -> DataFrame:
    flags = delta_flags(t) if flags is None else flags
    rows = t["deltas"].join(flags, ["trial_id", "step_idx", "path"])
    steps = F.array_sort(F.collect_list("step_idx"))
    return rows.groupBy("trial_id", "path").agg(
        F.count("*").alias("versions"), steps.alias("steps"), F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"),
        F.max_by(F.struct("op"), "step_idx")["op"].alias("last_op"), F.max_by(F.struct("hunk"), "step_idx")["hunk"].alias("last_hunk"),
        F.bool_or("is_cache").alias("is_cache"), F.bool_or("names_prompt_path").alias("names_prompt_path"))


def trial_summary(t: Tables, steps: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    steps = step_flags(t) if steps is None else steps
    flags = delta_flags(t) if flags is None else flags
    at = F.col("step_idx")
    calls = steps.groupBy("trial_id").agg(
        F.count_if("is_tool_call").alias("tool_calls"), F.count_if("is_mutating").alias("mutating_calls"), F.min(F.when(F.col("has_error_marker"), at)).alias("first_error_step"),
        F.max(F.when(F.col("is_mutating"), at)).alias("last_mutating_step"), F.count_if("is_tail_probe").alias("tail_probes"), F.count_if("is_idle_wait").alias("idle_waits"),
        F.max(F.when(F.col("is_test_command"), F.struct(at, "has_error_marker"))).alias("test"))
    paths = flags.groupBy("trial_id").agg(
        F.countDistinct(F.when(F.col("is_script_add"), F.col("path"))).alias("scripts_added"), F.count("variant_of").alias("script_variants"), F.count_if("names_prompt_path").alias("prompt_path_versions"))
    said = t["steps"].where((F.col("source") == "agent") & (F.trim(F.coalesce("message", F.lit(""))) != ""))
    said = said.groupBy("trial_id").agg(F.max_by("message", "step_idx").alias("message"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    claims = F.coalesce(F.col("message").rlike(P.SUCCESS_CLAIM) & ~F.col("message").rlike(P.NOT_DONE), F.lit(False))
    unchecked = F.col("test").isNull() | (F.col("test.step_idx") < F.coalesce("last_mutating_step", F.lit(0))) | F.col("test.has_error_marker")
    rows = t["trials"].select("trial_id").join(calls, "trial_id", "left").join(paths, "trial_id", "left").join(said, "trial_id", "left")
    return rows.select(
        "trial_id", zero("tool_calls"), zero("mutating_calls"), "first_error_step", "last_mutating_step", zero("tail_probes"), zero("idle_waits"),
        zero("scripts_added"), zero("script_variants"), zero("prompt_path_versions"), (claims & unchecked).alias("unverified_completion"))


def step_jobs(t: Tables) -> DataFrame:
    steps = t["steps"]
    ended = F.max(F.coalesce("t_end", "t_start"))
    ends = steps.groupBy("trial_id").agg(F.greatest(ended, F.max("checkpoint_at")).alias("trial_end"))
    shell = F.col("tool") == "Bash"
    calls = steps.where(is_call()).join(t["job_notices"].select("trial_id", "tool_call_id", "status", "noticed_at"), ["trial_id", "tool_call_id"], "left")
    calls = calls.select(
        "trial_id", "step_idx", (shell & F.coalesce("output", F.lit("")).rlike(P.BACKGROUNDED)).alias("backgrounded"), F.regexp_extract("output", P.BACKGROUNDED, 1).alias("task"),
        (shell & F.coalesce("command_shell", F.lit("")).rlike(P.JOB_LAUNCH)).alias("launches_job"), "status", "noticed_at")
    # The first step at or after each notice: notices and steps in one order of time, from the end.
    waits = calls.where("backgrounded and noticed_at is not null").select("trial_id", F.col("noticed_at").alias("at"), F.col("step_idx").alias("of"), F.lit(None).cast("int").alias("step"))
    both = waits.unionByName(steps.where("t_start is not null").select("trial_id", F.col("t_start").alias("at"), F.lit(None).cast("int").alias("of"), F.col("step_idx").alias("step")))
    onward = Window.partitionBy("trial_id").orderBy(F.desc("at"), F.col("of").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("done", F.min("step").over(onward)).where("of is not null").select("trial_id", F.col("of").alias("step_idx"), F.col("done"))
    rows = calls.join(ends, "trial_id").join(found, ["trial_id", "step_idx"], "left")
    behind = lambda c, name: F.when(F.col("backgrounded"), c).alias(name)
    return rows.select(
        "trial_id", "step_idx", "backgrounded", behind(F.col("task"), "task_id"), behind(F.col("status"), "job_status"),
        behind(F.coalesce("noticed_at", "trial_end"), "job_end"), behind(F.col("done"), "background_done_step"), "launches_job")


def quoted(c: Column) -> Column:
    """A pattern for the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def stands_whole(text: Column, name: Column, before: str = P.NAME_BEFORE, after: str = P.NAME_AFTER) -> Column:
    return F.rlike(text, F.concat(F.lit(before), quoted(name), F.lit(after)))


def redirects_into(command: Column, base: Column) -> Column:
    """Whether a redirect of the command has `base` as its last part; a shell variable stands for any text."""
    def fits(target: Column) -> Column:
        last = F.regexp_extract(target, r"[^/]+\z", 0)
        plain = F.transform(F.split(last, P.SHELL_VARIABLE, -1), quoted)
        return F.rlike(base, F.concat(F.lit("(?d)^"), F.array_join(plain, ".*"), F.lit(r"\z")))

    return F.exists(F.regexp_extract_all(command, F.lit(P.REDIRECT_TARGET), F.lit(1)), fits)


def delta_attribution(t: Tables, jobs: DataFrame | None = None) -> DataFrame:
    steps, key = t["steps"], ["trial_id", "step_idx", "path"]
    second = F.expr("interval 1 second")
    jobs = (step_jobs(t) if jobs is None else jobs).where("backgrounded or launches_job")
    jobs = jobs.join(steps.select("trial_id", "step_idx", "t_start", F.coalesce("args_json", F.lit("")).alias("args")), ["trial_id", "step_idx"]).select(
        "trial_id", F.col("step_idx").alias("launcher"), F.col("t_start").alias("launched_at"), "backgrounded", "job_end", F.col("args").alias("command"),
        F.coalesce(F.get_json_object("args", "$.command"), F.lit("")).alias("words"))
    facts = steps.groupBy("trial_id").agg(F.min("t_start").alias("trial_start"))
    first_job = jobs.groupBy("trial_id").agg(F.min("launcher").alias("first_job"))
    parent = F.regexp_extract("path", r"(?s)^(.*)/[^/]*\z", 1)
    base = F.regexp_extract("path", r"[^/]+\z", 0)
    end = F.coalesce("checkpoint_at", "t_end", "t_start")
    write_at = F.when(F.col("op") != "delete", F.col("mtime_after"))
    landed = t["deltas"].join(steps, ["trial_id", "step_idx"]).join(facts, "trial_id").join(first_job, "trial_id", "left")
    landed = landed.select(
        *key, write_at.alias("write_at"), base.alias("base"), parent.alias("parent"), "trial_start", F.coalesce(F.col("first_job") < F.col("step_idx"), F.lit(False)).alias("after_a_job"),
        (F.col("tool").isin(*P.WRITE_TOOLS) | F.coalesce("command_shell", F.lit("")).contains(">") | (F.coalesce("args_json", F.lit("")).contains(base))).alias("lands_it"),
        F.coalesce((write_at + second > F.col("t_start")) & (write_at <= end), F.lit(False)).alias("in_landing_window"))
    # Open jobs at the time of the write: equal on the trial, a range on time.
    met = landed.where("write_at is not null").join(jobs, "trial_id").where(
        (F.col("launcher") < F.col("step_idx")) & (F.col("launched_at") <= F.col("write_at") + second) & (F.col("job_end").isNull() | (F.col("write_at") <= F.col("job_end"))))
    deep = F.length("parent") - F.length(F.replace("parent", F.lit("/"), F.lit(""))) >= 2
    met = met.withColumns({
        "redirects": redirects_into(F.col("command"), F.col("base")), "names": stands_whole(F.col("words"), F.col("base")),
        "names_dir": deep & stands_whole(F.col("words"), F.col("parent"), P.DIR_BEFORE, P.DIR_AFTER)})
    best = met.groupBy(*key).agg(F.max(F.struct("redirects", "names", "names_dir", "launcher", "backgrounded")).alias("best"), F.max("launcher").alias("latest"))
    rows = landed.join(best, key, "left")
    launcher, window, b = F.col("best.launcher"), F.col("in_landing_window"), F.col("best")
    evidence = b["redirects"] | b["names"] | b["names_dir"]
    how = F.when(~b["backgrounded"], "background_untracked").when(launcher == F.col("latest"), "background").otherwise("background_by_path")
    named = (
        F.when(F.col("write_at").isNull(), "unknown")
        .when(window & (launcher.isNull() | ~evidence), "foreground")
        .when(launcher.isNotNull() & (~window | (b["redirects"] & ~F.col("lands_it"))), how)
        .when(launcher.isNotNull(), "contested")
        .when(F.col("write_at") < F.col("trial_start"), "untrusted_mtime")
        .otherwise("unknown"))
    rows = rows.withColumn("rule", named)
    step = (
        F.when(F.col("rule") == "foreground", F.col("step_idx")).when(F.col("rule").startswith("background"), launcher)
        .when((F.col("rule") == "untrusted_mtime") & ~F.col("after_a_job"), F.col("step_idx")))
    written = t["writes"].groupBy(*key).agg(F.sort_array(F.collect_set("writer_step")).alias("writer_steps"))
    rows = rows.withColumn("rule_step", step).join(written, key, "left")
    writers = F.coalesce(F.size("writer_steps"), F.lit(0))
    cause = F.when(writers == 1, F.element_at("writer_steps", 1)).when(writers == 0, F.col("rule_step"))
    rows = rows.withColumn("launched_by_step", cause)
    return rows.select(
        *key, "write_at", "in_landing_window", launcher.alias("launcher_step"), F.when(writers == 1, "recorded").when(writers > 1, "multi_writer").otherwise(F.col("rule")).alias("attribution"),
        "launched_by_step", F.coalesce("launched_by_step", "step_idx").alias("causal_step"), F.coalesce(F.col("launched_by_step") < F.col("step_idx"), F.lit(False)).alias("is_late"),
        "writer_steps", F.col("rule").alias("rule_attribution"), F.coalesce("rule_step", "step_idx").alias("rule_causal_step"))


VIEWS = {
    "step_flags": step_flags, "delta_flags": delta_flags, "path_versions": path_versions,
    "trial_summary": trial_summary, "step_jobs": step_jobs, "delta_attribution": delta_attribution,
}
