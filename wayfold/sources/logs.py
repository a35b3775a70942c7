"""Event logs, trajectory documents and text dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl_strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines of a given schema; a bad line fails the query and names its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the lines that read, and those that do not with their file."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("_file"))
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = lines.select("value", "_file", read.alias("r"))
    return raw.where("r._bad is null").select("r.*").drop("_bad"), raw.where("r._bad is not null").select("_file", F.col("value").alias("_bad"))


def jsonl_objects(spark: SparkSession, path: str) -> DataFrame:
    """(line, keys): raw objects and their keys, for checks of unknown keys."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.json_object_keys("value").alias("keys"))


def unknown_keys(objects: DataFrame, known: list[str]) -> DataFrame:
    return objects.select("line", F.explode(F.array_except("keys", F.array(*[F.lit(k) for k in known]))).alias("key"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: later ones are retries."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def session_events(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Events of all session files below `root`, with file and session; malformed lines are skipped."""
    raw = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root)
    file = F.col("_metadata.file_path")
    return raw.select("*", file.alias("file"), F.regexp_extract(file, r"([^/]+)\.jsonl\z", 1).alias("session")).where("_bad is null").drop("_bad")


def compactions(events: DataFrame) -> DataFrame:
    """Boundary events, one per uuid, with the summary event whose parent they are, in order of time."""
    edges = events.where("subtype = 'compact_boundary'").dropDuplicates(["uuid"])
    summaries = events.where("is_summary").groupBy(F.col("parent_uuid").alias("uuid")).agg(F.min_by("message", "timestamp").alias("summary"))
    return edges.join(summaries, "uuid", "left").orderBy("timestamp", "uuid")


#: Parts of a queued notice of a background job (fixed values).
TASK_ID, TOOL_USE_ID, TASK_STATUS = r"<task-id>([^<]+)</task-id>", r"<tool-use-id>([^<]+)</tool-use-id>", r"<status>([^<]+)</status>"


def job_notices(events: DataFrame) -> DataFrame:
    """(trial_id, task_id, tool_call_id, status, noticed_at) from queue events (trial_id, content, timestamp): the first of each task.

    A line without a task id is left out before it is taken apart; so is one whose time has no zone."""
    rows = events.where(F.col("content").contains("<task-id>") & F.col("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)\z"))
    part = lambda p: F.regexp_extract("content", p, 1)
    rows = rows.select("trial_id", part(TASK_ID).alias("task_id"), part(TOOL_USE_ID).alias("tool_call_id"), part(TASK_STATUS).alias("status"), F.to_timestamp("timestamp").alias("noticed_at"))
    return first_per_key(rows.where("tool_call_id <> ''"), ["trial_id", "task_id"], ["noticed_at"])


def trajectories(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents of a schema, one file each; a document of another shape fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def trajectory_errors(documents: DataFrame) -> DataFrame:
    """(trial_id, errors): everything wrong with a document's steps, nothing repaired."""
    s = F.col("steps")
    ids = F.transform(s, lambda x: x["step_id"])
    calls = F.flatten(F.transform(s, lambda x: F.coalesce(F.transform(x["tool_calls"], lambda c: c["tool_call_id"]), F.array().cast("array<string>"))))
    answered = F.flatten(F.transform(s, lambda x: F.coalesce(F.transform(x["observation"]["results"], lambda r: r["source_call_id"]), F.array().cast("array<string>"))))
    errors = F.array_compact(F.array(
        F.when(s.isNull() | (F.size(s) == 0), F.lit("no steps")),
        F.when(~F.coalesce(F.forall(s, lambda x: x["step_id"].isNotNull() & x["source"].isin("user", "agent", "system")), F.lit(True)), F.lit("a step without id or known source")),
        F.when(ids != F.transform(ids, lambda _, i: i + 1), F.lit("step ids are not 1, 2, ...")),
        F.when(F.size(calls) != F.size(F.array_distinct(calls)), F.lit("a call id occurs twice")),
        F.when(F.size(F.array_except(answered, calls)) > 0, F.lit("a result answers no call"))))
    return documents.select("trial_id", errors.alias("errors")).where(F.size("errors") > 0)


def listing(raw: Column) -> Column:
    """NUL-separated listing, eight fields an entry, as array of struct (path, kind, size, mode, owner, group, mtime, target)."""
    names = ["path", "kind", "size", "mode", "owner", "group", "mtime", "target"]
    fields = F.split(raw, "\\x00", -1)
    n = F.floor(F.size(fields) / len(names)).cast("int")
    entry = lambda i: F.struct(*[F.get(fields, i * len(names) + k).alias(name) for k, name in enumerate(names)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), entry)).otherwise(F.array())


def process_probe(raw: Column) -> Column:
    """Text of a process probe, one `pid ppid command` a line, as array of struct (pid, ppid, cmd); other lines are dropped."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+(.*\S)\s*\z"
    lines = F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(pattern))
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).cast("int").alias("pid"), part(x, 2).cast("int").alias("ppid"), part(x, 3).alias("cmd")))


def process_delta(snapshots: DataFrame) -> DataFrame:
    """(trial_id, call_seq, change, cmd, n): processes started and stopped since the snapshot before, by command, as multisets."""
    order = snapshots.select("trial_id", "call_seq", F.lead("call_seq").over(Window.partitionBy("trial_id").orderBy("call_seq")).alias("next"))
    each = snapshots.select("trial_id", "call_seq", F.explode("processes").alias("p")).groupBy("trial_id", "call_seq", F.col("p.cmd").alias("cmd")).agg(F.count("*").alias("n"))
    was = each.join(order.where("next is not null"), ["trial_id", "call_seq"]).select("trial_id", F.col("next").alias("call_seq"), "cmd", (-F.col("n")).alias("n"))
    first = order.groupBy("trial_id").agg(F.min("call_seq").alias("first"))
    net = each.unionByName(was).groupBy("trial_id", "call_seq", "cmd").agg(F.sum("n").alias("n")).join(first, "trial_id").where("n <> 0 and call_seq > first")
    return net.select("trial_id", "call_seq", F.when(F.col("n") > 0, "started").otherwise("stopped").alias("change"), "cmd", F.abs("n").alias("n"))


def verifier_checks(ctrf: DataFrame | None = None, traces: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """(trial_id, kind, check, status, value, message) of three kinds of verifier output.

    ctrf: (trial_id, results.tests); traces: (trial_id, trace_id, passed, error); details: (trial_id, score, combined_raw)."""
    parts, null = [], F.lit(None)
    columns = lambda kind, check, status, value, message: [F.col("trial_id"), F.lit(kind).alias("kind"), check.alias("check"), status.alias("status"), value.cast("double").alias("value"), F.left(message.cast("string"), F.lit(500)).alias("message")]
    if ctrf is not None:
        t = ctrf.select("trial_id", F.posexplode("results.tests").alias("at", "t"))
        again = F.count("*").over(Window.partitionBy("trial_id", "t.name"))
        nth = F.row_number().over(Window.partitionBy("trial_id", "t.name").orderBy("at"))
        t = t.withColumn("name", F.when(again > 1, F.concat("t.name", F.lit("#"), nth)).otherwise(F.col("t.name")))
        parts.append(t.select(*columns("pytest", F.col("name"), F.col("t.status"), null, F.col("t.message"))))
    if traces is not None:
        parts.append(traces.select(*columns("trace", F.col("trace_id"), F.when(F.col("passed"), "passed").otherwise("failed"), null, F.col("error"))))
    if details is not None:
        parts.append(details.select(*columns("cad", F.lit("score"), F.when(F.col("score") == 1, "passed").otherwise("failed"), F.coalesce("combined_raw", "score"), null)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trial_rows(results: DataFrame) -> DataFrame:
    """The trials row of each finished run's result document (with its prompt, attempt_idx and parent)."""
    started, finished = F.to_timestamp("started_at"), F.to_timestamp("finished_at")
    model = F.coalesce(F.concat_ws("/", "agent_info.model_info.provider", "agent_info.model_info.name"), F.col("config.agent.model_name"))
    return results.select(
        F.lower("id").alias("trial_id"), "trial_name", F.col("task_name").alias("task"), F.coalesce("attempt_idx", F.lit(0)).alias("attempt_idx"), "parent_trial_id", "prompt",
        F.when(model == "", F.col("config.agent.model_name")).otherwise(model).alias("model"), F.col("agent_info.name").alias("harness"), F.col("agent_info.version").alias("harness_version"),
        F.col("verifier_result.rewards.reward").alias("reward"), F.col("agent_result.n_input_tokens").alias("tokens_in"), F.col("agent_result.n_output_tokens").alias("tokens_out"),
        F.col("agent_result.cost_usd").alias("cost_usd"), F.floor((F.unix_micros(finished) - F.unix_micros(started)) / 1000).cast("long").alias("wall_ms"))


def jobs_tree(spark: SparkSession, root: str, marker: str = "result.json") -> DataFrame:
    """(job, trial, path): directories below `root` that hold a `marker` file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker).load(root).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -3).alias("job"), F.element_at(parts, -2).alias("trial"), "path")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of every file below `root`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(F.col("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
