"""The record tables made from the event tables of a scale-factor folder, and the same as SQL.

One user of `events` is one trial; its events in time order are its calls. Signups and purchases change
files, clicks start jobs in the background, errors fail, are killed or are rejected, and some views show a crash. The last step is a message of the agent."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def later(ts, micros):
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").cast("string").alias("trial_id"), F.row_number().over(order).alias("step_idx"), "event_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _path():
    return F.concat(F.lit("/k/"), F.col("k") % 10, F.when(F.col("k") % 7 == 0, "/__pycache__/a.pyc").otherwise(".py"))


def _micros():
    return F.floor(F.col("value") * 1_000_000).cast("long")


def steps(e: DataFrame) -> DataFrame:
    path, kind, micros = _path(), F.col("event_type"), _micros()
    tool = F.when(kind == "signup", "Write").when(kind == "purchase", "Edit").otherwise("Bash")
    command = (
        F.when(kind == "view", F.when(F.col("k") % 3 == 0, F.concat(F.lit("pytest -q /k/"), F.col("k") % 10)).otherwise(F.concat(F.lit("cat /k/"), F.col("k") % 10, F.lit(".py"))))
        .when(kind == "click", F.concat(F.lit("python run.py > "), path, F.when(F.col("k") % 2 == 0, " &").otherwise("")))
        .when((kind == "error") & (F.col("k") % 5 == 0), "pkill -f run.py; python run.py")
        .when(kind == "error", F.concat(F.lit("make test-"), F.col("k") % 5))
    )
    trace = F.concat(F.lit("start\nTraceback (most recent call last):\n  File \"x.py\", line 1\n"), F.when(F.col("k") % 2 == 0, "BrokenPipeError: pipe").otherwise(F.concat(F.lit("ValueError: bad "), "k")))
    output = F.when((kind == "error") & (F.col("k") % 5 == 0), F.lit("Exit code 144\nkilled")).when((kind == "error") & (F.col("k") % 5 == 1), F.lit("<tool_use_error>no such file"))
    output = output.when((kind == "view") & (F.col("k") % 11 == 4), trace).when((kind == "view") & (F.col("k") % 11 == 5), F.concat(F.lit("a.c:3:"), "k", F.lit(": error: x\n")))
    output = output.when(kind == "error", F.lit("Exit code 1\nboom")).when((kind == "click") & (F.col("k") % 4 == 1), F.concat(F.lit("Command running in background with ID: b"), "event_id")).otherwise("ok")
    argument = F.when(command.isNotNull(), F.concat(F.lit('{"command": "'), command, F.lit('"}'))).otherwise(F.concat(F.lit('{"file_path": "'), path, F.lit('"}')))
    calls = e.select(
        "trial_id", "step_idx", F.lit("agent").alias("source"), F.concat(F.lit("c"), "event_id").alias("tool_call_id"), tool.alias("tool"), argument.alias("args_json"),
        output.alias("output"), (kind == "error").alias("is_error"), F.col("at").alias("t_start"), later("at", micros).alias("t_end"),
        later("at", micros + 3_000_000).alias("checkpoint_at"), command.alias("command_shell"))
    last = calls.groupBy("trial_id").agg(F.max("step_idx").alias("n"))
    third = F.col("trial_id").cast("int") % 3
    said = F.when(third == 0, "All tests pass, done.").when(third == 1, "It does not work.").otherwise("Looking around")
    messages = last.select("trial_id", (F.col("n") + 1).alias("step_idx"), F.lit("agent").alias("source"), said.alias("message"))
    return calls.unionByName(messages, allowMissingColumns=True)


def deltas(e: DataFrame) -> DataFrame:
    path, kind = _path(), F.col("event_type")
    digest = F.concat(F.lit("h"), (F.floor(F.col("value") / 20) % 4).cast("string"))
    by_path = Window.partitionBy("trial_id", "path").orderBy("step_idx")
    lines = F.concat_ws("\n", F.lit("+++ b"), F.lit("+import os"), F.lit("+x = 1"), F.lit("+y = 2"), F.concat(F.lit("+z = "), F.col("k") % 3), F.concat(F.lit("+w = "), F.col("k") % 4), F.concat(F.lit("+v = "), F.col("k")), F.lit(" end"))
    changed = e.where(kind.isin("signup", "purchase")).select("trial_id", "step_idx", path.alias("path"), digest.alias("sha256_after"), "event_id", "k", "value", lines.alias("hunk"), later("at", (F.col("k") - 30) * 1_000_000).alias("mtime_after"))
    changed = changed.withColumn("sha256_before", F.lag("sha256_after").over(by_path))
    changed = changed.withColumn("op", F.when(F.col("sha256_before").isNull(), "add").when(F.col("k") % 11 == 0, "delete").otherwise("modify"))
    return changed.withColumn("bytes_after", F.floor(F.col("value") * 100).cast("long"))


def job_notices(e: DataFrame) -> DataFrame:
    return e.where((F.col("event_type") == "click") & (F.col("k") % 4 == 1) & (F.col("event_id") % 2 == 0)).select(
        "trial_id", F.concat(F.lit("b"), "event_id").alias("task_id"), F.concat(F.lit("c"), "event_id").alias("tool_call_id"), F.lit("completed").alias("status"), later("at", _micros() * 60).alias("noticed_at"))


def writes(deltas: DataFrame) -> DataFrame:
    return deltas.where("event_id % 4 = 0").select("trial_id", "step_idx", "path", F.explode(F.when(F.col("event_id") % 8 == 0, F.array(F.col("step_idx"), F.col("step_idx") - 1)).otherwise(
        F.array(F.when(F.col("event_id") % 3 > 0, F.col("step_idx") - 2)))).alias("writer_step"))


def trials(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    first = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    users = e.select("trial_id").distinct().join(first.select(F.col("conv_id").cast("string").alias("trial_id"), "text"), "trial_id", "left")
    number = F.col("trial_id").cast("int")
    return users.select(
        "trial_id", F.concat(F.lit("t"), "trial_id").alias("trial_name"), F.concat(F.lit("task"), number % 7).alias("task"), (number % 4).alias("attempt_idx"),
        F.when(number % 4 > 0, (number - 1).cast("string")).alias("parent_trial_id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\nSave to /k/"), number % 10, F.lit(".py. See http://x//k/1.py and /k/4.py/")).alias("prompt"),
        F.lit("m").alias("model"), F.lit("h").alias("harness"), F.when(number % 5 == 0, 1.0).when(number % 5 < 4, 0.0).alias("reward"))


class Model(Mapping):
    """trials, steps, deltas, job_notices, writes; each is declared when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        e = cache(lambda: events(spark, sf_dir))
        self._makers = {
            "trials": cache(lambda: trials(spark, sf_dir, e())), "steps": cache(lambda: steps(e())), "deltas": cache(lambda: deltas(e())),
            "job_notices": cache(lambda: job_notices(e())), "writes": cache(lambda: writes(self["deltas"])),
        }

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def model(spark: SparkSession, sf_dir: str) -> Model:
    return Model(spark, sf_dir)


#: The same five relations as SQL common table expressions, for checking.
SQL = r"""ev as (select user_id::varchar as trial_id, (row_number() over (partition by user_id order by ts, event_id))::int as step_idx, event_id, event_type, value,
  ts, json_extract_string(props, '$.k')::int as k from events),
evp as (select *, '/k/' || (k % 10) || case when k % 7 = 0 then '/__pycache__/a.pyc' else '.py' end as path, floor(value * 1000000)::bigint as micros,
  case event_type when 'view' then case when k % 3 = 0 then 'pytest -q /k/' || (k % 10) else 'cat /k/' || (k % 10) || '.py' end
    when 'click' then 'python run.py > /k/' || (k % 10) || case when k % 7 = 0 then '/__pycache__/a.pyc' else '.py' end || case when k % 2 = 0 then ' &' else '' end
    when 'error' then case when k % 5 = 0 then 'pkill -f run.py; python run.py' else 'make test-' || (k % 5) end end as command from ev),
steps as (select trial_id, step_idx, 'agent' as source, 'c' || event_id as tool_call_id, case event_type when 'signup' then 'Write' when 'purchase' then 'Edit' else 'Bash' end as tool,
  case when command is not null then '{"command": "' || command || '"}' else '{"file_path": "' || path || '"}' end as args_json,
  case when event_type = 'error' and k % 5 = 0 then 'Exit code 144' || chr(10) || 'killed' when event_type = 'error' and k % 5 = 1 then '<tool_use_error>no such file'
    when event_type = 'view' and k % 11 = 4 then 'start' || chr(10) || 'Traceback (most recent call last):' || chr(10) || '  File "x.py", line 1' || chr(10) || case when k % 2 = 0 then 'BrokenPipeError: pipe' else 'ValueError: bad ' || k end
    when event_type = 'view' and k % 11 = 5 then 'a.c:3:' || k || ': error: x' || chr(10)
    when event_type = 'error' then 'Exit code 1' || chr(10) || 'boom' when event_type = 'click' and k % 4 = 1 then 'Command running in background with ID: b' || event_id else 'ok' end as output,
  event_type = 'error' as is_error, ts as t_start, ts + to_microseconds(micros) as t_end, ts + to_microseconds(micros + 3000000) as checkpoint_at, command as command_shell, null as message from evp
  union all select trial_id, max(step_idx) + 1, 'agent', null, null, null, null, null, null, null, null, null,
  case trial_id::int % 3 when 0 then 'All tests pass, done.' when 1 then 'It does not work.' else 'Looking around' end from evp group by trial_id),
ch as (select trial_id, step_idx, path, 'h' || (floor(value / 20)::int % 4) as sha256_after, event_id, k, value,
  '+++ b' || chr(10) || '+import os' || chr(10) || '+x = 1' || chr(10) || '+y = 2' || chr(10) || '+z = ' || (k % 3) || chr(10) || '+w = ' || (k % 4) || chr(10) || '+v = ' || k || chr(10) || ' end' as hunk,
  ts + to_microseconds((k - 30)::bigint * 1000000) as mtime_after from evp where event_type in ('signup', 'purchase')),
ch2 as (select *, lag(sha256_after) over (partition by trial_id, path order by step_idx) as sha256_before from ch),
deltas as (select *, case when sha256_before is null then 'add' when k % 11 = 0 then 'delete' else 'modify' end as op, floor(value * 100)::bigint as bytes_after from ch2),
job_notices as (select trial_id, 'b' || event_id as task_id, 'c' || event_id as tool_call_id, 'completed' as status, ts + to_microseconds(micros * 60) as noticed_at from evp
  where event_type = 'click' and k % 4 = 1 and event_id % 2 = 0),
writes as (select trial_id, step_idx, path, unnest(case when event_id % 8 = 0 then [step_idx, step_idx - 1] else [case when event_id % 3 > 0 then step_idx - 2 end] end) as writer_step from deltas where event_id % 4 = 0),
trials as (select e.trial_id, 't' || e.trial_id as trial_name, 'task' || (e.trial_id::int % 7) as task, e.trial_id::int % 4 as attempt_idx, case when e.trial_id::int % 4 > 0 then (e.trial_id::int - 1)::varchar end as parent_trial_id,
  coalesce(c.text, '') || chr(10) || 'Save to /k/' || (e.trial_id::int % 10) || '.py. See http://x//k/1.py and /k/4.py/' as prompt, 'm' as model, 'h' as harness,
  case when e.trial_id::int % 5 = 0 then 1.0::double when e.trial_id::int % 5 < 4 then 0.0::double end as reward
  from (select distinct trial_id from ev) e left join (select conv_id::varchar as trial_id, arg_min(text, turn) as text from conversations where role = 'user' group by 1) c using (trial_id))"""
