"""Registered queries of the detector and of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import patterns as P
from wayfold.operators import detector
from wayfold.plans.catalog import _CALL, _sql, on_model
from wayfold.plans.general import query
from wayfold.streaming import operators as live

#: The code an output tells, as SQL.
_EXIT = r"coalesce(nullif(regexp_extract(output, '(?m)^\[exit_code\] (-?\d+)', 1), '')::int, nullif(regexp_extract(output, '(?m)^Exit code (-?\d+)', 1), '')::int, case when not coalesce(is_error, false) then 0 end)"
_MASKED = rf"""select trial_id, step_idx, 'masked_error' as pattern, null::varchar as subtype, left(trim(case when bare and contains(l, '{detector.TRACEBACK}') then '{detector.TRACEBACK}' else l end), 300) as detail
from (select *, list_filter(string_split(coalesce(output, ''), chr(10)), lambda x: regexp_matches(x, {_sql(detector.CRASH)}) or (traced and regexp_extract(x, {_sql(detector.EXCEPTION)}, 1) not in ('', '{detector.NO_CRASH}')) or (bare and contains(x, '{detector.TRACEBACK}')))[1] as l
  from (select *, contains(output, '{detector.TRACEBACK}') as traced, contains(output, '{detector.TRACEBACK}') and not regexp_matches(output, {_sql("(?m)" + detector.EXCEPTION)}) as bare from steps where tool = 'Bash' and {_EXIT} = 0) s) s where l is not null"""
_KILLED = rf"""select trial_id, step_idx, 'self_kill' as pattern, null::varchar as subtype, coalesce(nullif(m.a, ''), nullif(m.b, ''), nullif(m.c, '')) as detail
from (select *, regexp_extract(json_extract_string(args_json, '$.command'), {_sql(detector.KILL_BY_PATTERN)}, ['a', 'b', 'c']) as m from steps where tool = 'Bash' and {_EXIT} in (143, 144)) s where coalesce(nullif(m.a, ''), nullif(m.b, ''), nullif(m.c, '')) is not null"""
on_model("detect_masked_error", detector.masked_error, _MASKED)
on_model("detect_self_kill", detector.self_kill, _KILLED)
on_model("detect_silent_no_write", detector.silent_no_write, rf"""select trial_id, step_idx, 'silent_no_write' as pattern, case when tool = 'Bash' then 'quiet' else 'tool' end as subtype, p as detail
from (select *, case when tool in ('Write', 'Edit') then [json_extract_string(args_json, '$.file_path')] else list_distinct(regexp_extract_all(coalesce(json_extract_string(args_json, '$.command'), ''), '(?:^|[^0-9&>])>>?\s*(/[^\s;&|()"'']+)', 1)) end as ps from steps
  where {_CALL} and not is_error and not regexp_matches(coalesce(json_extract_string(args_json, '$.command'), ''), {_sql(P.JOB_LAUNCH)}) and not regexp_matches(output, {_sql(P.BACKGROUNDED)})) s, unnest(ps) as u(p)
where not exists (select 1 from deltas d where d.trial_id = s.trial_id and d.step_idx = s.step_idx and d.path = p)""")
on_model("detect_missing_output", detector.missing_output, rf"""select trial_id, step_idx, 'missing_output' as pattern, case when op is null then 'never_written' else 'deleted' end as subtype, path as detail
from (select distinct trial_id, rtrim(p, '/') as path from trials, unnest(regexp_extract_all(prompt, {_sql(P.PROMPT_PATH)})) as u(p) where p not like '//%') left join (select trial_id, path, arg_max(op, step_idx) as op from deltas group by all) using (trial_id, path)
join (select trial_id, max(step_idx) as step_idx from steps group by 1) using (trial_id) where regexp_extract(path, '[^/]+$') like '%.%' and (op is null or op = 'delete')""")
on_model("detect_unverified_completion", detector.unverified_completion, """select trial_id, n as step_idx, 'unverified_completion' as pattern, case when coalesce(tst > chg, false) then 'last_test_failed' else 'no_test' end as subtype, chg::varchar as detail
from (select trial_id, max(step_idx) as n, max(step_idx) filter (where is_mutating) as chg, max(step_idx) filter (where is_test_command) as tst, arg_max(has_error_marker, step_idx) filter (where is_test_command) as err from step_flags group by 1) where chg is not null and (not coalesce(tst > chg, false) or err)""")
on_model("detect_flags", lambda t: detector.flags(t).groupBy("pattern", "subtype").agg(F.count("*").alias("n")))
on_model("win_repeat_hint", detector.repeats, f"""select trial_id, step_idx, before, times, done > prev as changed_since from (select *, lag(step_idx) over w as before, row_number() over w as times, lag(done) over w as prev
from (select s.trial_id, s.step_idx, tool || ' ' || regexp_replace(coalesce(args_json, ''), '\\s+', ' ', 'g') as k, coalesce(count_if(is_mutating) over (partition by s.trial_id order by s.step_idx rows between unbounded preceding and 1 preceding), 0) as done
  from steps s join step_flags using (trial_id, step_idx) where {_CALL}) window w as (partition by trial_id, k order by step_idx)) where before is not null""")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of its file or folder; as a pattern, since a stream's plain path must be a folder."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_first_per_key", "select user_id, event_type from events group by all")
def first_per_key(spark, d):
    rows = live.first_per_key(_stream(spark, d).select("user_id", "event_type", "at"), ["user_id", "event_type"], "at", "100 days")
    return live.drained(spark, rows.select("user_id", "event_type"))


@query("stream_rate_dedup", "select user_id, epoch_us(time_bucket(interval 1 hour, ts)) as start, count(*) as events from events group by all")
def rate_dedup(spark, d):
    rows = live.drained(spark, live.at_most_once_a(_stream(spark, d), ["user_id"], "at", "1 hour", "1 hour"), "complete")
    return rows.select("user_id", F.unix_micros("start").alias("start"), "events")


@query("stream_windowed_counts", "select event_type, epoch_us(time_bucket(interval 1 day, ts)) as start, count(*) as n from events group by all")
def windowed(spark, d):
    rows = live.drained(spark, live.windowed_counts(_stream(spark, d), ["event_type"], "at", "1 day", "1 day"), "complete")
    return rows.select("event_type", F.unix_micros("start").alias("start"), "n")


@query("stream_every_n", "with n as (select user_id, event_id, event_type = 'error' as stop, coalesce(sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as g from events), r as (select *, row_number() over (partition by user_id, g order by event_id) as i from n) select user_id, event_id, stop or i % 4 = 0 as due from r")
def every_n(spark, d):
    rows = _stream(spark, d).select("user_id", "event_id", (F.col("event_type") == "error").alias("is_stop"))
    return live.drained(spark, live.every_nth(rows, "user_id", "event_id", 4))


@query("stream_change_gate", "select user_id, event_id, event_type as digest from events qualify lag(event_type) over (partition by user_id order by event_id) is distinct from event_type")
def change_gate(spark, d):
    rows = _stream(spark, d).select("user_id", "event_id", F.col("event_type").alias("digest"))
    return live.drained(spark, live.change_gate(rows, "user_id", "event_id", "digest"))


@query("stream_hold_release", "select e.event_id, o.event_id as owner from events e join events o on e.user_id = o.user_id and o.event_type = 'signup' and e.event_type = 'purchase' and abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 3600000000")
def hold_release(spark, d):
    rows = _stream(spark, d)
    events = rows.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    owners = _stream(spark, d).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("owner"), F.col("at").alias("known_at"))
    return live.drained(spark, live.hold_until_known(events, owners, "user_id", "at", "1 hour").select("event_id", "owner"))


@query("stream_sessions", "with s as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours, true) as fresh from events), g as (select *, sum(fresh::int) over (partition by user_id order by ts) as g from s) select user_id, epoch_us(min(ts)) as start, count(*) as n from g group by user_id, g")
def sessions(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return live.sessions(rows, ["user_id"], "at", "6 hours", "1 day").select("user_id", F.unix_micros("start").alias("start"), "n")
