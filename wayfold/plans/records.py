"""Registered queries of timelines' fixes and gates, of call states and of checkpoint states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.operators import steps, timeline
from wayfold.plans.catalog import on_model
from wayfold.plans.general import query
from wayfold.sources.adapter import read


@query("state_letters", "select user_id, event_type, dense_rank() over (partition by user_id order by f)::int as letter from (select user_id, event_type, min(event_id) as f from events group by all)")
def state_letters(spark, d):
    return timeline.state_letters(read(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("fix_diff_sets", """with t as (select l_suppkey as trial, l_partkey % 20 as chk, case when count(*) % 7 = 0 then 'flaky' when min(l_returnflag) = 'A' then 'passed' else 'failed' end as was, max(l_linestatus) = 'O' as now from lineitem group by all)
select trial, coalesce(string_agg(chk, ',' order by chk) filter (where was = 'failed' and now), '') as fixed, coalesce(string_agg(chk, ',' order by chk) filter (where was = 'passed' and not now), '') as broken,
  coalesce(string_agg(chk, ',' order by chk) filter (where was = 'failed' and not now), '') as still_failing from t where was <> 'flaky' group by trial""")
def fix_diff_sets(spark, d):
    key = [F.col("l_suppkey").alias("trial"), (F.col("l_partkey") % 20).alias("check")]
    rows = read(spark, d, "lineitem").groupBy(*key)
    base = rows.agg(F.when(F.count("*") % 7 == 0, "flaky").when(F.min("l_returnflag") == "A", "passed").otherwise("failed").alias("status"))
    tried = rows.agg(F.when(F.max("l_linestatus") == "O", "passed").otherwise("failed").alias("status"))
    return timeline.fix_sets(base, tried, ["trial"]).select("trial", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("fixed", "broken", "still_failing")])


@query("trial_gates", "select trial, kind, count(*) as checks from (select l_suppkey as trial, case when bool_or(l_linenumber = 7) then 'flaky' when bool_or(l_linenumber = 6) then 'unknown' else 'steady' end as kind from lineitem group by l_suppkey, l_partkey % 200) group by all")
def trial_gates(spark, d):
    status = F.when(F.col("l_linenumber") == 7, "flaky").when(F.col("l_linenumber") == 6, "unknown").otherwise("passed")
    return timeline.gates(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("trial"), (F.col("l_partkey") % 200).alias("check"), status.alias("status")), ["trial"])


def _states(t):
    """Every fifth call was not answered, and every tenth of all timed out; of the last one of each trial the output is not known."""
    calls = t["steps"].where("tool_call_id is not null")
    last = F.max("step_idx").over(Window.partitionBy("trial_id")) == F.col("step_idx")
    calls = calls.withColumn("is_last", last).withColumn("output", F.when(~F.col("is_last"), F.col("output")))
    return steps.call_states(calls.select("trial_id", "step_idx", "tool_call_id", "output", "is_last"), calls.where("step_idx % 5 <> 0 and not is_last"), calls.where("step_idx % 10 = 0 and not is_last"))


_STATES = """(select *, case when step_idx % 5 <> 0 and not is_last then 'answered' when step_idx % 10 = 0 and not is_last then 'timed_out' when output like '<tool_use_error>%' and not is_last then 'rejected' when is_last then 'interrupted' else 'unanswered' end as state
  from (select *, max(step_idx) over (partition by trial_id) = step_idx as is_last from steps where tool_call_id is not null))"""
on_model("classify_hooked_calls", lambda t: _states(t).select("trial_id", "step_idx", "state"), f"select trial_id, step_idx, state from {_STATES}")
on_model(
    "chain_report", lambda t: steps.chain_report(_states(t), t["steps"].where("step_idx % 25 = 0")).select(
        "trial_id", "hooked_calls", "answered_calls", "checkpoints", F.array_join("timed_out_calls", ",").alias("timed_out_calls"), F.array_join("rejected_calls", ",").alias("rejected_calls"), F.array_join("reasons", "; ").alias("reasons"), "complete"),
    f"""select trial_id, hooked_calls, answered_calls, checkpoints, timed_out_calls, rejected_calls, concat_ws('; ', case when t > 0 then t || ' calls timed out' end, case when u > 0 then u || ' calls without an answer' end, case when checkpoints = 0 then 'no checkpoint' end) as reasons, t + u = 0 and checkpoints > 0 as complete
from (select trial_id, count(*)::int as hooked_calls, count_if(state = 'answered')::int as answered_calls, count_if(state = 'timed_out') as t, count_if(state = 'unanswered') as u, coalesce(string_agg(tool_call_id, ',' order by tool_call_id) filter (where state = 'timed_out'), '') as timed_out_calls,
  coalesce(string_agg(tool_call_id, ',' order by tool_call_id) filter (where state = 'rejected'), '') as rejected_calls from {_STATES} group by 1) join (select trial_id, count_if(step_idx % 25 = 0)::int as checkpoints from steps group by 1) using (trial_id)""")
on_model(
    "checkpoint_state_walk",
    lambda t: steps.state_walk(t["steps"].select("trial_id", "step_idx", F.when(F.col("step_idx") % 7 == 0, F.col("step_idx")).alias("seq"), (F.col("step_idx") % 3 == 0).alias("covered"), F.coalesce(F.col("tool").isin("Write", "Edit"), F.lit(False)).alias("changed"))).select("trial_id", "step_idx", "checkpoint_seq"),
    """select trial_id, step_idx, case when not coalesce(bool_or(changed and step_idx % 3 <> 0 and step_idx % 7 <> 0) over (partition by trial_id, g order by step_idx), false) then high end as checkpoint_seq
from (select *, coalesce(tool in ('Write', 'Edit'), false) as changed, count(case when step_idx % 7 = 0 then 1 end) over w as g, max(case when step_idx % 7 = 0 then step_idx end) over w as high from steps window w as (partition by trial_id order by step_idx))""")
