"""Registered queries of writer attribution: every call as a write event with a shell, a session and an origin made from its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import reconcile, writers
from wayfold.operators.lineage import written
from wayfold.plans.catalog import on_model


def _steps(t) -> DataFrame:
    s = t["steps"].where("tool is not null")
    return s.select("trial_id", "step_idx", "tool", F.col("command_shell").alias("command"), F.unix_micros("t_start").alias("t_start"), F.unix_micros("t_end").alias("t_end"), F.substr("tool_call_id", F.lit(2)).cast("long").alias("id"))


def _events(steps: DataFrame) -> DataFrame:
    when = lambda condition, value: F.when(F.expr(condition), F.expr(value))
    shell = F.when(F.expr("command is not null and id % 3 > 0"), F.struct(
        F.expr("id % 4").alias("pid"), when("id % 13 > 0", "t_start + (id % 7 - 2) * 700000").alias("started_at"), F.sha2(F.expr("if(id % 4 = 0, 'other', command)"), 256).alias("command_sha256")))
    return steps.select(
        "trial_id", F.col("id").alias("event_id"), (F.col("t_start") + 500_000).alias("at"), F.expr("id % 5 = 0").alias("agent"), when("id % 2 = 0", "id % 4").alias("sid"),
        when("id % 6 > 0", "t_start + (id % 4) * 400000 - 600000").alias("started_at"), when("id % 9 = 0", "t_start + 200000").alias("origin_started"), shell.alias("shell"))


_SQL = """, s as (select trial_id, step_idx, tool, command_shell as command, epoch_us(t_start) as a, epoch_us(t_end) as b, substr(tool_call_id, 2)::bigint as id from steps where tool is not null),
e as (select trial_id, id as event_id, a + 500000 as m, id % 5 = 0 as agent, case when id % 2 = 0 then id % 4 end as sid, case when id % 6 > 0 then a + (id % 4) * 400000 - 600000 end as began, case when id % 9 = 0 then a + 200000 end as origin,
  command is not null and id % 3 > 0 as has, id % 4 as pid, case when id % 13 > 0 then a + (id % 7 - 2) * 700000 end as sst, sha256(case when id % 4 = 0 then 'other' else command end) as sha from s),
sh as (select distinct trial_id, pid, sst, sha from e where has),
c as (select sh.*, count(*) as n, min(step_idx) as head, min({'b': b, 'i': step_idx}) filter (where sst between a - 1000000 and b + 1000000) as run, max({'a': a, 'i': step_idx}) filter (where a - 1000000 <= sst) as bef
  from sh join s on s.trial_id = sh.trial_id and tool = 'Bash' and sha256(command) = sha group by all),
d as (select sh.*, min(step_idx) as st from sh join s on s.trial_id = sh.trial_id and tool = 'Bash' and sst between a - 1000000 and b + 1000000 group by all having count(*) = 1),
f as (select sh.*, case when n = 1 or sh.sst is null then head when run is not null then run.i else bef.i end as cmd, st from sh left join c on c.trial_id = sh.trial_id and c.pid = sh.pid and c.sst is not distinct from sh.sst and c.sha = sh.sha
  left join d on d.trial_id = sh.trial_id and d.pid = sh.pid and d.sst = sh.sst and d.sha = sh.sha),
x as (select e.trial_id, e.event_id, f.cmd, f.st from e join f on f.trial_id = e.trial_id and f.pid = e.sid and (f.sst is null or began is null or f.sst <= began + 1000000)
  qualify row_number() over (partition by e.trial_id, e.event_id order by coalesce(f.sst, m) desc, f.sst is null, f.sha) = 1),
w as (select e.trial_id, event_id, min(step_idx) as st from e join s on s.trial_id = e.trial_id and tool in ('Write', 'Edit') and m between a - 1000000 and b + 1000000 where agent and not has group by all having count(*) = 1),
o as (select e.trial_id, event_id, min(step_idx) as st from e join s on s.trial_id = e.trial_id and tool = 'Bash' and coalesce(origin, began) between a - 1000000 and b + 1000000 where not agent group by all having count(*) = 1),
r as (select e.trial_id, e.event_id, e.m, own.cmd as r1, own.st as r2, x.cmd as r3, x.st as r4, w.st as r5, o.st as r6 from e left join f own on e.has and own.trial_id = e.trial_id and own.pid = e.pid and own.sst is not distinct from e.sst and own.sha = e.sha
  left join x on x.trial_id = e.trial_id and x.event_id = e.event_id left join w on w.trial_id = e.trial_id and w.event_id = e.event_id left join o on o.trial_id = e.trial_id and o.event_id = e.event_id),
att as (select trial_id, event_id, m, coalesce(r1, r2, r3, r4, r5, r6)::int as writer_step, case when r1 is not null then 'command' when r2 is not null then 'start_time' when coalesce(r3, r4) is not null then 'session' when r5 is not null then 'tool_window' when r6 is not null then 'start_time' end as mapped_by from r)
"""


def write_events(t) -> DataFrame:
    steps = written(_steps(t))
    return writers.attributed(_events(steps), steps)


on_model("write_events", lambda t: write_events(t).select("trial_id", "event_id", "writer_step", "mapped_by"), _SQL + "select trial_id, event_id, writer_step, mapped_by from att")


def write_rows(t) -> DataFrame:
    """Each change of a file with the events of its trial on one of ten paths, since the change before."""
    micros = F.unix_micros("mtime_after")
    changes = t["deltas"].where("event_id % 3 > 0").select("trial_id", "step_idx", F.concat(F.lit("/k/"), F.col("k") % 10).alias("path"), "op", F.when(F.col("event_id") % 4 > 0, micros - 30 * 86_400_000_000).alias("since"), micros.alias("upto"))
    at = write_events(t).select("trial_id", F.concat(F.lit("/k/"), F.col("event_id") % 10).alias("path"), "at", F.when(F.col("event_id") % 2 == 0, "modify").otherwise("create").alias("op"), F.lit(False).alias("is_dir"), "writer_step", "mapped_by")
    return reconcile.write_rows(changes, at).withColumn("ops", F.array_join("ops", ",")).drop("via_dir")


on_model("write_rows", write_rows, _SQL + """select d.trial_id, d.step_idx, '/k/' || (d.k % 10) as path, writer_step, ['command', 'session', 'tool_window', 'start_time'][min(list_position(['command', 'session', 'tool_window', 'start_time'], mapped_by))] as mapped_by,
  count(*)::int as events, array_to_string(list_sort(list_distinct(list(case when att.event_id % 2 = 0 then 'modify' else 'create' end))), ',') as ops, min(m) as first_at, max(m) as last_at
from deltas d join att on att.trial_id = d.trial_id and att.event_id % 10 = d.k % 10 and m <= epoch_us(mtime_after) and (d.event_id % 4 = 0 or m > epoch_us(mtime_after) - 30 * 86400000000) where d.event_id % 3 > 0 group by 1, 2, 3, 4""")
