"""Registered queries of path mentions and of one trial's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import trace
from wayfold.plans.catalog import on_model


def path_mentions(t) -> DataFrame:
    """Every call says the same six paths of its own number; changed files are those of the trial. Notes.md is known to one trial in three."""
    n = (F.col("step_idx") % 10).cast("string")
    text = F.concat(F.lit("See /k/"), n, F.lit(".py, `"), n, F.lit(".py`; __pycache__/a.pyc and k/"), n, F.lit("/ (/k/). Notes.md says http://x/y.py"))
    messages = t["steps"].where("tool is not null").select("trial_id", "step_idx", text.alias("message"))
    changed = t["deltas"].select("trial_id", "path", F.col("step_idx").alias("call"))
    known = t["trials"].where("cast(trial_id as int) % 3 = 0").select("trial_id", F.lit("Notes.md").alias("name"))
    return trace.mentions(messages, changed, known).withColumn("paths", F.array_join("paths", " "))


on_model("path_mentions", path_mentions, """, m as (select trial_id, step_idx, (step_idx % 10)::varchar as n from steps where tool is not null),
l as (select trial_id, step_idx, list_concat(['/k/' || n || '.py', n || '.py', '__pycache__/a.pyc', 'k/' || n || '/', '/k/'], case when trial_id::int % 3 = 0 then ['Notes.md'] else [] end) as ts from m),
k as (select trial_id, step_idx, i::int as place, ts[i] as token, rtrim(ts[i], '/') as bare from l, unnest(range(1, 7)) as u(i) where i <= len(ts)),
p as (select distinct trial_id, token, path from (select distinct trial_id, token, bare from k) k join deltas d using (trial_id)
  where case when starts_with(token, '/') then path = bare or starts_with(path, bare || '/') else ends_with(path, '/' || bare) or contains(path, '/' || bare || '/') end),
a as (select trial_id, token, array_to_string(list_sort(list(path))[1:5], ' ') as paths, greatest(count(*) - 5, 0)::int as more from p group by all),
c as (select trial_id, token, count(distinct step_idx) as calls from p join deltas using (trial_id, path) group by all)
select trial_id, step_idx, place, token, coalesce(paths, '') as paths, coalesce(more, 0)::int as more, coalesce(calls, 0) as calls from k left join a using (trial_id, token) left join c using (trial_id, token)""")


def trace_documents(t) -> DataFrame:
    """Each call with its status, its seconds since the trial began and the number of files it changed; ten events a part."""
    files = t["deltas"].groupBy("trial_id", "step_idx").agg(F.count("*").alias("files"))
    calls = t["steps"].where("tool is not null")
    began = calls.groupBy("trial_id").agg(F.min("t_start").alias("_began"))
    rows = calls.join(files, ["trial_id", "step_idx"], "left").join(began, "trial_id")
    status = F.when(F.col("files") > 0, "changed").when(F.col("is_error"), "failed").otherwise("unchanged")
    seconds = F.floor((F.unix_micros("t_start") - F.unix_micros("_began")) / 1_000_000).cast("long")
    events = rows.select("trial_id", "step_idx", "tool", status.alias("status"), seconds.alias("t"), "files", F.col("command_shell").alias("command"))
    return trace.documents(t["trials"].select("trial_id", "task", "attempt_idx"), events, part=10)


on_model("trace_documents", trace_documents, """, f as (select trial_id, step_idx, count(*) as files from deltas group by all),
e as (select trial_id, step_idx, tool, case when files > 0 then 'changed' when is_error then 'failed' else 'unchanged' end as status, (epoch_us(t_start) - min(epoch_us(t_start)) over (partition by trial_id)) // 1000000 as t, files, command_shell as command
  from steps left join f using (trial_id, step_idx) where tool is not null),
c as (select trial_id, string_agg('"' || status || '":' || n, ',' order by status) as counts from (select trial_id, status, count(*) as n from e group by all) group by 1)
select trial_id, 0 as part, '{"trial":' || to_json({'trial_id': trial_id, 'task': task, 'attempt_idx': attempt_idx}) || ',"counts":{' || coalesce(counts, '') || '}}' as document from trials left join c using (trial_id)
union all select trial_id, (step_idx // 10 + 1)::int, to_json(list({'step_idx': step_idx, 'tool': tool, 'status': status, 't': t, 'files': files, 'command': command} order by step_idx))::varchar from e group by 1, 2""")
