"""Registered queries of file versions, hunks and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import versions
from wayfold.plans.catalog import on_model
from wayfold.plans.general import query
from wayfold.sources.adapter import events, read

on_model(
    "trace_reverts",
    lambda m: versions.reverts(m["deltas"], ["trial_id", "path"], "step_idx").where("reverts_to is not null").select("trial_id", "path", "step_idx", "reverts_to"),
    """select trial_id, path, step_idx, reverts_to from (select trial_id, path, step_idx, case when n = 1 or sha256_after is null or sha256_after is not distinct from last then null
  when sha256_after = orig then 'original' else earlier::varchar end as reverts_to from (select *, row_number() over f as n, lag(sha256_after) over f as last,
  first_value(sha256_before) over f as orig, lag(step_idx) over (partition by trial_id, path, sha256_after order by step_idx) as earlier from deltas window f as (partition by trial_id, path order by step_idx)))
  where reverts_to is not null""")

#: Changes of which every third was not read; the diff starts from the last read version.
_UNREAD = """with ev as (select user_id, event_id, ts, json_extract_string(props, '$.k')::int as k, floor(value / 20)::int as b from events where event_type in ('signup', 'purchase')),
ch as (select user_id, k % 3 as path, event_id, row_number() over (partition by user_id, k % 3 order by ts, event_id) as n, case when k % 13 = 0 then 'delete' else 'modify' end as op,
  case when k % 13 <> 0 and event_id % 3 <> 0 then 'h' || b end as sha256_after from ev),
rd as (select *, max(case when sha256_after is not null or op = 'delete' then n end) over (partition by user_id, path order by n rows between unbounded preceding and 1 preceding) as r from ch),
prior as (select rd.*, x.sha256_after as sha256_before from rd left join ch x on x.user_id = rd.user_id and x.path = rd.path and x.n = rd.r),
un as (select *, (select min(y.n) from ch y where y.user_id = prior.user_id and y.path = prior.path and y.n > prior.r and y.n < prior.n and y.sha256_after is null and y.op <> 'delete') as u from prior)
select event_id, r as read_at, u as unread_at from un where u is not null and op = 'modify' and sha256_before is not null"""


@query("trace_stale", _UNREAD)
def trace_stale(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).where("event_type in ('signup', 'purchase')").withColumn("path", F.col("k") % 3)
    file = Window.partitionBy("trial_id", "path").orderBy("at", "event_id")
    e = e.withColumn("n", F.row_number().over(file).cast("long")).withColumn("op", F.when(F.col("k") % 13 == 0, "delete").otherwise("modify"))
    e = e.withColumn("sha256_after", F.when((F.col("op") != "delete") & (F.col("event_id") % 3 != 0), F.concat(F.lit("h"), F.floor(F.col("value") / 20).cast("string"))))
    read_before = F.max(F.when(F.col("sha256_after").isNotNull() | (F.col("op") == "delete"), F.struct("n", "sha256_after"))).over(file.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("sha256_before", read_before["sha256_after"])
    return versions.stale(e, ["trial_id", "path"], "n").where("read_at is not null").select("event_id", "read_at", "unread_at")


@query("blame_first_seen", """select source, line, min(doc_id) as doc_id from (select source, doc_id, rtrim(unnest(string_split(text, chr(10))), ' ') as line from documents) group by source, line""")
def blame_first_seen(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", F.split("text", "\n", -1).alias("lines"))
    return versions.first_seen(docs, ["source"], "doc_id")


@query("hunk_versions", """with h as (select doc_id, string_split(text, chr(10)) as r from documents where text is not null)
select doc_id, list_aggregate(list_filter(list_transform(r, lambda x, i: case when i % 3 <> 0 then x || chr(10) end), lambda x: x is not null), 'string_agg', '') as before,
  list_aggregate(list_filter(list_transform(r, lambda x, i: case when i % 3 <> 2 then x || chr(10) end), lambda x: x is not null), 'string_agg', '') as after from h where len(r) >= 3""")
def hunk_versions(spark, d):
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("r")).where("size(r) >= 3")
    tagged = F.transform("r", lambda x, i: F.concat(F.when((i + 1) % 3 == 0, "+").when((i + 1) % 3 == 2, "-").otherwise(" "), x))
    hunk = F.concat(F.lit("--- a\n+++ b\n@@ -1,1 +1,1 @@\n"), F.array_join(tagged, "\n"), F.lit("\n"))
    return docs.select("doc_id", versions.hunk_versions(hunk).alias("v")).select("doc_id", "v.before", "v.after")


_CACHE = r"/__pycache__(/|\z)"
on_model(
    "drop_excluded",
    lambda m: versions.drop_excluded(_tree(m), ["trial_id"], _CACHE),
    r"""select trial_id, path, op from (select *, regexp_matches(path, '/__pycache__(/|\z)') as gone from t) a where not gone and not (op = 'add'
  and exists (select 1 from g where g.trial_id = a.trial_id and g.gone and starts_with(g.path, a.path || '/')) and not exists (select 1 from g where g.trial_id = a.trial_id and not g.gone and starts_with(g.path, a.path || '/')))"""
    .replace("from t)", "from (select distinct trial_id, path, 'modify' as op from deltas union all select distinct trial_id, regexp_extract(path, '^/k/[^/.]+') as path, 'add' from deltas where contains(path, '/__pycache__')"
             " union all select distinct trial_id, '/k', 'add' from deltas))").replace("from g ", r"from (select distinct trial_id, path, regexp_matches(path, '/__pycache__(/|\z)') as gone from deltas) g "))


def _tree(m):
    """The changed files, and two directories above them as added."""
    d = m["deltas"]
    files = d.select("trial_id", "path").distinct().withColumn("op", F.lit("modify"))
    dirs = d.where(F.col("path").contains("/__pycache__")).select("trial_id", F.regexp_extract("path", "^/k/[^/.]+", 0).alias("path")).union(d.select("trial_id", F.lit("/k"))).distinct()
    return files.unionByName(dirs.withColumn("op", F.lit("add")))


@query("full_transcript", "select conv_id, string_agg('## ' || coalesce(role, '?') || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn) as transcript from conversations group by conv_id")
def full_transcript(spark, d):
    return versions.transcript(read(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")
