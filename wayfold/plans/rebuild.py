"""Registered queries of line matching, blame, diff replay, provenance, samples, stateful streams and published files.

Texts under versions are the turns of a conversation: each (conv_id, role) is a file, a turn is a version, a sentence is a line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import stats
from wayfold.operators import matching, provenance, replay, samples
from wayfold.operators.lineage import shared_folder, written
from wayfold.plans.catalog import ORACLE, register
from wayfold.plans.general import query
from wayfold.plans.live import _stream
from wayfold.sources import adapter, files
from wayfold.sources.adapter import read
from wayfold.streaming import operators as live
from wayfold.streaming import stateful


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, role, turn, lines): every eleventh turn has no file."""
    c = read(spark, d, "conversations").where("conv_id is not null and role is not null and turn is not null")
    lines = F.split(F.coalesce("text", F.lit("")), r"\. |\n", -1)
    return c.select("conv_id", "role", "turn", F.when((F.col("turn") + F.col("conv_id")) % 11 != 5, lines).alias("lines"))


_FILES = r"v as (select conv_id, role, turn, case when (turn + conv_id) % 11 <> 5 then regexp_split_to_array(coalesce(text, ''), '\. |\n') end as ls from conversations where conv_id is not null and role is not null and turn is not null)"


def _pairs(versions: DataFrame) -> DataFrame:
    """Each version with the one before it as `a`."""
    numbered = versions.withColumn("t", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    before = numbered.select("conv_id", "role", (F.col("t") + 1).alias("t"), F.col("lines").alias("a"))
    return numbered.withColumnRenamed("lines", "b").join(before, ["conv_id", "role", "t"], "left")


_KEY = ["conv_id", "role", "turn"]


@query("diff_opcodes", f"with {_FILES}, p as (select conv_id, role, turn, coalesce(len(lag(ls) over w), 0) as n, coalesce(len(ls), 0) as m from v window w as (partition by conv_id, role order by turn)) select conv_id, role, turn, n::bigint as old_lines, m::bigint as new_lines from p where n + m > 0")
def diff_opcodes(spark, d):
    """The lines on both sides as the opcodes have them; that they turn one side into the other is tested line by line."""
    ops = matching.opcodes(written(_pairs(_versions(spark, d))), _KEY)
    return ops.groupBy(*_KEY).agg(F.sum(F.col("i2") - F.col("i1")).alias("old_lines"), F.sum(F.col("j2") - F.col("j1")).alias("new_lines"))


@query("apply_all_hunks", f"with {_FILES} select conv_id, role, turn, list_aggregate(ls, 'string_agg', chr(10)) as after from v where ls is not null")
def apply_all_hunks(spark, d):
    whole = matching.with_opcodes(written(_pairs(_versions(spark, d))), _KEY).where("b is not null")
    every = F.sequence(F.lit(0), F.size("ops"))
    return whole.select(*_KEY, F.array_join(matching.partial_fix(F.col("ops"), "a", "b", every), "\n").alias("after"))


@query("apply_no_hunk", f"with {_FILES}, p as (select *, lag(ls) over (partition by conv_id, role order by turn) as old from v) select conv_id, role, turn, coalesce(list_aggregate(old, 'string_agg', chr(10)), '') as after from p where ls is not null")
def apply_no_hunk(spark, d):
    whole = matching.with_opcodes(written(_pairs(_versions(spark, d))), _KEY).where("b is not null")
    return whole.select(*_KEY, F.array_join(matching.partial_fix(F.col("ops"), "a", "b", F.array().cast("array<int>")), "\n").alias("after"))


@query("line_blame")
def line_blame(spark, d):
    return matching.blame(_versions(spark, d), ["conv_id", "role"], "turn")


@query("line_blame_lines", f"with {_FILES} select conv_id, role, i as line_no, ls[i] as line from (select * from v qualify row_number() over (partition by conv_id, role order by turn desc) = 1), unnest(range(1, len(ls) + 1)) as u(i) where ls is not null")
def line_blame_lines(spark, d):
    return matching.blame(_versions(spark, d), ["conv_id", "role"], "turn").select("conv_id", "role", "line_no", "line")


@query("blame_fix")
def blame_fix(spark, d):
    """The last version of a file fixed by the one before it: the turns that brought what goes."""
    versions = written(_versions(spark, d))
    last = versions.groupBy("conv_id", "role").agg(F.max("turn").alias("turn"))
    pairs = _pairs(versions).join(last, _KEY).where("a is not null and b is not null").select(*_KEY, F.col("b").alias("a"), F.col("a").alias("b"))
    ops = matching.with_opcodes(written(pairs), ["conv_id", "role"]).select("conv_id", "role", "ops", F.size("a").alias("n_lines"))
    return matching.blame_fix(ops, matching.blame(versions, ["conv_id", "role"], "turn"), ["conv_id", "role"])


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The versions as recorded changes with unified diffs; every seventh was not read."""
    rows = matching.unified(written(_pairs(_versions(spark, d))), _KEY, context=2).where("t > 1 or b is not null")
    unread = (F.col("turn") * 3 + F.col("conv_id")) % 7 == 3
    return rows.select(*_KEY, F.when(F.col("b").isNull(), "delete").otherwise("modify").alias("op"), F.when(~unread & F.col("b").isNotNull(), F.col("diff")).alias("diff"), F.sha2(F.array_join("b", "\n"), 256).alias("sha256"))


@query("file_after", f"""with {_FILES}, c as (select *, row_number() over w as t, lag(ls) over w is null as anew, (turn * 3 + conv_id) % 7 = 3 as unread from v window w as (partition by conv_id, role order by turn)),
k as (select *, max(case when ls is not null and anew and not unread then t end) over w as begun, max(case when ls is null or unread then t end) over w as lost from c window w as (partition by conv_id, role order by t))
select conv_id, role, turn, case when ls is null then 'deleted' when coalesce(begun > coalesce(lost, 0), false) then 'verified' else 'unknown' end as state,
  case when ls is not null and begun > coalesce(lost, 0) then list_aggregate(ls, 'string_agg', chr(10)) end as text from k where t > 1 or ls is not null""")
def file_after(spark, d):
    return replay.file_after(_changes(spark, d), ["conv_id", "role"], "turn").select(*_KEY, "state", "text")


@query("rebuild_text", f"""with {_FILES}, c as (select *, row_number() over w as t, lag(ls) over w is null as anew, (turn * 3 + conv_id) % 7 = 3 as unread from v window w as (partition by conv_id, role order by turn)),
k as (select conv_id, role, max(case when ls is not null and anew and not unread then t end) as begun, max(case when ls is null or unread then t end) as lost, arg_max(ls, t) as ls, arg_max(ls is null, t) as gone from c group by all having count(*) > 1 or not arg_max(ls is null, t))
select conv_id, role, case when gone then 'deleted' when coalesce(begun > coalesce(lost, 0), false) then 'verified' else 'unknown' end as state, case when not gone and begun > coalesce(lost, 0) then list_aggregate(ls, 'string_agg', chr(10)) end as text from k""")
def rebuild_text(spark, d):
    return replay.rebuilt(_changes(spark, d), ["conv_id", "role"], "turn")


# Provenance: a conversation is a run, its first message the prompt; user messages are results, every third a look at the record.
def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words of messages as facts: each becomes a path of its own. Turn 0 is the prompt."""
    c = read(spark, d, "conversations").where("conv_id is not null and turn is not null")
    text = F.array_join(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.concat(F.lit("--"), w)), " ")
    c = c.select(F.col("conv_id").alias("run"), "turn", "role", text.alias("text"))
    prompts = c.where("turn = 0").select("run", "text")
    calls = c.where("turn > 0").select("run", F.col("turn").alias("n"), F.when(F.col("role") == "assistant", F.col("text")).alias("text"), F.when(F.col("role") != "assistant", F.col("text")).alias("result"), (F.col("turn") % 3 == 0).alias("is_record"))
    return calls, prompts


@query("record_info", """with c as (select conv_id as run, turn as n, role, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]{3,}'))) as w from conversations where conv_id is not null and turn is not null),
u as (select run, w, min(n) as n from c where n > 0 and role = 'assistant' group by all), s as (select run, w, min(n) as n from c where n > 0 and role <> 'assistant' group by all),
g as (select distinct run, w from c where n = 0)
select run, '--' || u.w as token, 'flag' as kind, u.n, case when g.w is not null then 'given' when s.n < u.n then case when s.n % 3 = 0 then 'record' else 'own' end else 'unsourced' end as source
from u left join s using (run, w) left join g using (run, w)""")
def record_info(spark, d):
    return provenance.sources(*_calls(spark, d))


@query("record_lines", """with c as (select source as run, doc_id as n, unnest(list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12 and regexp_matches(x, '[A-Za-z]{3}')))) as line from documents where source is not null and doc_id is not null),
w as (select run, line, min(n) as n from c where n >= 20 and n % 3 <> 0 group by all), s as (select run, line, min(n) filter (where n % 3 = 0) as r, min(n) filter (where n % 3 <> 0) as o from c where n >= 20 group by all)
select run, line, w.n from w join s using (run, line) where r < w.n and (o is null or o >= w.n) and not exists (select 1 from c g where g.n < 20 and g.run = w.run and g.line = w.line)""")
def record_lines(spark, d):
    """Sources as runs, documents as calls that write what they show; the first twenty are prompts, every third is a look at the record."""
    c = read(spark, d, "documents").where("source is not null and doc_id is not null").select(F.col("source").alias("run"), F.col("doc_id").alias("n"), "text")
    calls = c.where("n >= 20").select("run", "n", "text", F.col("text").alias("result"), (F.col("n") % 3 == 0).alias("is_record"))
    return provenance.record_lines(calls, c.where("n < 20").select("run", "text"))


# Samples and assertions.
_LOT = "md5('{}:' || p_partkey)"


@query("sample_stratified", f"select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by {_LOT.format(7)}, p_partkey) <= 5")
def sample_stratified(spark, d):
    return samples.bottom_k(read(spark, d, "part"), ["p_brand"], ["p_partkey"], 5, 7).select("p_brand", "p_partkey")


@query("sample_review", f"select p_partkey, why from (select p_partkey, case when p_size = 50 then 'must' when row_number() over (partition by p_brand, p_size = 50 order by {_LOT.format(3)}, p_partkey) = 1 then 'stratum' when ('0x' || left({_LOT.format(4)}, 15))::bigint < (0.2::double * 1152921504606846976)::bigint then 'share' end as why from part) where why is not null")
def sample_review(spark, d):
    return samples.review_sample(read(spark, d, "part"), F.col("p_size") == 50, ["p_brand"], ["p_partkey"], 0.2, 3).select("p_partkey", "why")


@query("sample_queues", f"""with t as (select p_partkey, row_number() over (partition by p_brand order by {_LOT.format(5)}, p_partkey) as turn from part), n as (select p_partkey, row_number() over (order by turn, {_LOT.format(5)}, p_partkey) as n from t)
select p_partkey, case when n <= 5 then 'pilot' when n <= 17 then 'steps' else 'second' end as queue, (case when n <= 5 then n when n <= 17 then n - 5 else n - 17 end)::int as place from n where n <= 23""")
def sample_queues(spark, d):
    return samples.queues(read(spark, d, "part"), ["p_brand"], ["p_partkey"], {"pilot": 5, "steps": 12, "second": 6}, 5).select("p_partkey", "queue", "place")


@query("agg_digest_conflict", "select o_custkey % 50 as task, count(distinct md5(o_orderstatus)) as digests, min(md5(o_orderstatus)) as first, max(md5(o_orderstatus)) as last from orders where o_custkey % 7 > 0 group by 1 having count(distinct o_orderstatus) > 1")
def digest_conflict(spark, d):
    rows = read(spark, d, "orders").where("o_custkey % 7 > 0").select((F.col("o_custkey") % 50).alias("task"), F.md5("o_orderstatus").alias("digest"))
    return samples.digest_conflicts(rows, ["task"], "digest")


@query("queue_overflow", "select user_id, least(count(*), 40) as kept, greatest(count(*) - 40, 0) as overflow from events group by 1")
def queue_overflow(spark, d):
    return samples.capped(read(spark, d, "events"), ["user_id"], ["ts"], 40)


@query("stat_friedman_permuted")
def friedman_permuted(spark, d):
    """Per brand: sizes of parts by container size over blocks of manufacturer rank, as complete blocks of three arms."""
    p = read(spark, d, "part").select("p_brand", (F.col("p_partkey") % 3).alias("arm"), F.floor(F.col("p_partkey") / 3).alias("n"), "p_size")
    p = p.groupBy("p_brand", (F.col("n") % 8).alias("block"), "arm").agg(F.avg("p_size").alias("v"))
    whole = p.groupBy("p_brand", "block").agg(F.count("*").alias("k")).where("k = 3").select("p_brand", "block")
    return stats.friedman_permuted(p.join(whole, ["p_brand", "block"]), ["p_brand"], "block", "arm", "v", 499)


# Streams with state.
def _append(spark: SparkSession, rows: DataFrame) -> DataFrame:
    with stateful.rocksdb(spark):
        return live.drained(spark, rows)


def stream_checker(spark: SparkSession, d: str) -> DataFrame:
    """The detector over the answered calls as they come; `detect_*` say the same of the whole trial at once."""
    at = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    stateful.answered_calls(adapter.model(spark, d)).write.parquet(at)
    return _append(spark, stateful.checked(spark.readStream.schema(stateful.CALL).parquet(at)))


def _flags_sql() -> str:
    """The SQL of the five patterns under one heading, each with its own tables."""
    heads = [ORACLE[f"detect_{p}"] for p in ("masked_error", "self_kill", "silent_no_write", "missing_output", "unverified_completion")]
    return " union all ".join(f"select trial_id, step_idx, pattern, subtype, detail from ({x})" for x in heads)


register("stream_checker", stream_checker, _flags_sql())


@query("stream_timeout", "select user_id::varchar || ':' || (json_extract_string(props, '$.k')::int % 10) as call_id, case when bool_or(event_type = 'purchase') then 'answered' else 'timed_out' end as outcome from events where event_type in ('error', 'purchase') group by 1")
def stream_timeout(spark, d):
    """Errors as timeout markers, purchases as records of calls. One last marker, of a call of its own, moves event time past all waits; the last
    events make it, not all of them, which would come to one task."""
    call = F.concat_ws(":", F.col("user_id").cast("string"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    rows = _stream(spark, d).where("event_type in ('error', 'purchase')").select(call.alias("call_id"), F.when(F.col("event_type") == "error", "timeout").otherwise("record").alias("kind"), F.col("at").alias("arrived"))
    last = read(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us")).first().us
    later = _stream(spark, d).where(F.unix_micros("at") == F.lit(last).cast("long")).select(F.lit("end").alias("call_id"), F.lit("record").alias("kind"), (F.col("at") + F.expr("interval 30 days")).alias("arrived"))
    emitted = _append(spark, stateful.timeouts(rows.unionByName(later), 3_600_000))
    return stateful.outcomes(emitted).where("call_id <> 'end'")


@query("stream_process_cache", """with e as (select *, epoch_us(ts) // 1000 as ms from events), l as (select p.event_id, max({'ms': v.ms, 'kind': v.event_type}) as r, any_value(p.ms) as ms from e p left join e v on v.user_id = p.user_id and v.event_type in ('view', 'click') and v.ts <= p.ts where p.event_type = 'purchase' group by 1)
select event_id, case when ms - r.ms < 7200000 then r.kind end as value from l""")
def stream_process_cache(spark, d):
    """Views and clicks as readings of a user's process, purchases as events that ask for one no older than two hours."""
    rows = _stream(spark, d).where("event_type in ('view', 'click', 'purchase')").select(
        F.col("user_id").cast("string").alias("key"), "at", (F.col("event_type") == "purchase").alias("is_event"), "event_id", F.col("event_type").alias("value"))
    return _append(spark, stateful.fresh_readings(rows, 7_200_000, 86_400_000)).select("event_id", "value")


# Published files.
@query("sink_files", "select distinct 'blobs/' || sha256(coalesce(text, '')) as path, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as sha256 from conversations where turn < 2")
def sink_files(spark, d):
    """First turns as blobs by their hash, published as one version and listed from what was committed."""
    at = f"{shared_folder(spark).removeprefix('file:')}/files-{uuid.uuid4().hex}"
    c = read(spark, d, "conversations").where("turn < 2").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    files.publish(files.blobs(c.withColumn("sha256", F.sha2("content", 256)), "content"), at)
    return files.listed(spark, at)
