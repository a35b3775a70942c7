"""Registered queries of text functions and of report tables over the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import texts
from wayfold.operators import reports
from wayfold.plans import views
from wayfold.plans.catalog import on_model
from wayfold.plans.general import query
from wayfold.sources.adapter import read

on_model(
    "text_shell", lambda t: t["steps"].where("command_shell is not null").select("trial_id", "step_idx", texts.shell_text(F.concat(F.col("command_shell"), F.lit(" -c 'a & b'\ncat <<EOF > x\nnohup y &\nEOF\necho"))).alias("shell")),
    "select trial_id, step_idx, command_shell || ' -c <code>' || chr(10) || 'cat <<heredoc>' || chr(10) || 'echo' as shell from steps where command_shell is not null")
on_model(
    "text_summary", lambda t: t["steps"].where("tool is not null").select("trial_id", "step_idx", texts.summary(F.col("tool"), F.col("args_json")).alias("summary")),
    """select trial_id, step_idx, case when length(l) <= 160 then l else left(l, 159) || '…' end as summary from (select *, trim(regexp_replace(case when tool = 'Bash' then coalesce(json_extract_string(args_json, '$.command'), '')
  else coalesce(json_extract_string(args_json, '$.file_path'), args_json) end, '\\s+', ' ', 'g')) as l from steps where tool is not null)""")


@query("text_shortened", "select doc_id, case when length(text) > 700 then left(text, 400) || chr(10) || '[... ' || format('{:,}', length(text) - 700) || ' characters cut ...]' || chr(10) || right(text, 300) else text end as text, length(text) > 700 as cut from documents where text is not null")
def text_shortened(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", texts.shortened(F.col("text"), 400, 300).alias("s")).select("doc_id", "s.text", "s.cut")


@query("text_node_id", "select o_orderkey, 't.py::x' || case when o_orderkey % 3 = 0 then '[a - b]' else '' end || case when o_orderkey % 2 = 0 then ' ' else '' end as node from orders")
def text_node_id(spark, d):
    rest = F.concat(F.lit("t.py::x"), F.when(F.col("o_orderkey") % 3 == 0, "[a - b]").otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(""), F.lit(" - Error - [more"))
    return read(spark, d, "orders").select("o_orderkey", F.concat(texts.node_id(rest), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("")).alias("node"))


@query("text_test_counts", "select o_orderkey, case when o_custkey % 4 > 0 then o_custkey % 4 end::int as failed, o_custkey % 9 + 1 as passed, 2 as error from orders")
def text_test_counts(spark, d):
    failed = F.when(F.col("o_custkey") % 4 > 0, F.concat((F.col("o_custkey") % 4).cast("string"), F.lit(" failed, "))).otherwise("")
    out = F.concat(F.lit("1 passed so far\n== "), failed, (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(" passed, 2 errors in 3s ==\nbye"))
    counts = read(spark, d, "orders").select("o_orderkey", texts.test_counts(out).alias("c"))
    return counts.select("o_orderkey", F.col("c")["failed"].alias("failed"), F.col("c")["passed"].cast("long").alias("passed"), F.col("c")["error"].alias("error"))


_PRICE = {"input": 3.0, "cache_write_5m": 3.75, "cache_write_1h": 6.0, "cache_read": 0.3, "output": 15.0}
_TOKEN = {"input": "l_partkey", "cache_write_5m": "l_quantity::bigint", "cache_write_1h": "l_linenumber", "cache_read": "l_suppkey", "output": "l_quantity::bigint * 3"}


@query("usage_report", "with u as (select *, row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber desc, l_partkey desc, l_quantity desc) as n from lineitem), s as (select l_suppkey as trial, count(*) as api_calls, "
       + ", ".join(f"sum({c})::bigint as tok_{t}" for t, c in _TOKEN.items()) + " from u where n = 1 group by 1) select *, round((" + " + ".join(f"tok_{t} * {p}::double" for t, p in _PRICE.items()) + ") / 1e6, 4) as cost from s")
def usage_report(spark, d):
    """Suppliers as trials, orders as messages, their lines as repeated usage records."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("trial"), F.col("l_orderkey").alias("message"), "l_linenumber", "l_partkey", *[F.expr(c.replace("::bigint", "")).cast("long").alias(t) for t, c in _TOKEN.items()])
    return reports.last_usage(rows, ["trial"], "message", ["l_linenumber", "l_partkey"], price=_PRICE)


on_model(
    "trial_numbers",
    lambda t: reports.call_totals(t["steps"].where("tool is not null"), ["trial_id"], "tool", (F.unix_micros("t_end") - F.unix_micros("t_start")) / 1e6, F.length("output").cast("long"), digits=6).withColumn("tools", F.to_json("tools")),
    """select trial_id, '{' || string_agg('"' || tool || '":' || n, ',' order by tool) || '}' as tools, sum(n)::bigint as calls, round(sum(s), 6) as seconds, sum(b)::bigint as bytes, max(m) as largest
from (select trial_id, tool, count(*) as n, sum((epoch_us(t_end) - epoch_us(t_start)) / 1e6) as s, sum(length(output)) as b, max(length(output)) as m from steps where tool is not null group by all) group by 1""")


@query("flag_prefixes", "select split_part(f, ':', 1) as flag, count(distinct o_orderkey) as items from orders, unnest([o_orderpriority, o_orderstatus || ':x', o_orderstatus || ':y']) as u(f) group by 1")
def flag_prefixes(spark, d):
    flags = F.array("o_orderpriority", F.concat("o_orderstatus", F.lit(":x")), F.concat("o_orderstatus", F.lit(":y")))
    return reports.flag_prefixes(read(spark, d, "orders").select("o_orderkey", flags.alias("flags")), "flags")


@query("busiest_calls", """with e as (select user_id, event_type, epoch_us(ts) as us, event_id from events), c as (select user_id, us as a, coalesce(least(us + 7200000000, lead(us) over (partition by user_id order by us) - 1), us + 7200000000) as b from (select distinct user_id, us from e where event_type = 'view')),
k as (select c.user_id, a, b, count(*) as events from c join e on e.user_id = c.user_id and e.event_type <> 'view' and e.us between a and b group by all),
n as (select *, round(events / greatest((b - a) / 1e6, 1.0), 4) as rate from k)
select user_id, a, b, events, rate from n qualify row_number() over (partition by user_id order by rate desc, events desc, a) <= 3""")
def busiest_calls(spark, d):
    from pyspark.sql import Window

    e = read(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    starts = e.where("event_type = 'view'").select("user_id", F.col("us").alias("a")).distinct()
    end = F.col("a") + 7_200_000_000
    calls = starts.withColumn("b", F.coalesce(F.least(end, F.lead("a").over(Window.partitionBy("user_id").orderBy("a")) - 1), end))
    return reports.busiest(e.where("event_type <> 'view'"), calls, ["user_id"], "us", "a", "b")


@query("resumed_at", """select event_id, last_value(before ignore nulls) over (partition by user_id order by ts, event_id) as resumed from (select *, lag(case when event_type = 'error' then null when event_type = 'click' then epoch_us(ts) + 5 else epoch_us(ts) end) over (partition by user_id order by ts, event_id) as before from events)""")
def resumed_at(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    at = F.when(~F.col("event_type").isin("error", "click"), us)
    return reports.resumes(rows, ["user_id"], "o", at, F.when(F.col("event_type") == "click", us + 5)).select("event_id", F.col("resumed_at").alias("resumed"))


@query("call_to_point", "select o_custkey as trial, l_partkey as call, max(o_orderkey) as point from orders join lineitem on l_orderkey = o_orderkey group by all")
def call_to_point(spark, d):
    """Customers as trials, orders as points that cover the parts of their lines."""
    covered = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("covered"))
    points = read(spark, d, "orders").join(covered, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("trial"), F.col("o_orderkey").alias("index"), "covered")
    return reports.covering_points(points, ["trial"], "index", "covered")


@query("uncovered_calls", "select p_partkey, p_brand from part where p_size % 3 <> 0 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 40)")
def uncovered_calls(spark, d):
    points = read(spark, d, "lineitem").where("l_quantity > 40").select(F.array("l_partkey").alias("covered"))
    return reports.uncovered(read(spark, d, "part"), points, [], "p_partkey", "covered", F.col("p_size") % 3 == 0).select("p_partkey", "p_brand")


on_model(
    "detector_confusion",
    lambda t: reports.confusion(views.step_flags(t).join(t["steps"], ["trial_id", "step_idx"]).select(F.when(F.col("is_mutating"), "changed").when(F.col("has_error_marker"), "failed").alias("told"), F.col("tool").alias("truth")), "told", "truth"),
    "select coalesce(case when is_mutating then 'changed' when has_error_marker then 'failed' end, 'none') as told, coalesce(tool, 'none') as truth, count(*) as n from step_flags join steps using (trial_id, step_idx) group by all")
on_model(
    "first_event_positions",
    lambda t: reports.first_positions(views.step_flags(t).where("is_tool_call"), ["trial_id"], "step_idx", {"first_change": F.col("is_mutating"), "first_test": F.col("is_test_command"), "first_error": F.col("has_error_marker")}),
    "select trial_id, min(n) filter (where is_mutating) as first_change, min(n) filter (where is_test_command) as first_test, min(n) filter (where has_error_marker) as first_error from (select *, row_number() over (partition by trial_id order by step_idx) as n from step_flags where is_tool_call) group by 1")


@query("best_test_run", "select o_custkey as trial, o_custkey % 3 + o_orderkey % 5 as passed, o_orderkey % 3 as failed, o_orderkey as run from orders qualify row_number() over (partition by o_custkey order by o_custkey % 3 + o_orderkey % 5 desc, o_orderkey % 3, o_orderkey desc) = 1")
def best_test_run(spark, d):
    runs = read(spark, d, "orders").select(F.col("o_custkey").alias("trial"), (F.col("o_custkey") % 3 + F.col("o_orderkey") % 5).alias("passed"), (F.col("o_orderkey") % 3).alias("failed"), F.col("o_orderkey").alias("run"))
    return reports.best_run(runs, ["trial"], "passed", "failed", "run")


on_model(
    "quiet_first_cap",
    lambda t: reports.quiet_first(t["deltas"].groupBy("trial_id", "path").agg(F.count("*").alias("changes")), ["trial_id"], F.col("path").contains("__pycache__"), "path", 5),
    "select trial_id, path, changes, total from (select trial_id, path, count(*) as changes, count(*) over (partition by trial_id) as total, row_number() over (partition by trial_id order by contains(path, '__pycache__'), path) as n from deltas group by trial_id, path) where n <= 5")


@query("score_bins", "select bin, count(*) as n from (select case when o_totalprice >= 1000 and o_totalprice < 512000 then floor(log2(o_totalprice / 1000))::int end as bin from orders) group by 1")
def score_bins(spark, d):
    edges = [1000.0 * 2**i for i in range(10)]
    return read(spark, d, "orders").select(reports.bins(F.col("o_totalprice"), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


on_model(
    "job_summary",
    lambda t: reports.job_summary(t["trials"].join(t["steps"].groupBy("trial_id").agg(F.count("*").alias("n")), "trial_id", "left"), ["task"], F.col("reward").isNotNull(), F.col("reward") >= 1, F.col("n") > 1),
    "select task, count(*) as trials, count_if(reward is not null) as finished, count_if(coalesce(reward >= 1, false)) as passed, count_if(coalesce(n > 1, false)) as captured from trials left join (select trial_id, count(*) as n from steps group by 1) using (trial_id) group by 1")


@query("range_flags", "select o_custkey, case when min(o_orderkey) is null then '' when max(o_orderkey) <= 3000 then '1' when min(o_orderkey) > 3000 then '0' else '' end as within from orders group by 1")
def range_flags(spark, d):
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return per.select("o_custkey", texts.surely(F.col("lo"), F.col("hi"), 3000).alias("within"))


@query("mean_per_failure", "select o_orderstatus as source, round(avg(o_totalprice) filter (where o_custkey % 2 = 0), 4) as even, round(avg(o_totalprice) filter (where o_custkey % 2 = 1), 4) as odd from orders group by 1")
def mean_per_failure(spark, d):
    arm = F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd")
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), arm.alias("arm"), "o_totalprice")
    return rows.groupBy("source").pivot("arm", ["even", "odd"]).agg(F.round(F.avg("o_totalprice"), 4))
