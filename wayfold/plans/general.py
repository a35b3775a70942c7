"""Registered queries of the joins, windows, sets and statistics over the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import stats
from wayfold.operators import chains, joins, timeline
from wayfold.plans.catalog import ORACLE, QUERIES, register  # noqa: F401
from wayfold.sources.adapter import read


def query(name: str, sql: str | None = None):
    def take(build):
        register(name, build, sql)
        return build

    return take


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_EV = "ev as (select *, epoch_us(ts) as us, json_extract_string(props, '$.k')::int as k from events)"


@query("join_asof_backward", f"with {_EV} select p.event_id, max_by(v.event_id, v.us) as view_id, max(v.us) as view_us from ev p left join ev v on v.user_id = p.user_id and v.event_type = 'view' and v.us <= p.us where p.event_type = 'purchase' group by p.event_id")
def asof_backward(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"), F.col("us").alias("view_us"))
    return joins.asof(left, right, ["user_id"], "us", ["view_id", "view_us"]).select("event_id", "view_id", "view_us")


@query("join_asof_forward", f"with {_EV} select p.event_id, min_by(v.event_id, v.us) as next_error from ev p left join ev v on v.user_id = p.user_id and v.event_type = 'error' and v.us >= p.us where p.event_type = 'signup' group by p.event_id")
def asof_forward(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'signup'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'error'").select("user_id", "us", F.col("event_id").alias("next_error"))
    return joins.asof(left, right, ["user_id"], "us", ["next_error"], forward=True).select("event_id", "next_error")


_SPAN = "sp as (select event_id as job, user_id, us as a, case when k % 9 > 0 then us + floor(value * 60000000)::bigint end as b from ev where event_type = 'view')"


def _spans(e: DataFrame) -> DataFrame:
    end = F.when(F.col("k") % 9 > 0, F.col("us") + F.floor(F.col("value") * 60_000_000).cast("long"))
    return e.where("event_type = 'view'").select(F.col("event_id").alias("job"), "user_id", F.col("us").alias("a"), end.alias("b"))


@query("join_interval", f"with {_EV}, {_SPAN} select event_id, job from ev join sp using (user_id) where event_type = 'purchase' and us >= a and (b is null or us <= b)")
def interval_join(spark, d):
    e = _events(spark, d)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    return joins.interval(points, _spans(e), ["user_id"], "us", "a", "b", 12 * 3600 * 10**6).select("event_id", "job")


@query("join_unique_window", f"with {_EV}, {_SPAN} select event_id, any_value(job) as job from ev join sp using (user_id) where event_type = 'purchase' and us >= a and us <= b group by event_id having count(*) = 1")
def unique_window(spark, d):
    e = _events(spark, d)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    return joins.in_one_span(points, _spans(e).where("b is not null"), ["user_id"], ["event_id"], "us", "a", "b", 12 * 3600 * 10**6, "job")


def _paths(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"^[^:]*:/(/[^?#]*)", 1), r"/\z", "").alias("path"))


_PATHS = r"pth as (select page_id, regexp_replace(regexp_extract(url, '^[^:]*:/(/[^?#]*)', 1), '/\z', '') as path from pages)"


@query("join_prefix", f"with {_PATHS}, roots as (select distinct regexp_extract(path, '^/[^/]*/[^/]*') as root from pth where page_id % 10 = 3) select page_id, path from pth where exists (select 1 from roots where path = root or starts_with(path, root || '/'))")
def prefix_join(spark, d):
    p = _paths(spark, d)
    roots = p.where("page_id % 10 = 3").select(F.regexp_extract("path", r"^/[^/]*/[^/]*", 0).alias("root")).distinct()
    return joins.under(p, roots)


@query("join_prefix_anti", f"with {_PATHS}, roots as (select distinct regexp_extract(path, '^/[^/]*/[^/]*') as root from pth where page_id % 10 = 3) select page_id, path from pth where not exists (select 1 from roots where path = root or starts_with(path, root || '/'))")
def prefix_anti(spark, d):
    p = _paths(spark, d)
    roots = p.where("page_id % 10 = 3").select(F.regexp_extract("path", r"^/[^/]*/[^/]*", 0).alias("root")).distinct()
    return joins.under(p, roots, how="left_anti")


@query("join_ancestor_carrier", f"with {_PATHS}, car as (select path, min(page_id) as carrier from (select distinct regexp_extract(path, '^/[^/]*') as path, page_id from pth where page_id % 4 = 1 union select distinct regexp_extract(path, '^/[^/]*/[^/]*'), page_id from pth where page_id % 4 = 2) group by 1) select p.path, arg_max(carrier, length(c.path)) as carrier from (select distinct path from pth) p join car c on starts_with(p.path, c.path || '/') group by 1")
def ancestor_carrier(spark, d):
    p = _paths(spark, d)
    one = p.where("page_id % 4 = 1").select(F.regexp_extract("path", r"^/[^/]*", 0).alias("path"), "page_id")
    two = p.where("page_id % 4 = 2").select(F.regexp_extract("path", r"^/[^/]*/[^/]*", 0).alias("path"), "page_id")
    carriers = one.union(two).groupBy("path").agg(F.min("page_id").alias("carrier"))
    return joins.nearest_ancestor(p.select("path").distinct(), carriers, [], ["carrier"])


@query("leak_check", r"select distinct doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) and regexp_matches(d.text, '(^|[^A-Za-z0-9_])' || regexp_escape(b.text) || '($|[^A-Za-z0-9_])')")
def leak_check(spark, d):
    return joins.mentions(read(spark, d, "documents"), read(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")), "doc_id", "text", "item_id", "needle")


@query("join_full_outer_maps", "with a as (select p_partkey as path, p_size as v from part where p_partkey % 3 > 0), b as (select p_partkey as path, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as v from part where p_partkey % 4 > 0) select path, case when a.v is null then 'add' when b.v is null then 'delete' else 'modify' end as change from a full join b using (path) where a.v is distinct from b.v")
def full_outer_maps(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("v"))
    return joins.full_outer(p.where("path % 3 > 0"), p.where("path % 4 > 0").withColumn("v", F.when(F.col("path") % 5 == 0, F.col("v") + 1).otherwise(F.col("v"))), ["path"], "v")


@query("join_priority_cascade", "select s_suppkey, coalesce(a.v, b.v, c.v) as v, case when a.v is not null then 'name' when b.v is not null then 'nation' when c.v is not null then 'rest' end as mapped_by from supplier left join (select s_suppkey, 1 as v from supplier where s_suppkey % 3 = 0) a using (s_suppkey) left join (select s_suppkey, s_nationkey as v from supplier where s_nationkey < 12) b using (s_suppkey) left join (select s_suppkey, -1 as v from supplier where s_acctbal > 0) c using (s_suppkey)")
def priority_cascade(spark, d):
    s = read(spark, d, "supplier")
    rules = [("name", s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(1).alias("v"))), ("nation", s.where("s_nationkey < 12").select("s_suppkey", F.col("s_nationkey").alias("v"))), ("rest", s.where("s_acctbal > 0").select("s_suppkey", F.lit(-1).alias("v")))]
    return joins.cascade(s.select("s_suppkey"), rules, ["s_suppkey"], "v")


@query("join_semi", "select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 49)")
def semi(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").join(read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("join_anti", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_name").join(read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join_star", "select n_name, r_name, count(*) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderstatus = 'F' group by all")
def star(spark, d):
    t = {x: read(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"].where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# Aggregates.
@query("agg_filtered", "select l_returnflag, count(*) as n, count(*) filter (where l_quantity > 25) as large, count(distinct l_suppkey) filter (where l_discount > 0.05) as suppliers, arg_max(l_partkey, l_extendedprice) as dearest, bool_or(l_tax > 0.07) as taxed, greatest(max(l_quantity), max(l_linenumber)) as top from lineitem group by 1")
def agg_filtered(spark, d):
    """Of lines of one price the dearest is the first in the table, by file and row."""
    f, lines = F.col, read(spark, d, "lineitem")
    out = lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(f("l_quantity") > 25).alias("large"), F.countDistinct(F.when(f("l_discount") > 0.05, f("l_suppkey"))).alias("suppliers"),
        F.max(F.when(f("l_partkey").isNotNull(), f("l_extendedprice"))).alias("_price"), F.bool_or(f("l_tax") > 0.07).alias("taxed"), F.greatest(F.max("l_quantity"), F.max("l_linenumber")).alias("top"))
    placed = lines.where("l_partkey is not null").select(f("l_returnflag").alias("_flag"), "l_partkey", f("l_extendedprice").alias("_of"), F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    price = out.select(f("l_returnflag").alias("_group"), "_price")
    first = placed.join(F.broadcast(price), f("_flag").eqNullSafe(f("_group")) & (f("_of") == f("_price"))).groupBy("_flag").agg(F.min_by("l_partkey", "_at").alias("dearest"))
    return out.join(first, f("l_returnflag").eqNullSafe(f("_flag")), "left").select("l_returnflag", "n", "large", "suppliers", "dearest", "taxed", "top")


@query("agg_quantiles", "select o_orderpriority, round(median(o_totalprice), 4) as median, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.75), 4) as q3, round(exp(avg(ln(o_totalprice))), 4) as geomean from orders group by 1")
def agg_quantiles(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.round(F.median(p), 4).alias("median"), F.round(F.percentile(p, 0.25), 4).alias("q1"), F.round(F.percentile(p, 0.75), 4).alias("q3"), F.round(F.exp(F.avg(F.log(p))), 4).alias("geomean"))


@query("agg_p95_nearest_rank", "select event_type, list_sort(list(value))[greatest(least(round_even(0.95 * count(*), 0)::int, count(*)), 1)] as p95 from events group by 1")
def agg_p95(spark, d):
    return stats.p95_nearest(read(spark, d, "events"), ["event_type"], "value", "p95")


@query("agg_pivot_crosstab", "select user_id, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type in ('view', 'click', 'error')) as total from events group by 1")
def crosstab(spark, d):
    kinds = ["view", "click", "error"]
    rows = read(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    rows = rows.na.fill(0, kinds)
    return rows.withColumn("total", sum(F.col(k) for k in kinds))


@query("agg_list_ordered", "select user_id, string_agg(event_type, ',' order by ts, event_id) as types, arg_max(event_type, ts) as last_type from events where event_type <> 'view' group by 1")
def list_ordered(spark, d):
    e = read(spark, d, "events").where("event_type <> 'view'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(F.array_join(ordered, ",").alias("types"), F.max_by("event_type", "ts").alias("last_type"))


@query("agg_peak_per_second", "select user_id, max(n)::bigint as peak from (select user_id, date_trunc('hour', ts) as h, count(*) as n from events group by all) group by 1")
def peak(spark, d):
    return read(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("peak"))


@query("agg_rollup", "select coalesce(l_returnflag, 'all') as flag, coalesce(l_linestatus, 'all') as status, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(spark, d):
    rows = read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n")


# Windows.
@query("win_forward_fill", "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id) as state, max(value) over (partition by user_id order by ts, event_id) as high from events")
def forward_fill(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return read(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("state"), F.max("value").over(w).alias("high"))


@query("win_prev_same_key", "select event_id, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as before, row_number() over (partition by user_id, event_type order by ts, event_id) as nth, dense_rank() over (partition by user_id order by event_type) as kind from events")
def prev_same_key(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.row_number().over(w).alias("nth"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind"))


@query("win_top1", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1")
def top1(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("m"))).alias("b")).select("user_id", (-F.col("b.m")).alias("event_id"), "b.value")


@query("win_mid_ranks", "select c_custkey, rank() over (partition by c_mktsegment order by floor(c_acctbal / 500)) + (count(*) over (partition by c_mktsegment, floor(c_acctbal / 500)) - 1) / 2.0 as r from customer")
def mid_ranks(spark, d):
    return read(spark, d, "customer").withColumn("b", F.floor(F.col("c_acctbal") / 500)).select("c_custkey", stats.mid_rank("b", ["c_mktsegment"]).alias("r"))


@query("win_state_change", "select o_orderkey from orders qualify lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) <> o_orderstatus")
def state_change(spark, d):
    rows = read(spark, d, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return timeline.state_changes(rows, ["o_custkey"], "i", "o_orderstatus").select("o_orderkey")


# Sets.
_A, _B = "(select l_partkey, l_linenumber from lineitem where l_quantity < 10)", "(select l_partkey, l_linenumber from lineitem where l_discount > 0.04)"


def _sets(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.where("l_quantity < 10").select("l_partkey", "l_linenumber"), rows.where("l_discount > 0.04").select("l_partkey", "l_linenumber")


@query("set_except_all", f"select 'missing' as side, * from ({_A} except all {_B}) union all select 'extra', * from ({_B} except all {_A})")
def except_all(spark, d):
    a, b = _sets(spark, d)
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("extra").alias("side"), "*"))


@query("set_intersect", f"{_A} intersect {_B}")
def intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query("set_union_distinct", f"{_A} union {_B}")
def union_distinct(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query("set_relation", "with s as (select l_orderkey, list(distinct l_returnflag) as a, list(distinct l_linestatus || '') as b0, list(distinct case when l_tax > 0.04 then l_returnflag end) filter (where l_tax > 0.04) as b from lineitem group by 1) select l_orderkey, case when len(list_filter(a, lambda x: not list_contains(coalesce(b, []), x))) = 0 then 'same' else 'subset' end as relation from s")
def set_relation(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_tax") > 0.04, F.col("l_returnflag"))).alias("b"))
    more, less = F.size(F.array_except("a", "b")) > 0, F.size(F.array_except("b", "a")) > 0
    return rows.select("l_orderkey", F.when(more & less, "different").when(more, "subset").when(less, "superset").otherwise("same").alias("relation"))


# Statistics.
_RATED = "r as (select doc_id % 5 as pattern, quality = 1 as a, toxic = 1 as b from labels)"


@query("stat_agreement_table", f"with {_RATED}, c as (select pattern, count(*) as n, count_if(a and b) as both_yes, count_if(a and not b) as a_only, count_if(not a and b) as b_only, count_if(not a and not b) as both_no from r group by 1), p as (select *, (both_yes + a_only) / n as pa, (both_yes + b_only) / n as pb from c), q as (select *, pa * pb + (1 - pa) * (1 - pb) as e from p) select pattern, n, both_yes, a_only, b_only, both_no, round(((both_yes + both_no) / n - e) / nullif(1 - e, 0), 9) as kappa from q")
def agreement(spark, d):
    rows = read(spark, d, "labels").select((F.col("doc_id") % 5).alias("pattern"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return stats.agreement(rows, ["pattern"], "a", "b")


@query("stat_cohen_kappa", f"with {_RATED}, p as (select avg(a::int) as pa, avg(b::int) as pb, avg((a = b)::int) as o from r) select round((o - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 9) as kappa from p")
def cohen(spark, d):
    return read(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")).agg(F.round(stats.kappa("a", "b"), 9).alias("kappa"))


@query("stat_fisher_2x2")
def fisher(spark, d):
    counts = [F.count_if((F.col("quality") == q) & (F.col("doc_id") % 2 == t)).alias(n) for n, q, t in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))]
    rows = read(spark, d, "labels").groupBy((F.col("doc_id") % 40).alias("g")).agg(*counts)
    rows = rows.withColumn("p", F.round(stats.fisher_2x2("a", "b", "c", "d"), 9))
    return rows.select("g", "p", F.round(stats.holm("p", []), 9).alias("adjusted"))


@query("stat_holm", "with p as (select p_partkey % 50 as g, p_partkey % 3 as f, least(1.0, p_size / 50.0 * (p_partkey % 50 + 1) / 50.0) as p from part), r as (select *, (count(*) over (partition by f) - row_number() over (partition by f order by p, g) + 1) * p as x from p) select f, round(max(a), 9) as worst, round(sum(a), 6) as total from (select f, least(1.0, max(x) over (partition by f order by p, g rows unbounded preceding)) as a from r) group by 1")
def holm(spark, d):
    p = read(spark, d, "part").select((F.col("p_partkey") % 3).alias("f"), F.least(F.lit(1.0), F.col("p_size") / 50.0 * (F.col("p_partkey") % 50 + 1) / 50.0).alias("p"))
    return p.withColumn("a", stats.holm("p", ["f"])).groupBy("f").agg(F.round(F.max("a"), 9).alias("worst"), F.round(F.sum("a"), 6).alias("total"))


@query("stat_friedman", "with v as (select n_nationkey as block, m as arm, count(*) as x from nation join customer on c_nationkey = n_nationkey cross join (select 0 as m union all select 1 union all select 2) where c_custkey % 3 >= m group by all), k as (select block from v group by 1 having count(*) = 3), r as (select arm, rank() over (partition by block order by x) + (count(*) over (partition by block, x) - 1) / 2.0 as r from v where block in (select block from k)), s as (select arm, sum(r) as s, count(*) as n from r group by 1) select max(n) as blocks, count(*) as arms, round(12 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1), 6) as chi2 from s")
def friedman(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.withColumn("arm", F.explode(F.array(*[F.lit(i) for i in range(3)]))).where(F.col("c_custkey") % 3 >= F.col("arm")).groupBy(F.col("n_nationkey").alias("block"), "arm").agg(F.count("*").alias("x"))
    whole = v.groupBy("block").agg(F.count("*").alias("k")).where("k = 3").select("block")
    return stats.friedman(v.join(whole, "block", "left_semi"), "block", "arm", "x")


_FAMILY = "with p as (select p_partkey // 20 as f, p_partkey as g, least(1.0, p_size / 50.0 * (p_partkey % 50 + 1) / 50.0) as p from part), r as (select *, (count(*) over (partition by f) - row_number() over (partition by f order by p, g) + 1) * p as x from p) select f, round(max(a), 9) as worst, round(sum(a), 6) as total from (select f, least(1.0, max(x) over (partition by f order by p, g rows unbounded preceding)) as a from r) group by 1"


def _of_twenty():
    """Twenty parts to a sample, so that exact tests stay small and take in the whole table."""
    return F.floor(F.col("p_partkey") / 20).alias("g")


@query("stat_holm_families", _FAMILY)
def holm_families(spark, d):
    p = read(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("f"), F.least(F.lit(1.0), F.col("p_size") / 50.0 * (F.col("p_partkey") % 50 + 1) / 50.0).alias("p"))
    return p.withColumn("a", stats.holm("p", ["f"])).groupBy("f").agg(F.round(F.max("a"), 9).alias("worst"), F.round(F.sum("a"), 6).alias("total"))


@query("stat_rank_sum")
def rank_sum(spark, d):
    rows = read(spark, d, "part").select(_of_twenty(), (F.col("p_partkey") % 3).alias("stratum"), (F.col("p_partkey") % 7 < 3).alias("first"), F.col("p_size").cast("double").alias("v"))

    def test(part):
        return stats.rank_sum([(s[s["first"]]["v"].tolist(), s[~s["first"]]["v"].tolist()) for _, s in part.groupby("stratum")])

    return stats.grouped(rows, ["g"], test).withColumn("p", F.round("p", 9))


@query("stat_wilcoxon_exact")
def wilcoxon(spark, d):
    rows = read(spark, d, "part").select(_of_twenty(), (F.col("p_size") - 24).cast("double").alias("v"))
    return stats.grouped(rows, ["g"], lambda part: stats.wilcoxon(part["v"].tolist())).withColumn("p", F.round("p", 9))


@query("stat_freeman_halton")
def freeman_halton(spark, d):
    rows = read(spark, d, "part").select(_of_twenty(), (F.col("p_partkey") % 3).alias("r"), (F.col("p_size") > 25).alias("y"))

    def test(part):
        return stats.freeman_halton([(int(s["y"].sum()), int((~s["y"]).sum())) for _, s in part.groupby("r")])

    return stats.grouped(rows, ["g"], test).withColumn("p", F.round("p", 9))


@query("stat_bootstrap_ci")
def bootstrap(spark, d):
    rows = read(spark, d, "part").select((F.col("p_partkey") % 4).alias("g"), F.col("p_size").cast("double").alias("v"))
    return stats.bootstrap_mean(rows, ["g"], "v", 500)


@query("stat_normalized_score", "select c_custkey, least(greatest(c_acctbal / 5000, 0), 1) as score, case when c_acctbal < 0 then '0' when c_acctbal > 5000 then '1' else '' end as flag, floor(c_acctbal / 1000)::bigint as bin from customer")
def normalized(spark, d):
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.least(F.greatest(b / 5000, F.lit(0.0)), F.lit(1.0)).alias("score"), F.when(b < 0, "0").when(b > 5000, "1").otherwise("").alias("flag"), F.floor(b / 1000).alias("bin"))


# Chains of attempts: orders of a customer.
_CHAIN = "att as (select o_custkey as chain, o_custkey % 5 as task, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as attempt, o_orderstatus = 'F' as passed, o_orderpriority as answer, o_totalprice as score, o_orderdate as started, o_orderkey as name from orders)"


def _attempts(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select(
        F.col("o_custkey").alias("chain"), (F.col("o_custkey") % 5).alias("task"), F.row_number().over(w).alias("attempt"), (F.col("o_orderstatus") == "F").alias("passed"),
        F.col("o_orderpriority").alias("answer"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("started"), F.col("o_orderkey").alias("name"))


@query("agg_solved_by_k", f"with {_CHAIN}, c as (select task, chain, min(attempt) filter (where passed) as f, max(attempt) as n from att group by all) select task, k, count_if(coalesce(f <= k, false)) as solved, count_if(coalesce(f <= k, false) or n >= k) as known from c, unnest(range(1, 9)) as u(k) group by all")
def solved_by_k(spark, d):
    return chains.solved_by(_attempts(spark, d), ["task"], 8)


@query("win_set_seen_before", f"with {_CHAIN} select task, count(*) as attempts, count(*) - count(distinct chain || ':' || answer) as repeats from att group by 1")
def seen_before(spark, d):
    return chains.seen_before(_attempts(spark, d), ["chain"]).groupBy("task").agg(F.count("*").alias("attempts"), F.count_if("repeat").alias("repeats"))


@query("win_carry_last_score", f"with {_CHAIN}, s as (select chain, attempt, least(score / 200000, 1) as score from att where attempt <= 10) select chain, k as attempt, coalesce(s.score, l.score) as score from (select chain, arg_max(score, attempt) as score from s group by 1) l cross join unnest(range(1, 11)) as u(k) left join s on s.chain = l.chain and s.attempt = k".replace("select chain, k as attempt", "select l.chain as chain, k as attempt"))
def carried(spark, d):
    return chains.carried_scores(_attempts(spark, d), ["chain"], 10, 200_000.0)


@query("root_choice", f"with {_CHAIN}, m as (select task, median(score) as m from att group by 1), r as (select name, task, row_number() over (partition by task order by abs(score - m), started, name) as place from att join m using (task) where not passed) select task, name, place from r where place <= 2")
def roots(spark, d):
    return chains.root_choice(_attempts(spark, d)).select("task", "name", "place")


@query("funnel", f"with {_CHAIN} select count_if(true) as attempts, count_if(passed) as passed, count_if(passed and score > 50000) as costly, count_if(passed and score > 50000 and attempt > 3) as late from att")
def funnel(spark, d):
    return chains.funnel(_attempts(spark, d), [("attempts", "true"), ("passed", "passed"), ("costly", "score > 50000"), ("late", "attempt > 3")])


# Timelines: line numbers of an order's customer as checks, orders as points.
_LINE = "tl as (select l_suppkey as trial, l_linenumber as chk, row_number() over (partition by l_suppkey, l_linenumber order by l_shipdate, l_orderkey, l_partkey) - 1 as idx, case when l_discount = 0.1 then 'flaky' when l_returnflag = 'A' then 'failed' else 'passed' end as status from lineitem)"


def _timeline(spark, d, rows: str = "true") -> DataFrame:
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_shipdate", "l_orderkey", "l_partkey")
    status = F.when(F.col("l_discount") == 0.1, "flaky").when(F.col("l_returnflag") == "A", "failed").otherwise("passed")
    return read(spark, d, "lineitem").where(rows).select(F.col("l_suppkey").alias("trial"), F.col("l_linenumber").alias("check"), (F.row_number().over(w) - 1).alias("index"), status.alias("status"))


@query("check_classify", f"""with {_LINE}, p as (select trial, chk, list(status order by idx) as s from tl group by all),
q as (select *, len(s) as n, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda i: s[i] = 'passed')), 0) as lp, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda i: s[i] <> 'passed')), 0) as lo, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda i: s[i] = 'flaky')), 0) as lf from p),
v as (select *, case when lp = n then case when lo > 0 and s[lo] = 'flaky' then 'unstable' else 'passes' end when lp = 0 then case when lf > 0 then 'unstable' else 'never_passed' end when lf > lp then 'unstable' else 'regression' end as verdict from q)
select trial, chk as "check", verdict, case verdict when 'passes' then lo when 'regression' then lp end as point, case when verdict = 'regression' then lp - 1 end as last_pass from v""")
def check_classify(spark, d):
    return timeline.classify(_timeline(spark, d), ["trial", "check"])


@query("status_marks", f"with {_LINE} select trial, chk as \"check\", string_agg(case status when 'passed' then 'P' when 'failed' then 'F' else '~' end, '' order by idx) as marks from tl group by all")
def status_marks(spark, d):
    return timeline.status_marks(_timeline(spark, d), ["trial"])


_SAMPLE = "sm as (select l_suppkey as trial, l_orderkey % 7 as state, l_orderkey as sample, l_linenumber as chk, min(l_returnflag) as status from lineitem group by all)"


#: Rows of a task where a table is dealt out by its size.
PART_ROWS = 500_000


def _samples(spark, d, states: int = 7) -> DataFrame:
    """Dealt once by trial and state, which every later group of rows has in its key; as many parts as the rows ask for, so that a task's share
    does not grow with the table."""
    rows = read(spark, d, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS)
    rows = rows.select(F.col("l_suppkey").alias("trial"), (F.col("l_orderkey") % states).alias("state"), F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("check"), "l_returnflag")
    return rows.repartition(parts, "trial", "state").groupBy("trial", "state", "sample", "check").agg(F.min("l_returnflag").alias("status"))


@query("stat_quorum_verdict", f"with {_SAMPLE}, st as (select trial, state, count(distinct sample) as a from sm group by all), ck as (select distinct trial, chk from sm) select st.trial, st.state, ck.chk as \"check\", case when count(sm.sample) = 0 then 'absent' when count(distinct sm.sample) < any_value(a) or count(distinct status) > 1 then 'flaky' else min(status) end as status, count(distinct sm.sample) as samples from st join ck using (trial) left join sm on sm.trial = st.trial and sm.state = st.state and sm.chk = ck.chk group by st.trial, st.state, ck.chk")
def quorum(spark, d):
    return timeline.verdicts(_samples(spark, d), ["trial"])


@query("plan_replays", f"with {_SAMPLE.replace('% 7', '% 997')}, n as (select trial, state, count(distinct sample) as n from sm group by all) select trial, state, w as wave from n, unnest(range(n + 1, 4)) as u(w)")
def plan_replays(spark, d):
    s = _samples(spark, d, states=997)
    return timeline.missing_replays(s.select("trial", "state").distinct(), s, ["trial"])

