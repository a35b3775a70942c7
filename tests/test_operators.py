"""Joins, statistics, timelines, chains, reconcile and steps against brute force and small cases."""

import random
from itertools import combinations, product
from math import comb

import pytest
from pyspark.sql import functions as F
from wayfold.functions import schemas, stats
from wayfold.operators import chains, joins, reconcile, steps, timeline


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_asof_against_brute_force(spark):
    draw = random.Random(1)
    left = [(i, draw.randrange(4), draw.randrange(60)) for i in range(80)]
    right = [(draw.randrange(4), t, t * 10) for t in draw.sample(range(60), 25)]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    for forward, strict in product((False, True), repeat=2):
        fits = (lambda x, t: x > t if strict else x >= t) if forward else (lambda x, t: x < t if strict else x <= t)
        expect = sorted((i, ((min if forward else max)(hit) if (hit := [v for rk, rt, v in right if rk == k and fits(rt, t)]) else None)) for i, k, t in left)
        assert rows(joins.asof(a, b, ["k"], "t", ["v"], forward, strict), "id", "v") == expect


def test_interval_against_brute_force(spark):
    draw = random.Random(2)
    points = [(i, draw.randrange(3), draw.randrange(1000)) for i in range(120)]
    spans = [(i, draw.randrange(3), s := draw.randrange(1000), None if draw.random() < 0.2 else s + draw.randrange(-20, 300)) for i in range(40)]
    a, b = spark.createDataFrame(points, "p int, k int, t long"), spark.createDataFrame(spans, "s int, k int, a long, b long")
    expect = sorted((p, s) for p, k, t in points for s, k2, x, y in spans if k == k2 and x <= t and (y is None or t <= y))
    for width in (7, 100, 5000):
        assert rows(joins.interval(a, b, ["k"], "t", "a", "b", width), "p", "s") == expect


def test_prefix_joins_against_brute_force(spark):
    draw = random.Random(3)
    paths = sorted({"/" + "/".join(draw.choice("abc") for _ in range(draw.randrange(1, 5))) for _ in range(80)})
    roots = draw.sample(paths, 8) + ["/zz"]
    p, r = spark.createDataFrame([(x,) for x in paths], "path string"), spark.createDataFrame([(x,) for x in roots], "root string")
    inside = [x for x in paths if any(x == y or x.startswith(y + "/") for y in roots)]
    assert [x for (x,) in rows(joins.under(p, r), "path")] == inside
    assert [x for (x,) in rows(joins.under(p, r, how="left_anti"), "path")] == [x for x in paths if x not in inside]
    carriers = spark.createDataFrame([(x, x.upper()) for x in roots], "path string, name string")
    expect = sorted((x, max(above, key=len).upper()) for x in paths if (above := [y for y in roots if x.startswith(y + "/")]))
    assert rows(joins.nearest_ancestor(p, carriers, [], ["name"]), "path", "name") == expect


def test_ancestors(spark):
    row = spark.createDataFrame([("/a/b/c",), ("/a",), ("/",)], "p string").select("p", joins.ancestors(F.col("p")).alias("x"), joins.ancestors(F.col("p"), True).alias("y")).collect()
    assert {r.p: r.x for r in row} == {"/a/b/c": ["/a/b", "/a"], "/a": [], "/": []} and row[0].y == ["/a/b/c", "/a/b", "/a"]


def test_mentions_stand_alone(spark):
    texts = spark.createDataFrame([(1, "call do_it(x) now"), (2, "undo_it"), (3, "a.b*c and \\Ed"), (4, None)], "id int, text string")
    needles = spark.createDataFrame([("f", "do_it"), ("g", "b*c"), ("h", "\\Ed"), ("i", "***")], "name string, needle string")
    assert rows(joins.mentions(texts, needles, "id", "text", "name", "needle")) == [(1, "f"), (3, "g"), (3, "h")]


def test_exact_tests():
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.48571428571428577)
    assert stats.fisher(8, 2, 1, 5) == pytest.approx(0.03496503496503495)
    assert stats.freeman_halton([(3, 1), (1, 3)]) == pytest.approx(stats.fisher(3, 1, 1, 3))
    table = [(3, 0), (1, 2), (0, 4)]
    sizes, col = [3, 3, 4], 4
    weight = lambda xs: comb(3, xs[0]) * comb(3, xs[1]) * comb(4, xs[2])
    every = [x for x in product(range(4), range(4), range(5)) if sum(x) == col]
    seen = weight([3, 1, 0])
    assert stats.freeman_halton(table) == pytest.approx(sum(weight(x) for x in every if weight(x) <= seen) / sum(weight(x) for x in every)) and sum(sizes) == 10
    d = [3.0, -1.0, 2.0, 2.0, 0.0, -0.5, 4.0]
    used = [x for x in d if x]
    order = sorted(abs(x) for x in used)
    rank = [(order.index(abs(x)) + 1 + len(order) - order[::-1].index(abs(x))) / 2 for x in used]
    far = abs(sum(r for r, x in zip(rank, used, strict=True) if x > 0) - sum(rank) / 2)
    sums = [sum(c) for n in range(len(used) + 1) for c in combinations(rank, n)]
    assert stats.wilcoxon(d) == pytest.approx(sum(abs(s - sum(rank) / 2) >= far - 1e-9 for s in sums) / len(sums))
    a, b = [1.0, 2.0, 2.0], [2.0, 5.0, 6.0]
    pooled = a + b
    mid = {v: (sorted(pooled).index(v) + 1 + 6 - sorted(pooled)[::-1].index(v)) / 2 for v in pooled}
    every = [sum(mid[pooled[i]] for i in c) for c in combinations(range(6), 3)]
    seen, mean = sum(mid[v] for v in a), sum(every) / len(every)
    assert stats.rank_sum([(a, b)]) == pytest.approx(sum(abs(x - mean) >= abs(seen - mean) - 1e-9 for x in every) / len(every))


def test_kappa_without_a_chance(spark):
    df = spark.createDataFrame([(True, True), (True, True)], "a boolean, b boolean")
    assert df.agg(stats.kappa("a", "b")).first()[0] is None and df.limit(0).agg(stats.kappa("a", "b")).first()[0] is None


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(100)], "g string, v double")
    (r,) = stats.bootstrap_mean(df, ["g"], "v", 400).collect()
    assert 40 < r.low < 49.5 < r.high < 59


@pytest.mark.parametrize("marks,verdict,point,last", [
    ("FPP", "passes", 1, None), ("PPP", "passes", 0, None), ("~PP", "unstable", None, None), ("P~PP", "unstable", None, None), ("FFF", "never_passed", None, None), ("F~F", "unstable", None, None),
    ("PFF", "regression", 1, 0), ("FPF", "regression", 2, 1), ("PF~", "unstable", None, None), ("~PF", "regression", 2, 1), ("P F", "incomplete", None, None), ("P?P", "incomplete", None, None), ("-P", "passes", 1, None), ("P-", "regression", 1, 0)])
def test_classify(spark, marks, verdict, point, last):
    names = {"P": "passed", "F": "failed", "~": "flaky", " ": None, "?": "unknown", "-": "absent"}
    df = spark.createDataFrame([("c", i, names[m]) for i, m in enumerate(marks)], "check string, index int, status string")
    (r,) = timeline.classify(df, ["check"]).collect()
    assert (r.verdict, r.point, r.last_pass) == (verdict, point, last)


def test_fix_sets_and_state_ids(spark):
    base = spark.createDataFrame([("f", "a", "passed"), ("f", "b", "failed"), ("f", "c", "failed"), ("f", "d", "flaky")], "fix string, check string, status string")
    tried = spark.createDataFrame([("f", "a", "failed"), ("f", "b", "passed"), ("f", "c", "failed"), ("f", "d", "passed")], "fix string, check string, status string")
    assert rows(timeline.fix_sets(base, tried, ["fix"])) == [("f", ["b"], ["a"], ["c"])]
    e = spark.createDataFrame([(1, "/a", "file", "x"), (1, "/b", "dir", None), (2, "/b", "dir", None), (2, "/a", "file", "x"), (3, "/a", "file", "y")], "s int, path string, kind string, sha256 string")
    ids = dict(rows(timeline.state_id(e, ["s"])))
    assert ids[1] == ids[2] != ids[3]


def test_chains(spark):
    a = spark.createDataFrame([("x", "t0", None, 0), ("x", "t1", "t0", 1), ("y", "u0", None, 0), ("y", "u2", "u0", 2), ("z", "v0", "q", 0)], "chain string, trial_id string, parent_trial_id string, attempt_idx int")
    assert rows(chains.broken_chains(a)) == [("y",), ("z",)]
    s = spark.createDataFrame([("x", 0, "failed", True), ("x", 1, "passed", True), ("y", 0, "failed", False), ("z", 0, "lost", False), ("w", 0, "failed", True), ("v", 0, "failed", True), ("v", 1, "failed", True)], "chain string, attempt_idx int, outcome string, ingested boolean")
    assert rows(chains.next_step(s, 2), "chain", "needs") == [("v", "done"), ("w", "launch"), ("x", "done"), ("y", "ingest"), ("z", "stopped")]


def test_fold_against_applying_layers(spark):
    draw = random.Random(5)
    names = ["/a", "/a/b", "/a/b/c", "/a/d", "/e", "/e/f"]
    layers = []
    for seq in range(6):
        for path in draw.sample(names, 3):
            kind = draw.choice(["file", "dir", "whiteout", "opaque"])
            layers.append(("t", seq, path, kind if kind in ("whiteout", "opaque") else None, None if kind in ("whiteout", "opaque") else kind, "0644", "0:0", f"{draw.randrange(3)}"))
    view, expect, before, changed = {}, [], None, []
    for seq in range(6):
        new = {p: (k, s) for _, q, p, m, k, _, _, s in layers if q == seq and m is None}
        for _, q, p, m, k, *_ in layers:
            if q == seq:
                gone = [x for x in view if (x == p and m == "whiteout") or (x.startswith(p + "/") and (m or k != "dir"))]
                view = {x: v for x, v in view.items() if x not in gone}
        view |= new
        expect += [("t", seq, p, *v) for p, v in view.items()]
        if before is not None:
            changed += [("t", seq, p, "add" if p not in before else "delete" if p not in view else "modify") for p in {*before, *view} if before.get(p) != view.get(p)]
        before = dict(view)
    df = spark.createDataFrame(layers, "trial_id string, seq int, path string, marker string, kind string, mode string, owner string, sha256 string")
    views = spark.createDataFrame([("t", i) for i in range(6)], "trial_id string, seq int")
    assert rows(reconcile.fold(df, views), "trial_id", "view", "path", "kind", "sha256") == sorted(expect)
    assert rows(reconcile.changes(df, views), "trial_id", "view", "path", "op") == sorted(changed)


def test_write_rows_use_the_nearest_carrier(spark):
    deltas = spark.createDataFrame([("t", 2, "/a/b/c", "add", 0, 10), ("t", 3, "/x", "modify", 10, 20), ("t", 4, "/a/b/c", "delete", 20, 30), ("t", 5, "/n", "add", 30, 40)], "trial_id string, step_idx int, path string, op string, since int, upto int")
    events = spark.createDataFrame(
        [("t", "/a", 5, "moved_to", True, 1, "command"), ("t", "/a/b", 6, "moved_to", True, 2, "command"), ("t", "/x", 12, "modify", False, 3, "session"), ("t", "/x", 20, "modify", False, 3, "command"), ("t", "/x", 10, "modify", False, 9, "command"), ("t", "/a", 25, "delete", True, None, None)],
        "trial_id string, path string, at int, op string, is_dir boolean, writer_step int, mapped_by string")
    out = sorted((r.step_idx, r.writer_step, r.events, tuple(r.ops), r.first_at, r.last_at, r.via_dir) for r in reconcile.write_rows(deltas, events).collect())
    assert out == [(2, 2, 1, ("moved_to",), 6, 6, "/a/b"), (3, 3, 2, ("modify",), 12, 20, None), (4, None, 1, ("delete",), 25, 25, "/a")]


def test_is_text(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc\xc3\xa9")), (2, bytearray(b"a\0b")), (3, bytearray(b"\xff\xfe")), (4, bytearray(b"x" * (1 << 20))), (5, bytearray(b"x" * ((1 << 20) + 1)))], "id int, content binary")
    assert [r.id for r in df.where(reconcile.is_text()).collect()] == [1, 4]


def test_flatten_steps_and_report(spark):
    call = lambda i, tool: {"tool_call_id": i, "function_name": tool, "arguments": "{}"}
    step = lambda i, source, text, calls=None, results=None: {"step_id": i, "timestamp": "2024-01-01T00:00:00", "source": source, "message": text, "reasoning_content": None, "tool_calls": calls, "observation": {"results": results} if results else None}
    doc = {"trial_id": "t", "steps": [step(1, "user", "prompt"), step(2, "agent", "hi", [call("a", "Bash"), call("b", "Read")], [{"source_call_id": "b", "content": "out", "is_error": True}]), step(3, "agent", "bye")]}
    docs = spark.createDataFrame([doc], steps.DOCUMENT)
    out = [(r.step_idx, r.atif_step_id, r.tool_call_id, r.tool, r.output, r.is_error, r.message) for r in steps.flatten(docs).orderBy("step_idx").collect()]
    assert out == [(1, 2, "a", "Bash", None, None, "hi"), (2, 2, "b", "Read", "out", True, None), (3, 3, None, None, None, None, "bye")]
    calls = spark.createDataFrame([("t", "a", None, False), ("t", "b", "x", False), ("t", "c", "<tool_use_error>", False), ("t", "d", None, True), ("t", "e", "x", False)], "trial_id string, tool_call_id string, output string, is_last boolean")
    states = steps.call_states(calls, spark.createDataFrame([("t", "a")], "trial_id string, tool_call_id string"), spark.createDataFrame([("t", "b")], "trial_id string, tool_call_id string"))
    assert {r.tool_call_id: r.state for r in states.collect()} == {"a": "answered", "b": "timed_out", "c": "rejected", "d": "interrupted", "e": "unanswered"}
    (report,) = steps.chain_report(states, spark.createDataFrame([], "trial_id string")).collect()
    assert not report.complete and report.reasons == ["1 calls timed out", "1 calls without an answer", "no checkpoint"] and report.hooked_calls == 5


def test_state_walk(spark):
    df = spark.createDataFrame([("t", 1, None, False, False), ("t", 2, 0, True, True), ("t", 3, None, False, False), ("t", 4, None, False, True), ("t", 5, None, False, False), ("t", 6, 1, True, True), ("t", 7, None, True, True)], "trial_id string, step_idx int, seq int, covered boolean, changed boolean")
    assert [r.checkpoint_seq for r in steps.state_walk(df).orderBy("step_idx").collect()] == [None, 0, 0, None, None, 1, 1]


def test_enrich_order(spark):
    s = spark.createDataFrame([("t", 1, 10), ("t", 2, 20), ("t", 3, 30)], "trial_id string, step_id int, at int")
    c = spark.createDataFrame([("t", 2, 22)], "trial_id string, owner int, at int")
    b = spark.createDataFrame([("t", 20), ("t", 99)], "trial_id string, at int")
    assert [(r.kind, r.step_id) for r in steps.enrich(s, c, b).orderBy("number").collect()] == [("step", 1), ("boundary", None), ("step", 2), ("checkpoint", 2), ("step", 3), ("boundary", None)]


def test_constraints_name_what_is_broken(spark):
    good = ("t", 1, "/a", "add", None, "file", True, "h", None, None, "0" * 64, None, 1, None, "0644", None, "0:0", None, None)
    bad = ("t", 1, "a", "modify", None, "file", False, "h", None, "zz", None, None, None, None, "9", None, "root", None, None)
    df = spark.createDataFrame([good, bad], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.schema("deltas").fields))
    (r,) = schemas.violations(df, "deltas").collect()
    assert set(r.broken) == {"op_fits_kinds", "hunk_is_text", "digests", "modes", "owners", "absolute_path"}
    assert rows(schemas.repeated_keys(df, "deltas")) == [] and schemas.repeated_keys(df.union(df), "deltas").count() == 2


def test_check_components(spark):
    needs = [("t", f"c{i}", f"h{i}") for i in range(6)] + [("t", f"c{i}", f"h{i + 1}") for i in range(3)] + [("u", "c1", "h1"), ("u", None, "h1"), ("u", "c2", None)]
    df = spark.createDataFrame(needs, "trial string, check string, hunk string")
    got = {(r.trial, r.check): r.component for r in timeline.check_components(df, ["trial"]).collect()}
    assert got == {("t", "c0"): "c0", ("t", "c1"): "c0", ("t", "c2"): "c0", ("t", "c3"): "c0", ("t", "c4"): "c4", ("t", "c5"): "c5", ("u", "c1"): "c1"}
    assert timeline.check_components(df.where("false"), ["trial"]).count() == 0


@pytest.mark.parametrize("name", ["stat_rank_sum", "stat_wilcoxon_exact", "stat_freeman_halton", "stat_bootstrap_ci"])
def test_statistics_take_in_every_part(spark, monkeypatch, name):
    from wayfold.plans import general

    seen, sf = [], "/root/testdata/sf0.01"
    for f in ("grouped", "bootstrap_mean"):
        monkeypatch.setattr(general.stats, f, lambda rows, *a: seen.append(rows) or rows.withColumn("p", F.lit(1.0)))
    general.QUERIES[name](spark, sf)
    assert seen[0].count() == spark.read.parquet(f"{sf}/part.parquet").count()
    if name != "stat_bootstrap_ci":
        assert seen[0].groupBy("g").count().agg(F.max("count")).first()[0] <= 20


def test_timelines_take_in_every_line(spark):
    from wayfold.plans import general

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    marks = general.QUERIES["status_marks"](spark, sf).agg(F.sum(F.length("marks"))).first()[0]
    assert marks == lines.count()
    checks = general.QUERIES["check_classify"](spark, sf).count()
    assert checks == lines.select("l_suppkey", "l_linenumber").distinct().count()
    assert not any("l_quantity" in general.ORACLE[n] for n in ("check_classify", "status_marks", "stat_quorum_verdict", "plan_replays"))


def test_dearest_of_equal_prices_is_the_first_in_the_table(spark, tmp_path):
    import duckdb

    from wayfold.plans import catalog, general  # noqa: F401

    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect()
    for part, keys in enumerate(([None, 7, 3], [9, 1])):
        values = ", ".join(f"({k or 'null'}::bigint, {5 if k else 8}.0::double, {part}::bigint)" for k in keys)
        con.execute(f"copy (select 'A' as l_returnflag, * , 1.0::double as l_quantity, 0.06::double as l_discount, 0.1::double as l_tax, 1 as l_linenumber from (values {values}) v(l_partkey, l_extendedprice, l_suppkey)) to '{tmp_path}/lineitem.parquet/{part}.parquet' (format parquet)")
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["agg_filtered"](spark, str(tmp_path))
    assert rows(got, "l_returnflag", "n", "suppliers", "dearest") == [("A", 5, 2, 7)] == [(r[0], r[1], r[3], r[4]) for r in con.execute(catalog.ORACLE["agg_filtered"]).fetchall()]


def test_idle_seconds_are_summed_exactly(spark):
    """Four waits of 1,985.5 s in all: as doubles they sum to less than the half second in any order."""
    import datetime as dt

    from wayfold.plans import rules

    start = dt.datetime(2026, 1, 1)
    calls = [("a", i, "Bash", start, start + dt.timedelta(microseconds=n * 10_000)) for i, n in enumerate((52029, 35234, 54256, 57031))]
    t = {"steps": spark.createDataFrame(calls, "trial_id string, step_idx int, tool string, t_start timestamp, t_end timestamp"), "deltas": spark.createDataFrame([], "trial_id string, step_idx int")}
    assert rows(rules.idle_seconds(t)) == [("a", 1986)]


def test_samples_are_dealt_by_the_rows_of_the_table(spark, monkeypatch):
    from wayfold.plans import general

    at = "/root/testdata/sf0.001"
    few = rows(general.quorum(spark, at))
    monkeypatch.setattr(general, "PART_ROWS", 100)
    assert general._samples(spark, at).rdd.getNumPartitions() == spark.read.parquet(f"{at}/lineitem.parquet").count() // 100
    assert rows(general.quorum(spark, at)) == few
