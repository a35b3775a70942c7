"""Line matching, blame, diff replay, provenance, samples, stateful streams and published files against brute force and round trips."""

import hashlib
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F
from wayfold.functions import stats
from wayfold.operators import detector, guard, matching, provenance, replay, samples
from wayfold.plans import views  # noqa: F401
from wayfold.sources import adapter, files
from wayfold.streaming import operators as live
from wayfold.streaming import stateful

SF = "/root/testdata/sf0.001"
PAIRS = "key int, a array<string>, b array<string>"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def ops_of(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], PAIRS)
    return df, {r.key: [tuple(o) for o in r.ops] for r in matching.with_opcodes(df, ["key"]).collect()}


def applied(a, b, ops, keep=None):
    out, n = [], 0
    for i1, j1, i2, j2, tag in ops:
        new = tag != "equal" and (keep is None or n in keep)
        out += b[j1:j2] if new else a[i1:i2]
        n += tag != "equal"
    return out


def test_opcodes_are_valid_and_shortest(spark):
    draw = random.Random(4)
    pairs = [([draw.choice("abc") for _ in range(draw.randrange(12))], [draw.choice("abc") for _ in range(draw.randrange(12))]) for _ in range(150)]
    pairs += [(None, ["x"]), (["x"], None), (None, None), ([], []), (["a"] * 5, ["a"] * 8), ([None, "b"], [None, "c"])]
    _, ops = ops_of(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        a, b = a or [], b or []
        assert applied(a, b, ops[i]) == b and applied(a, b, ops[i], ()) == a
        assert all((t == "equal") == (a[i1:i2] == b[j1:j2] and i2 > i1) for i1, j1, i2, j2, t in ops[i])
        assert all((x[4] == "equal") != (y[4] == "equal") and (x[2], x[3]) == (y[0], y[1]) for x, y in itertools.pairwise(ops[i]))
        assert sum(i2 - i1 for i1, _, i2, _, t in ops[i] if t == "equal") == lcs(a, b)


def test_large_texts_match_on_unique_lines(spark):
    draw = random.Random(9)
    base = [f"line {i}" if i % 3 else "}" for i in range(900)]
    moved = [x for x in base if draw.random() > 0.1]
    for _ in range(60):
        moved.insert(draw.randrange(len(moved)), draw.choice(("new", "}", f"n{draw.random()}")))
    pairs = [(base, moved), (["}"] * 400, ["{"] + ["}"] * 300), (["}", "a"] * 300, ["b", "}"] * 300), (base, base[450:] + base[:450])]
    _, ops = ops_of(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert applied(a, b, ops[i]) == b
    kept = sum(x[2] - x[0] for x in ops[0] if x[4] == "equal")
    assert kept >= 0.97 * lcs(*pairs[0])


def test_partial_fixes_and_hunks(spark):
    a, b = list("abcdefgh"), list("xbcdyyfgzhw")
    df = spark.createDataFrame([(0, a, b)], PAIRS)
    whole = matching.with_opcodes(df, ["key"])
    ops = [tuple(o) for o in whole.first().ops]
    n = sum(o[4] != "equal" for o in ops)
    for keep in (set(s) for k in range(n + 1) for s in itertools.combinations(range(n), k)):
        got = whole.select(matching.partial_fix(F.col("ops"), "a", "b", F.array(*[F.lit(k) for k in keep]).cast("array<int>")).alias("x")).first().x
        assert got == applied(a, b, ops, keep)
    hunks = whole.select(F.explode(matching.fix_hunks(F.col("ops"), F.size("a"))).alias("h")).select("h.*").collect()
    assert [(h.removed, h.inserted_before, h.added, h.anchors) for h in hunks] == [([1], None, 1, []), ([5], None, 2, []), ([], 8, 1, [7, 8]), ([], 9, 1, [8])]


def sequential_blame(spark, versions):
    """One version after another, with the matches of each pair."""
    pairs = [(a or [], b or []) for (_, a), (_, b) in itertools.pairwise(versions)]
    clean = [([x.rstrip(" ") for x in a], [x.rstrip(" ") for x in b]) for a, b in pairs]
    _, ops = ops_of(spark, clean)
    origin = [versions[0][0]] * len(versions[0][1] or [])
    for n, (index, lines) in enumerate(versions[1:]):
        new = [index] * len(lines or [])
        for i1, j1, i2, j2, tag in ops[n]:
            if tag == "equal":
                new[j1:j2] = origin[i1:i2]
        origin = new
    return origin


@pytest.mark.parametrize("n,seed", [(1, 1), (2, 2), (13, 3), (64, 4)])
def test_blame_against_one_version_after_another(spark, n, seed):
    draw, lines, versions = random.Random(seed), ["a", "b", "c"], []
    for i in range(n):
        for _ in range(2):
            k = draw.randrange(3)
            if k == 0 and lines:
                lines.pop(draw.randrange(len(lines)))
            else:
                lines.insert(draw.randrange(len(lines) + 1), draw.choice(("a", "b ", "c", str(i))))
        versions.append((i * 3, None if draw.random() < 0.05 and i < n - 1 else list(lines)))
    rows = [("f", *v) for v in versions] + [("gone", 0, ["a"]), ("gone", 1, None), ("one", 5, ["x", "x"])]
    got = sorted((r.p, r.line_no, r.line, r.origin) for r in matching.blame(spark.createDataFrame(rows, "p string, index int, lines array<string>"), ["p"]).collect())
    want = [("f", k, line, o) for k, (line, o) in enumerate(zip(versions[-1][1], sequential_blame(spark, versions)), 1)]
    assert got == sorted([*want, ("one", 1, "x", 5), ("one", 2, "x", 5)])


def test_blame_of_ten_thousand_versions(spark):
    """Each version adds a line at the front and drops the fourth."""
    rows = spark.range(10_000).select(F.lit("f").alias("p"), F.col("id").cast("int").alias("index"), F.transform(F.sequence(F.col("id"), F.greatest(F.col("id") - 2, F.lit(0)), F.lit(-1)), lambda x: x.cast("string")).alias("lines"))
    got = [(r.line_no, r.line, r.origin) for r in matching.blame(rows, ["p"]).orderBy("line_no").collect()]
    assert got == [(1, "9999", 9999), (2, "9998", 9998), (3, "9997", 9997)]


def test_blame_fix(spark):
    blamed = matching.blame(spark.createDataFrame([("f", 0, ["a", "b"]), ("f", 1, ["a", "b", "bug", "c"])], "p string, index int, lines array<string>"), ["p"])
    fix = matching.with_opcodes(spark.createDataFrame([("f", ["a", "b", "bug", "c"], ["0", "a", "b", "c"])], "p string, a array<string>, b array<string>"), ["p"])
    got = sorted(tuple(r) for r in matching.blame_fix(fix.select("p", "ops", F.size("a").alias("n_lines")), blamed, ["p"]).collect())
    assert got == [("f", "anchor", 1, 0), ("f", "removed", 3, 1)]


def sha(lines, end="\n"):
    return None if lines is None else hashlib.sha256(("\n".join(lines) + end if lines else "").encode()).hexdigest()


@pytest.mark.parametrize("context", [0, 1, 3, 1000])
def test_diffs_rebuild_every_version(spark, context):
    draw, rows = random.Random(context), []
    for f in range(6):
        lines = None
        for i in range(20):
            before = lines
            lines = None if draw.random() < 0.1 else [draw.choice("abcd") for _ in range(5)] if lines is None else list(lines)
            for _ in range(draw.randrange(3) if lines else 0):
                k = draw.randrange(len(lines) + 1)
                lines[k : k + draw.randrange(2)] = [draw.choice(("a", "-b", "+c", " d", "@@ -1 +1 @@", ""))]
            if before is not None or lines is not None:
                rows.append((f, i, before, lines, sha(lines)))
    df = spark.createDataFrame(rows, "f int, v int, a array<string>, b array<string>, sha256 string")
    diffs = matching.unified(df, ["f", "v"], context=context).withColumn("op", F.when(F.col("b").isNull(), "delete").otherwise("modify"))
    got = {(r.f, r.v): r for r in replay.file_after(diffs, ["f"], "v").collect()}
    for f, i, _, lines, _ in rows:
        r = got[f, i]
        assert (r.state, r.text) == (("deleted", None) if lines is None else ("verified", "\n".join(lines) + "\n" if lines else ""))
        numbers = [n for n, (j1, j2) in enumerate((o.j1, o.j2) for o in r.ops if o.tag != "equal") for _ in range(j2 - j1)]
        assert len(r.changed_lines) == len(numbers) or lines is None
    last = {r.f: r.state for r in replay.rebuilt(diffs, ["f"], "v").collect()}
    assert last == {f: "deleted" if lines is None else "verified" for f, _, _, lines, _ in rows}


def test_broken_chains_are_flagged(spark):
    new = "--- /dev/null\n+++ b\n@@ -0,0 +1,2 @@\n+a\n+b\n"
    add = lambda at, old, line: f"--- a\n+++ b\n@@ -{at},1 +{at},2 @@\n {old}\n+{line}\n"
    rows = [
        ("ok", 1, "add", new, sha(["a", "b"]), None), ("ok", 2, "modify", add(2, "b", "c"), sha(["a", "b", "c"], ""), sha(["a", "b"])),
        ("unread", 1, "add", new, sha(["a", "b"]), None), ("unread", 2, "modify", None, "?", None), ("unread", 3, "modify", add(1, "a", "x"), "?", None), ("unread", 4, "modify", new, sha(["a", "b"]), None),
        ("unfit", 1, "add", new, sha(["a", "b"]), None), ("unfit", 2, "modify", add(2, "z", "c"), "?", None),
        ("short", 1, "add", new, sha(["a", "b"]), None), ("short", 2, "modify", add(9, "b", "c"), "?", None),
        ("hash", 1, "add", new, "other", None), ("hash", 2, "modify", add(2, "b", "c"), sha(["a", "b", "c"]), None),
        ("before", 1, "add", new, sha(["a", "b"]), None), ("before", 2, "modify", add(2, "b", "c"), sha(["a", "b", "c"]), "other"),
        ("start", 1, "modify", add(2, "b", "c"), sha(["a", "b", "c"]), None), ("gone", 1, "add", new, sha(["a", "b"]), None), ("gone", 2, "delete", None, None, None), ("gone", 3, "modify", add(2, "b", "c"), "?", None),
        ("no diff", 1, "add", "--- /dev/null\n+++ b\n@@ what\n", "?", None), ("empty", 1, "add", "--- /dev/null\n+++ b\n", sha([]), None), ("same", 1, "add", new, sha(["a", "b"]), None), ("same", 2, "modify", "", sha(["a", "b"]), None)]
    df = spark.createDataFrame(rows, "f string, i int, op string, diff string, sha256 string, was string")
    got = {(r.f, r.i): (r.state, r.text) for r in replay.file_after(df, ["f"], "i", sha_before="was").collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("ok", 1): "verified", ("ok", 2): "verified", ("unread", 1): "verified", ("unread", 2): "unknown", ("unread", 3): "unknown", ("unread", 4): "verified",
        ("unfit", 1): "verified", ("unfit", 2): "unknown", ("short", 1): "verified", ("short", 2): "unknown", ("hash", 1): "unverified", ("hash", 2): "unknown",
        ("before", 1): "verified", ("before", 2): "unknown", ("start", 1): "unknown", ("gone", 1): "verified", ("gone", 2): "deleted", ("gone", 3): "unknown",
        ("no diff", 1): "unknown", ("empty", 1): "verified", ("same", 1): "verified", ("same", 2): "verified"}
    assert got["ok", 2][1] == "a\nb\nc" and got["hash", 1][1] == "a\nb" and got["empty", 1][1] == ""


def test_edits_compose_in_any_grouping():
    draw = random.Random(2)
    def edit(n):
        cuts = sorted(draw.sample(range(n + 1), min(4, n + 1)))
        out = [replay._keep(a, b) for a, b in itertools.pairwise(cuts)] + [{"f": None, "t": None, "lines": [f"n{draw.random()}"]}, replay._keep(draw.randrange(n), None)]
        return out
    def run(e, lines):
        return [x for p in e for x in (p["lines"] if p["f"] is None else lines[p["f"] : p["t"]])]
    for _ in range(300):
        base = [str(i) for i in range(9)]
        a = edit(9)
        b = edit(len(run(a, base)))
        c = edit(len(run(b, run(a, base))))
        left, right = replay.composed(replay.composed(a, b), c), replay.composed(a, replay.composed(b, c))
        assert run(left, base) == run(right, base) == run(c, run(b, run(a, base)))


@pytest.fixture(scope="module")
def calls(spark):
    return stateful.answered_calls(adapter.model(spark, SF)).cache()


def _flags(df):
    return sorted(tuple(r) for r in df.select("trial_id", "step_idx", "pattern", "subtype", "detail").collect())


def test_streamed_flags_of_first_calls(spark, calls, tmp_path):
    """In files of a few steps, one a trigger: what is flagged up to a step is what the first calls alone give."""
    batch = _flags(detector.flags(adapter.model(spark, SF)))
    assert {p for _, _, p, _, _ in batch} == set(detector.PATTERNS)
    edges = [0, 5, 20, 1000]
    for k, (a, b) in enumerate(itertools.pairwise(edges)):
        calls.where((F.col("step_idx") > a) & (F.col("step_idx") <= b)).coalesce(1).write.parquet(str(tmp_path / f"d{k}"))
    def run(n):
        at = tmp_path / f"in{n}"
        at.mkdir()
        for k in range(n):
            (part,) = (tmp_path / f"d{k}").glob("*.parquet")
            (at / f"{k}.parquet").write_bytes(part.read_bytes())
        with stateful.rocksdb(spark):
            return _flags(live.drained(spark, stateful.checked(spark.readStream.schema(stateful.CALL).option("maxFilesPerTrigger", 1).parquet(str(at)))))
    for n in (1, 2, 3):
        assert run(n) == [f for f in batch if f[1] <= edges[n]]


def _streamed(spark, tmp_path, name, schema, triggers, build):
    at = tmp_path / name
    at.mkdir()
    for k, rows in enumerate(triggers):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
        (part,) = (tmp_path / f"{name}-{k}").glob("*.parquet")
        (at / f"{k}.parquet").write_bytes(part.read_bytes())
    with stateful.rocksdb(spark):
        return live.drained(spark, build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))))


def test_a_record_stands_over_a_timeout_in_every_order(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    end = [("end", "record", at(100_000))]
    triggers = [
        [("before", "record", at(0)), ("within", "timeout", at(1)), ("after", "timeout", at(1)), ("never", "timeout", at(2)), ("both", "timeout", at(3)), ("both", "record", at(3)), ("late", "timeout", at(4))],
        [("before", "timeout", at(5)), ("within", "record", at(6)), ("x", "record", at(400))], [("after", "record", at(401)), ("again", "timeout", at(402)), ("again", "timeout", at(403))], end, [("late", "record", at(100_001))], [("end2", "record", at(300_000))]]
    out = _streamed(spark, tmp_path, "timeouts", "call_id string, kind string, arrived timestamp", triggers, lambda df: stateful.timeouts(df, 60_000, "1 second"))
    emitted = sorted((r.call_id, r.outcome) for r in out.collect() if not r.call_id.startswith(("end", "x")))
    # A record of the trigger in which the wait ends comes before the end of the wait.
    assert emitted == [("after", "answered"), ("again", "timed_out"), ("before", "answered"), ("both", "answered"), ("late", "answered"), ("late", "timed_out"), ("never", "timed_out"), ("within", "answered")]
    final = {r.call_id: r.outcome for r in stateful.outcomes(out).collect()}
    assert sorted(k for k, v in final.items() if v == "timed_out") == ["again", "never"]


def test_readings_go_stale_and_are_dropped(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    read, ask = (lambda k, s, v: (k, at(s), False, None, v)), (lambda k, s, e: (k, at(s), True, e, None))
    triggers = [[read("a", 0, "x"), ask("a", 0, 1), ask("a", 9, 2), ask("a", 10, 3), ask("b", 1, 4)], [read("a", 20, "y"), ask("a", 25, 5), read("b", 21, "z")], [ask("a", 26, 6), ask("b", 40, 7), read("c", 500, "w")], [ask("a", 501, 8), ask("c", 502, 9)]]
    out = _streamed(spark, tmp_path, "readings", "key string, at timestamp, is_event boolean, event_id long, value string", triggers, lambda df: stateful.fresh_readings(df, 10_000, 60_000, "5 seconds"))
    assert {r.event_id: r.value for r in out.collect()} == {1: "x", 2: "x", 3: None, 4: None, 5: "y", 6: "y", 7: None, 8: None, 9: "w"}
    with pytest.raises(ValueError):
        stateful.fresh_readings(None, 10, 5)


def test_files_are_published_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame([(p, c.encode()) for p, c in r], files.SCHEMA)
    assert files.current(out) is None and files.listed(spark, out).count() == 0
    files.publish(rows(("a/x.diff", "1"), ("b", "")).repartition(2), out)
    first = files.current(out)
    assert {(r.path, bytes(r.content)) for r in files.contents(spark, out).collect()} == {("a/x.diff", b"1"), ("b", b"")} and first["files"] == 2
    # A task that dies after it has written: readers stay with the version before, and its files go.
    fails = rows(*[(f"n{i}", "y") for i in range(20)]).select("path", F.when(F.col("path") == "n19", F.raise_error("dies")).otherwise(F.col("content")).alias("content")).coalesce(1)
    fails.sparkSession.dataSource.register(files.FilesSink)
    with pytest.raises(Exception, match="dies"):
        fails.write.format(files.NAME).mode("append").option("path", out).save()
    assert files.current(out) == first and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(["_versions", first["folder"]])
    for bad in ([("x", "1"), ("x", "2")], [("d", "1"), ("d/e", "2")], [("/abs", "")], [("a/../b", "")], [("", "")], [("_lists/x", "")]):
        with pytest.raises(files.CannotPublish):
            files.publish(rows(*bad), out)
    files.publish(rows(("c", "3")), out)
    assert [r.path for r in files.listed(spark, out).collect()] == ["c"] and files.differing(spark, out).count() == 0
    (tmp_path / "out" / files.current(out)["folder"] / "c").write_text("other")
    assert [r.path for r in files.differing(spark, out).collect()] == ["c"]
    blobs = spark.createDataFrame([(b"x", hashlib.sha256(b"x").hexdigest()), (b"x", hashlib.sha256(b"x").hexdigest()), (None, None)], "content binary, sha256 string")
    assert [r.path for r in files.blobs(blobs, "content").collect()] == ["blobs/" + hashlib.sha256(b"x").hexdigest()]
    with pytest.raises(Exception, match="contents are not"):
        files.blobs(spark.createDataFrame([(b"x", "y")], "content binary, sha256 string"), "content").collect()


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("s"), (F.col("id") % 50 == 0).alias("m"))
    for make in (lambda r: samples.bottom_k(r, ["s"], ["id"], 4, 1), lambda r: samples.bottom_k(r.withColumn("q", F.col("s").cast("int")), ["s"], ["id"], F.col("q"), 1),
                 lambda r: samples.review_sample(r, F.col("m"), ["s"], ["id"], 0.2, 1), lambda r: samples.queues(r, ["s"], ["id"], {"a": 3, "b": 9}, 1)):
        got = [sorted(tuple(x) for x in make(rows.repartition(n)).collect()) for n in (1, 5)]
        assert got[0] == got[1] and got[0]
    assert {r.s: r["count"] for r in samples.bottom_k(rows, ["s"], ["id"], 4, 1).groupBy("s").count().collect()} == {s: 4 for s in range(7)}
    why = samples.review_sample(rows, F.col("m"), ["s"], ["id"], 0.2, 1).groupBy("why").count().collect()
    why = {r.why: r["count"] for r in why}
    assert why["must"] == 10 and why["stratum"] == 7 and 60 < why["share"] < 140
    q = samples.queues(rows, ["s"], ["id"], {"a": 3, "b": 9}, 1).collect()
    assert sorted((r.queue, r.place) for r in q) == [("a", i) for i in (1, 2, 3)] + [("b", i) for i in range(1, 10)] and len({r.s for r in q if r.queue == "a"}) == 3


def test_assertions_trip(spark):
    rows = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "2"), ("w", None)], "src string, v string")
    assert samples.single_value(rows.where("v = '1'"), "v", "src") == "1" and samples.single_value(rows.limit(0), "v", "src") is None
    with pytest.raises(samples.Disagreement, match="z"):
        samples.single_value(rows.where("v is not null"), "v", "src")
    with pytest.raises(samples.Disagreement, match="null in w"):
        samples.single_value(rows.where("v = '1' or v is null"), "v", "src")
    seen, metrics = samples.watched(rows, "rows", n=F.count("*"), missing=F.count_if(F.col("v").isNull()))
    assert seen.count() == 4
    assert samples.check(metrics, missing=1) == {"n": 4, "missing": 1}
    with pytest.raises(samples.Disagreement, match="missing is 1"):
        samples.check(metrics, missing=0)


def test_facts_and_their_sources(spark):
    text = "run --dry-run /srv/a/run.py on 1234 and 12.5 files data.json, --dry-run; 99 no"
    got = {tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(provenance.facts(F.col("t")).alias("f")).first().f}
    assert got == {("--dry-run", "flag"), ("/srv/a/run.py", "path"), ("1234", "number"), ("data.json", "file")}
    calls = [("r", 1, "--alpha", "see --beta", True), ("r", 2, "--beta --gamma --given", "--gamma", False), ("r", 3, "--gamma --delta", "--delta", True), ("r", 4, "--delta", None, False)]
    out = provenance.sources(spark.createDataFrame(calls, "run string, n int, text string, result string, is_record boolean"), spark.createDataFrame([("r", "--given")], "run string, text string"))
    assert {(r.token, r.n, r.source) for r in out.collect()} == {("--alpha", 1, "unsourced"), ("--beta", 2, "record"), ("--gamma", 2, "unsourced"), ("--given", 2, "given"), ("--delta", 3, "unsourced")}
    # A long text: its patterns run once, not once a fact.
    many = [f"--w{''.join(chr(97 + int(x)) for x in str(i))}" for i in range(4_000)]
    began = time.perf_counter()
    got = spark.createDataFrame([(" ".join(many * 2),)], "t string").select(provenance.facts(F.col("t")).alias("f")).first().f
    assert [tuple(x) for x in got] == [(x, "flag") for x in many] and time.perf_counter() - began < 10
    line = "a line of the record"
    calls = [("r", 1, None, line + "\nanother long line\nthe third long line", True), ("r", 2, "another long line", "the third long line", False), ("r", 3, line + "\nthe third long line\n" + line, None, False), ("r", 4, line, None, False)]
    out = provenance.record_lines(spark.createDataFrame(calls, "run string, n int, text string, result string, is_record boolean"), spark.createDataFrame([("r", "x")], "run string, text string"))
    assert {(r.line, r.n) for r in out.collect()} == {("another long line", 2), (line, 3)}


def test_nearest_rank_without_whole_groups(spark):
    draw = random.Random(1)
    rows = [(g, draw.choice((draw.random(), float(draw.randrange(3)), None))) for g in ("a", "b", None) for _ in range(400)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for g in {g for g, _ in rows}:
            v = sorted(x for h, x in rows if h == g and x is not None)
            if v:
                want[g] = v[max(min(round(share * len(v)), len(v)), 1) - 1]
        for parts in (2, 64):
            assert {r.g: r.p for r in stats.nearest_rank(df, ["g"], "v", share, "p", parts).collect()} == want


def test_friedman_exact_and_permuted(spark):
    def brute(ranks):
        q = lambda rows: sum(sum(r[i] for r in rows) ** 2 for i in range(len(rows[0])))
        every = [q(rows) for rows in itertools.product(*[list(itertools.permutations(r)) for r in ranks])]
        return sum(x >= q(ranks) - 1e-9 for x in every) / len(every)
    cases = [[[1, 2, 3], [1, 3, 2], [1, 2, 3], [2, 1, 3]], [[1.5, 1.5, 3], [1, 2, 3]], [[1, 2], [1, 2], [1, 2], [2, 1]], [[2, 2, 2]]]
    for ranks in cases:
        assert stats.friedman_exact(ranks) == pytest.approx(brute(ranks))
    rows = [("t", b, a, float(v)) for b, r in enumerate(cases[0]) for a, v in enumerate(r)]
    df = spark.createDataFrame(rows, "g string, b int, a int, v double")
    p = [stats.friedman_permuted(df.repartition(n), ["g"], "b", "a", "v", 3000).first().p for n in (1, 4)]
    assert p[0] == p[1] == pytest.approx(brute(cases[0]), abs=0.03)


@pytest.mark.parametrize("output,line", [
    ("ok", None), (None, None), ("ValueError: x", None), ("Traceback (most recent call last):\n  x\na.b.ValueError: x\nmore", "a.b.ValueError: x"), ("Traceback (most recent call last):\nBrokenPipeError: x", None),
    ("Traceback (most recent call last):\n  File", "Traceback (most recent call last)"), ("  SyntaxError: bad", "SyntaxError: bad"), ("python3: can't open file 'x': [Errno 2] No such", "python3: can't open file 'x': [Errno 2] No such"),
    ("Aborted (core dumped)", "Aborted (core dumped)"), ("a.c:1:2: fatal error: y", "a.c:1:2: fatal error: y"), ("a.c:1: error: y", None), ("make[1]: *** [x] Error 1", "make[1]: *** [x] Error 1"), ("npm ERR! x", "npm ERR! x"),
    ("Traceback (most recent call last):\nBrokenPipeError: x\nKeyError: 'y'\nnpm ERR! z", "KeyError: 'y'")])
def test_crash_lines(spark, output, line):
    got = spark.createDataFrame([(output,)], "output string").select(F.get(detector.crash_lines(F.col("output")), F.lit(0)).alias("x")).first().x
    assert got == line


def test_import_probes_are_no_masked_errors(spark):
    out = "Traceback (most recent call last):\nModuleNotFoundError: No module named 'x'"
    commands = ["python3 -c 'import x; print(x.v)'", "python -c 'import x; x.run()'", "python app.py"]
    steps = spark.createDataFrame([("t", i, "Bash", f'{{"command": "{c}"}}', out, False) for i, c in enumerate(commands)], "trial_id string, step_idx int, tool string, args_json string, output string, is_error boolean")
    assert sorted(r.step_idx for r in detector.masked_error({"steps": steps}).collect()) == [1, 2]


@pytest.mark.parametrize("name", ["`org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/passwd`", "`org.apache.spark.sql.execution.datasources.binaryfile.BinaryFileFormat`.`/etc`", "`com.example.Any`.`x`", "nowhere.t", "other.nowhere.t"])
def test_guard_reads_no_files_by_class_name(spark, name):
    out = guard.run(spark, f"select * from {name}")
    assert out.rows is None and out.error.startswith("refused: ")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_guard_takes_tables_of_the_session(spark):
    spark.range(3).createOrReplaceTempView("guarded")
    spark.sql("drop table if exists guarded_table")
    spark.sql("create table guarded_table using parquet as select 1 as x")
    for name in ("guarded", "guarded_table", "default.guarded_table", "spark_catalog.default.guarded_table", "DEFAULT.guarded_table"):
        assert guard.run(spark, f"select count(*) as n from {name}").error is None


def test_bootstrap_does_not_depend_on_partitions(spark):
    draw = random.Random(3)
    values = [float(draw.randrange(20)) for _ in range(400)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = [stats.bootstrap_mean(df.repartition(n), ["g"], "v", 300).first() for n in (1, 6)]
    assert got[0] == got[1]
    mean = sum(values) / len(values)
    sd = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / len(values) ** 0.5
    assert got[0].low == pytest.approx(mean - 1.96 * sd, abs=0.35 * sd) and got[0].high == pytest.approx(mean + 1.96 * sd, abs=0.35 * sd)


def test_the_end_of_event_time_is_one_row_not_one_for_each_event(spark, monkeypatch):
    from wayfold.plans import rebuild

    monkeypatch.setattr(stateful, "timeouts", lambda rows, hold_ms: rows.select("call_id", F.col("kind").alias("outcome"), F.col("arrived").alias("at")))
    monkeypatch.setattr(stateful, "outcomes", lambda out: out.withColumn("call_id", F.when(F.col("call_id") == "end", "last").otherwise(F.col("call_id"))))
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert rebuild.stream_timeout(spark, SF).where("call_id = 'last'").count() == e.where(F.col("ts") == e.agg(F.max("ts")).first()[0]).count()
