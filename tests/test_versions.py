"""File versions against brute force and round trips."""

import random
from difflib import unified_diff

from pyspark.sql import functions as F
from wayfold.operators import matching, versions


def _texts(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        lines = [draw.choice("abcde") * draw.randrange(3) for _ in range(draw.randrange(9))]
        out.append(draw.choice([None, "\n".join(lines), "\n".join(lines) + "\n"]))
    return out


def test_hunks_hold_both_versions(spark):
    pairs = list(zip(_texts(1, 60), _texts(2, 60), strict=True))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    hunk = versions.diff_hunk(F.col("a"), F.col("b"))
    out = df.withColumn("h", hunk).select("a", "b", "h", versions.hunk_versions(F.col("h")).alias("v"), versions.narrowed(F.col("h"), 1).alias("n")).collect()
    for r in out:
        assert (r.v.before, r.v.after) == ((r.a, r.b) if r.h else ("", ""))
        marked = lambda s: [x for x in (s or "").split("\n")[2:] if x[:1] in "+-" and x]
        assert marked(r.n) == marked(r.h)
    assert spark.createDataFrame([("no hunk",), (None,)], "h string").where(versions.hunk_versions(F.col("h")).isNotNull()).count() == 0


def test_narrow_is_a_unified_diff(spark):
    a, b = "".join(f"{i}\n" for i in range(40)), "".join(f"{i * (i != 20)}\n" for i in range(40))
    h = spark.createDataFrame([(a, b)], "a string, b string").select(versions.diff_hunk(F.col("a"), F.col("b")).alias("h"))
    got = h.select(versions.narrowed(F.col("h"), 2)).first()[0]
    assert got == "".join(unified_diff(a.splitlines(True), b.splitlines(True), "a", "b", n=2))


def test_line_blame_and_first_seen(spark):
    rows = [("f", 0, ["a", "b"]), ("f", 1, ["a", "x", "b "]), ("f", 2, ["x", "b", "a"]), ("g", 0, ["a"]), ("g", 1, None), ("g", 2, ["a"]), ("h", 0, ["a"]), ("h", 3, None)]
    df = spark.createDataFrame(rows, "p string, index int, lines array<string>")
    blame = {(r.p, r.line_no): (r.line, r.origin) for r in matching.blame(df, ["p"]).collect()}
    assert blame == {("f", 1): ("x", 1), ("f", 2): ("b", 0), ("f", 3): ("a", 2), ("g", 1): ("a", 2)}
    seen = {(r.p, r.line): r["index"] for r in versions.first_seen(df, ["p"]).collect()}
    assert seen == {("f", "a"): 0, ("f", "b"): 0, ("f", "x"): 1, ("g", "a"): 0, ("h", "a"): 0}


def test_reverts_and_stale(spark):
    rows = [(1, "modify", "o", "a"), (2, "modify", "a", "b"), (3, "modify", "b", "a"), (4, "modify", "a", "a"), (5, "modify", "a", None), (6, "modify", "a", "o"), (7, "modify", "o", "b")]
    df = spark.createDataFrame([("f", *r) for r in rows], "p string, n int, op string, sha256_before string, sha256_after string")
    got = {r.n: r.reverts_to for r in versions.reverts(df, ["p"], "n").collect()}
    assert got == {1: None, 2: None, 3: "1", 4: None, 5: None, 6: "original", 7: "2"}
    got = {r.n: (r.read_at, r.unread_at) for r in versions.stale(df, ["p"], "n").collect() if r.read_at is not None}
    assert got == {6: (4, 5)}


def test_excluded_labels_passes(spark):
    df = spark.createDataFrame([("/a", "add"), ("/a/x", "add"), ("/b", "add"), ("/b/x", "add"), ("/b/y", "modify"), ("/c", "modify"), ("/c/x", "add"), ("/d", "add")], "path string, op string")
    assert sorted(r.path for r in versions.drop_excluded(df, [], r"/x(/|\z)").collect()) == ["/b", "/b/y", "/c", "/d"]
    labels = spark.createDataFrame([("t", {"c1": (["p"],), "c2": (None,)})], "trial string, steps map<string, struct<patterns: array<string>>>")
    assert sorted(tuple(r) for r in versions.label_rows(labels, ["trial"], ["p", "q"]).collect()) == [("t", "c1", True, 1, 0), ("t", "c2", False, 0, 0)]
    classes = spark.createDataFrame([("t", "a", "passes", 0), ("t", "b", "passes", 2), ("t", "c", "regression", 2)], "t string, check string, verdict string, point int")
    points = spark.createDataFrame([("t", i) for i in range(3)], "t string, index int")
    assert [tuple(r) for r in versions.first_passes(classes, points, ["t"]).collect()] == [("t", "b", 2)]
    replays = spark.createDataFrame([("a", True, False)] * 3 + [("b", True, True)] * 3 + [("c", True, False)], "f string, fixed boolean, broke_any boolean")
    assert {r.f: r.confirms for r in versions.confirmed(replays, ["f"], 3).collect()} == {"a": True, "b": False, "c": False}


def test_a_long_hunk_is_split_once(spark):
    import time

    lines = [f"{' -+'[i % 3]}{i}" for i in range(20_000)]
    df = spark.createDataFrame([("--- a\n+++ b\n@@ -1,1 +1,1 @@\n" + "\n".join(lines) + "\n",)], "h string")
    began = time.perf_counter()
    v = df.select(versions.hunk_versions(F.col("h")).alias("v")).first().v
    assert time.perf_counter() - began < 10
    assert [v.before, v.after] == ["".join(x[1:] + "\n" for x in lines if x[0] in f" {tag}") for tag in "-+"]
