"""Paths that messages name, and documents in parts."""

import json

from pyspark.sql import functions as F
from wayfold.operators import trace


def test_path_tokens(spark):
    texts = ["Edit /a/b.py, then src/x/ and 'Main.java'.", "http://x/y.py a//b v1.2 notes.txt!", "/a/b.py: /a/b.py; read.me x.c", "é/ü.md", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", trace.path_tokens(F.col("t")).alias("x"))
    assert [r.x for r in rows.orderBy("i").collect()] == [["/a/b.py", "src/x/", "Main.java"], ["notes.txt"], ["/a/b.py", "x.c"], ["é/ü.md"], [], []]


def names(path, token):
    """The rule, path by path."""
    bare = token.rstrip("/")
    return path == bare or path.startswith(bare + "/") if token.startswith("/") else path.endswith("/" + bare) or f"/{bare}/" in path


def test_token_paths_are_the_rules(spark):
    paths = ["/a/b/c.py", "/a/b", "a/b/c.py", "b/c.py", "/c.py", "c.py", "/a/bb/c.py", "/b/a/b/x"]
    tokens = ["/a", "/a/", "/a/b", "b", "b/", "c.py", "b/c.py", "a/b", "/c.py", "a", "x", "bb/c.py", "/a/b/c.py", "none.py"]
    named = spark.createDataFrame([("t", t) for t in tokens] + [("u", "b")], "trial_id string, token string")
    changed = spark.createDataFrame([("t", p, 1) for p in paths], "trial_id string, path string, call int")
    got = {(r.trial_id, r.token, r.path) for r in trace.token_paths(named, changed).collect()}
    assert got == {("t", t, p) for t in tokens for p in paths if names(p, t)}


def test_mentions_count_and_cut(spark):
    messages = spark.createDataFrame([("t", 1, "Node.js Main.py /dd a.c /d " + " ".join(f"f{i:02}.py" for i in range(30))), ("t", 2, None), ("u", 1, "/dd")], "trial_id string, step_idx int, message string")
    changed = spark.createDataFrame([("t", f"/dd/{i}", c) for i in range(7) for c in (i, i + 1)] + [("t", "/dd/0", 0)], "trial_id string, path string, call int")
    known = spark.createDataFrame([("t", "Main.py"), ("t", "Main.py"), ("u", "Node.js")], "trial_id string, name string")
    rows = trace.mentions(messages, changed, known).orderBy("trial_id", "step_idx", "place").collect()
    assert [(r.trial_id, r.place, r.token) for r in rows][:3] == [("t", 1, "Main.py"), ("t", 2, "/dd"), ("t", 3, "a.c")] and len(rows) == 21
    assert (rows[1].paths, rows[1].more, rows[1].calls) == ([f"/dd/{i}" for i in range(5)], 2, 8)
    assert (rows[-1].trial_id, rows[-1].paths, rows[-1].more, rows[-1].calls) == ("u", [], 0, 0)


def test_documents_come_in_parts(spark):
    trials = spark.createDataFrame([("t", 1.0), ("u", None)], "trial_id string, reward double")
    events = spark.createDataFrame([("t", i, ("ok", "bad", None)[i % 3], None) for i in range(25)] + [("x", 1, "ok", None)], "trial_id string, step_idx int, status string, note string")
    docs = {(r.trial_id, r.part): json.loads(r.document) for r in trace.documents(trials, events, part=10).collect()}
    assert sorted(docs) == [("t", 0), ("t", 1), ("t", 2), ("t", 3), ("u", 0)]
    assert docs["t", 0] == {"trial": {"trial_id": "t", "reward": 1.0}, "counts": {"bad": 8, "ok": 9, "unknown": 8}}
    assert docs["u", 0] == {"trial": {"trial_id": "u", "reward": None}, "counts": {}}
    assert [e["step_idx"] for p in (1, 2, 3) for e in docs["t", p]] == list(range(25)) and docs["t", 1][0] == {"step_idx": 0, "status": "ok", "note": None}
