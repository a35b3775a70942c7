"""Store, export, guard and sources on small files."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F
from wayfold.functions import schemas
from wayfold.operators import guard, store
from wayfold.sources import adapter, layers, logs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    s = store.Store(spark, str(tmp_path_factory.mktemp("store")))
    s.create()
    trial = lambda i, n=0: {"trial_id": i, "trial_name": i, "task": "t", "attempt_idx": 0, "prompt": "p", "model": "m", "harness": "h", "tokens_in": n}
    make = lambda name, rows: spark.createDataFrame([tuple(r.get(f.name) for f in schemas.schema(name).fields) for r in rows], schemas.schema(name))
    tables = {"trials": make("trials", [trial("a"), trial("b")]), "steps": make("steps", [{"trial_id": x, "step_idx": i, "source": "agent", "tool": "Bash", "args_json": "{}"} for x in "ab" for i in (1, 2)])}
    s.put(tables)
    return s, make, trial, tables


def test_store_keeps_replaces_and_skips(filled):
    s, make, trial, tables = filled
    s.check()
    s.create()
    assert s.table("steps").count() == 4 and s.table("trials", "a").count() == 1
    s.put({"trials": make("trials", [trial("a", 5), trial("c")]), "steps": make("steps", [{"trial_id": "c", "step_idx": 1, "source": "agent"}, {"trial_id": "a", "step_idx": 9, "source": "agent"}])})
    assert s.table("trials", "a").first().tokens_in == 0 and s.table("steps").count() == 5
    s.put({"trials": make("trials", [trial("a", 7)]), "steps": make("steps", [{"trial_id": "a", "step_idx": 9, "source": "agent"}])}, replace=True)
    assert s.table("trials", "a").first().tokens_in == 7 and [r.step_idx for r in s.table("steps", "a").collect()] == [9]
    assert s.table("steps", "b").count() == 2


def test_store_refuses(filled, spark, tmp_path):
    s, make, trial, _ = filled
    with pytest.raises(store.StoreError, match="first_attempt"):
        s.put({"trials": make("trials", [trial("z") | {"attempt_idx": 1}])})
    with pytest.raises(store.StoreError, match="no store"):
        store.Store(spark, str(tmp_path / "none")).check()


def test_registered_views_leave_out_held_out_tables(filled, spark):
    filled[0].register()
    assert spark.sql("select count(*) from step_flags").first()[0] > 0
    assert not spark.catalog.tableExists("checks") and not spark.catalog.tableExists("blame")


def test_export_reads_back_and_changes_are_seen(spark, tmp_path):
    t = adapter.model(spark, SF)
    tables = {"trials": t["trials"], "notices": t["job_notices"].select("trial_id", "task_id", "noticed_at")}
    store.export(tables, str(tmp_path / "out"))
    assert store.export_differs(tables, str(tmp_path / "out")) == []
    part = next((tmp_path / "out" / "trials").glob("part-*.txt"))
    lines = part.read_text().splitlines(True)
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text("".join(lines[1:] + lines[-1:]))
    assert store.export_differs(tables, str(tmp_path / "out")) == ["trials"]


def test_hunk_files_and_collisions(spark):
    d = spark.createDataFrame([("t", 1, "/a/B", "h"), ("t", 1, "/a/b", "h"), ("t", 1, "/c", "h"), ("t", 1, "/../d", "h"), ("t", 1, "/e", None)], "trial_id string, step_idx int, path string, hunk string")
    files = store.hunk_paths(d)
    assert sorted(r.file for r in files.collect()) == ["deltas/t/1/a/B.diff", "deltas/t/1/a/b.diff", "deltas/t/1/c.diff"]
    assert [r.f for r in store.file_collisions(files).collect()] == ["deltas/t/1/a/b.diff"]


def test_csv_cells_and_markdown(spark):
    df = spark.createDataFrame([(True, ["a", "b"], "=1+1", 2), (False, [], "x", None)], "y boolean, l array<string>, t string, n int")
    assert [tuple(r) for r in store.labels_csv(df).collect()] == [("1", "a;b", "'=1+1", "2"), ("0", "", "x", None)]
    assert store.markdown_table(df.select("t", "n")).splitlines() == ["| t | n |", "| --- | --- |", "| =1+1 | 2 |", "| x |  |"]


ACCEPTED = ["select 1", "SELECT 1;", "with x as (select 1 as a) select a from x", " -- note\nselect 'drop table x; insert into y'", "/* a */ select 1 union all select 2 order by 1 limit 1", "select * from range(3) where id in (select 1)"]
REFUSED = ["", "show tables", "from range(3)", "set spark.x=1", "insert into t select 1", "select 1; select 2", "create table x as select 1", "describe range", "with x as (select 1) insert into t select * from x", "select reflect('java.lang.System', 'exit', '0')", "select `REFLECT`('a', 'b')", "select * from parquet.`/etc`", "select * fro m x"]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_guard_accepts(spark, sql):
    guard.check(spark, sql)
    assert guard.run(spark, sql).error is None


@pytest.mark.parametrize("sql", REFUSED)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql)
    assert guard.run(spark, sql).error.startswith("refused: ")


def test_guard_caps_renders_and_times_out(spark):
    out = guard.run(spark, "select id, null as x from range(10) order by id", cap=3)
    assert out.rows == ('{"id":0,"x":null}', '{"id":1,"x":null}', '{"id":2,"x":null}') and out.truncated
    assert guard.render(out, 3).endswith("(3 rows, cut at 3)\n")
    slow = guard.run(spark, "select count(*) from range(1000000000) a join range(100000) b on a.id % 7 = b.id % 7 and a.id * b.id % 11 = 3", timeout_s=2)
    assert slow.error.startswith("timed out") and slow.rows is None and slow.latency_ms < 30_000
    assert guard.run(spark, "select no_such_column from range(1)").error
    assert guard.log_row("q", "t", None, "x", slow)["rows"] is None


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "v": "a"}\n{bad\n{"id": 1, "v": "b", "z": 0}\n{"id": 2}\n')
    good, bad = logs.jsonl_lenient(spark, str(tmp_path / "x.jsonl"), "id int, v string")
    assert good.count() == 3 and bad.count() == 1 and bad.first()["_file"].endswith("x.jsonl")
    assert sorted((r.id, r.v) for r in logs.first_per_key(good, ["id"], ["v"]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="x.jsonl|MALFORMED|FAILED_READ"):
        logs.jsonl_strict(spark, str(tmp_path / "x.jsonl"), "id int, v string").collect()
    assert [r.key for r in logs.unknown_keys(logs.jsonl_objects(spark, str(tmp_path / "x.jsonl")), ["id", "v"]).collect()] == ["z"]


def test_notices_listing_probe_and_checks(spark):
    text = "<task-id>b1</task-id><tool-use-id>c1</tool-use-id><status>completed</status>"
    events = spark.createDataFrame([("t", text, "2024-01-01T00:00:02Z"), ("t", text, "2024-01-01T00:00:01Z"), ("t", text.replace("b1", "b2"), "2024-01-01T00:00:01"), ("t", "other", "2024-01-01T00:00:01Z")], "trial_id string, content string, timestamp string")
    (n,) = logs.job_notices(events).collect()
    assert (n.task_id, n.tool_call_id, n.status, n.noticed_at.second) == ("b1", "c1", "completed", 1)
    one = spark.createDataFrame([("/a\0f\x003\x00644\x000\x000\x001\0\0/b\0l\x000\x00777\x000\x000\x001\0/a\0", " 12 1 sh -c x \nPID PPID\n3 1 init\n")], "raw string, probe string")
    r = one.select(logs.listing(F.col("raw")).alias("l"), logs.process_probe(F.col("probe")).alias("p")).first()
    assert [(x.path, x.kind, x.target) for x in r.l] == [("/a", "f", ""), ("/b", "l", "/a")] and [(x.pid, x.cmd) for x in r.p] == [(12, "sh -c x"), (3, "init")]
    snaps = spark.createDataFrame([("t", 1, [("a",), ("a",), ("b",)]), ("t", 4, [("a",), ("c",)])], "trial_id string, call_seq int, processes array<struct<cmd: string>>")
    assert sorted(tuple(r) for r in logs.process_delta(snaps).collect()) == [("t", 4, "started", "c", 1), ("t", 4, "stopped", "a", 1), ("t", 4, "stopped", "b", 1)]
    ctrf = spark.createDataFrame([("t", {"tests": [("x", "passed", None), ("y", "failed", "m"), ("y", "passed", None)]})], "trial_id string, results struct<tests: array<struct<name: string, status: string, message: string>>>")
    traces = spark.createDataFrame([("t", "q", False, "e")], "trial_id string, trace_id string, passed boolean, error string")
    assert sorted((r.kind, r.check, r.status) for r in logs.verifier_checks(ctrf, traces).collect()) == [("pytest", "x", "passed"), ("pytest", "y#1", "failed"), ("pytest", "y#2", "passed"), ("trace", "q", "failed")]


def test_result_documents(spark, tmp_path):
    doc = {"id": "AB", "task_name": "t", "trial_name": "n", "config": {"agent": {"model_name": "p/m"}}, "agent_info": {"name": "h", "version": "1", "model_info": None}, "agent_result": {"n_input_tokens": 3}, "verifier_result": {"rewards": {"reward": 1.0}}, "started_at": "2024-01-01T00:00:00", "finished_at": "2024-01-01T00:00:01.2345"}
    (tmp_path / "job" / "trial").mkdir(parents=True)
    (tmp_path / "job" / "trial" / "result.json").write_text(json.dumps(doc))
    schema = "id string, task_name string, trial_name string, config struct<agent: struct<model_name: string>>, agent_info struct<name: string, version: string, model_info: struct<provider: string, name: string>>, agent_result struct<n_input_tokens: long, n_output_tokens: long, cost_usd: double>, verifier_result struct<rewards: struct<reward: double>>, started_at string, finished_at string, attempt_idx int, parent_trial_id string, prompt string"
    (r,) = logs.trial_rows(logs.trajectories(spark, str(tmp_path / "job" / "trial"), schema)).collect()
    assert (r.trial_id, r.model, r.reward, r.tokens_in, r.wall_ms, r.attempt_idx) == ("ab", "p/m", 1.0, 3, 1234, 0)
    assert [(x.job, x.trial) for x in logs.jobs_tree(spark, str(tmp_path)).collect()] == [("job", "trial")]


def test_layer_tars(spark, tmp_path):
    def tar(members, zipped=False):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, kind, content in members:
                info = tarfile.TarInfo(name)
                info.type, info.mode = kind, 0o755
                info.size = len(content) if kind == tarfile.REGTYPE else 0
                if kind in (tarfile.SYMTYPE, tarfile.LNKTYPE):
                    info.linkname = content.decode()
                t.addfile(info, io.BytesIO(content) if kind == tarfile.REGTYPE else None)
        return gzip.compress(out.getvalue()) if zipped else out.getvalue()

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "0.tar").write_bytes(tar([("./", tarfile.DIRTYPE, b""), ("a", tarfile.DIRTYPE, b""), ("a/f", tarfile.REGTYPE, b"x"), ("a/f", tarfile.REGTYPE, b"yy"), ("l", tarfile.SYMTYPE, b"a/f"), ("h", tarfile.LNKTYPE, b"a/f")]))
    (tmp_path / "t" / "1.tar.gz").write_bytes(tar([("a/.wh.f", tarfile.REGTYPE, b""), ("b/.wh..wh..opq", tarfile.REGTYPE, b"")], True))
    out = {(r.seq, r.path): (r.marker, r.kind, r["size"]) for r in layers.entries(layers.layer_files(spark, str(tmp_path / "t" / "*.tar*"))).collect()}
    assert out == {(0, "/a"): (None, "dir", None), (0, "/a/f"): (None, "file", 2), (0, "/l"): (None, "symlink", 3), (0, "/h"): (None, "file", 2), (1, "/a/f"): ("whiteout", None, None), (1, "/b"): ("opaque", None, None)}
    with pytest.raises(ValueError):
        layers.member_path("../x")


@pytest.mark.parametrize("sql", [
    "select '--', reflect('java.lang.Math', 'abs', -1)", "select '/*', reflect('java.lang.Math', 'abs', -1), '*/'", "select `reflect`('a', 'b')", "select 1 where exists (select java_method('a', 'b'))",
    "with a as (select 1) insert into t select * from a", "select * from parquet.`/etc/passwd`", "select (select max(value) from `text`.`/etc/passwd`)", "select transform(a) using 'cat' from t",
    "select identifier('reflect')('a', 'b')", "select count(*) over (order by reflect('a', 'b')) from range(3)", "select 1; select 2", "create table t as select 1"])
def test_guard_reads_the_parsed_query(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql)


@pytest.mark.parametrize("sql", ["select 'reflect(1)', '-- x', \"parquet.`a`\"", "-- reflect(x)\nselect 1", "with a as (select 1 as x) select sum(x) from a", "select reflect from (select 1 as reflect)"])
def test_guard_lets_literals_and_columns_be(spark, sql):
    guard.check(spark, sql)
