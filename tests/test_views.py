"""The derived views on rows written by hand, one rule at a time."""

from datetime import datetime, timedelta

import pytest
from wayfold.functions import schemas
from wayfold.plans import views

START = datetime(2024, 5, 1, 12, 0)


def at(minutes):
    return START + timedelta(minutes=minutes)


class Rows:
    def __init__(self):
        self.rows = {name: [] for name in schemas.RECORD}

    def trial(self, trial_id="a", prompt="do it"):
        self.rows["trials"].append({"trial_id": trial_id, "trial_name": trial_id, "task": "t", "attempt_idx": 0, "prompt": prompt, "model": "m", "harness": "h"})
        return self

    def call(self, i, tool="Bash", command="ls", output="", error=False, took=1.0, trial_id="a", **more):
        args = '{"command": "%s"}' % command.replace('"', '\\"').replace("\n", "\\n") if tool == "Bash" else '{"file_path": "%s"}' % command
        self.rows["steps"].append({
            "trial_id": trial_id, "step_idx": i, "source": "agent", "tool_call_id": f"c{i}", "tool": tool, "args_json": args, "output": output, "is_error": error,
            "t_start": at(i), "t_end": at(i) + timedelta(seconds=took), "command_shell": command if tool == "Bash" else None, **more})
        return self

    def message(self, i, text, trial_id="a", source="agent"):
        self.rows["steps"].append({"trial_id": trial_id, "step_idx": i, "source": source, "message": text})
        return self

    def change(self, i, path, before=None, after="x", op=None, hunk=None, trial_id="a", mtime=None):
        op = op or ("add" if before is None else "delete" if after is None else "modify")
        self.rows["deltas"].append({"trial_id": trial_id, "step_idx": i, "path": path, "op": op, "sha256_before": before, "sha256_after": after, "hunk": hunk, "mtime_after": mtime})
        return self

    def write(self, i, path, writer, trial_id="a"):
        self.rows["writes"].append({"trial_id": trial_id, "step_idx": i, "path": path, "writer_step": writer, "events": 1, "ops": ["modify"], "first_at": START, "last_at": START})
        return self

    def notice(self, call, task, minutes, trial_id="a"):
        self.rows["job_notices"].append({"trial_id": trial_id, "task_id": task, "tool_call_id": f"c{call}", "status": "completed", "noticed_at": at(minutes)})
        return self

    def tables(self, spark):
        out = {}
        for name, rows in self.rows.items():
            schema = schemas.schema(name)
            for f in schema.fields:
                f.nullable = True
            out[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
        return out


def by_step(df, column):
    return {r.step_idx: r[column] for r in df.collect()}


def test_step_flags(spark):
    t = (Rows().trial().call(1).change(1, "/a.py").call(2, output="Exit code 2").call(3, took=121).call(4, took=500).change(4, "/x/__pycache__/a.pyc")
         .call(5, command="FOO=1 timeout 5 python -m pytest -q").call(6, command="pip install pytest").call(7, tool="Stop", command="").message(8, "done").call(9, tool=None, command="")).tables(spark)
    t["steps"] = t["steps"].replace(9, 10, "step_idx")
    out = {r.step_idx: r for r in sorted(views.step_flags(t).collect(), key=lambda r: r.step_idx)}
    assert [i for i, r in out.items() if r.is_tool_call] == [1, 2, 3, 4, 5, 6]
    assert [i for i, r in out.items() if r.is_mutating] == [1] and out[4].files_touched == 1
    assert [i for i, r in out.items() if r.has_error_marker] == [2]
    assert [i for i, r in out.items() if r.is_tail_probe] == [2, 3, 4, 5, 6]
    assert [i for i, r in out.items() if r.is_idle_wait] == [3, 4]
    assert [i for i, r in out.items() if r.is_test_command] == [5]


@pytest.mark.parametrize("output,marked", [
    ("ok", False), ("[exit_code] 1", True), ("[exit_code] 0", False), ("x\nTraceback (most recent call last)", True), ("FAILED a", True), ("3 failed", True), ("0 failed", False),
    ("ValueError: x", True), ("a ValueError: x", False), ("line\rFAILED b", False)])
def test_error_markers(spark, output, marked):
    assert by_step(views.step_flags(Rows().trial().call(1, output=output).tables(spark)), "has_error_marker") == {1: marked}


def test_trial_without_change_is_all_probes(spark):
    assert by_step(views.step_flags(Rows().trial().call(1).call(2).tables(spark)), "is_tail_probe") == {1: True, 2: True}


def test_reverts(spark):
    t = (Rows().trial().change(1, "/a", "h1", "h2").change(2, "/a", "h2", "h1").change(3, "/a", "h1", "h1").change(4, "/b", "h1", "h1").change(5, "/b", "h1", "h1")
         .change(6, "/c", "h1", None).change(7, "/c", None, "h1")).tables(spark)
    assert by_step(views.delta_flags(t), "is_revert") == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True}


def test_prompt_paths_and_versions(spark):
    t = Rows().trial(prompt="See http://x.org/app/out.txt and write /app/plan.json. Use /data/in/ too").change(1, "/app/plan.json").change(2, "/app/plan.json", "x", "y").change(3, "/data/in").change(4, "/app/out.txt").tables(spark)
    out = {r.step_idx: (r.names_prompt_path, r.version) for r in views.delta_flags(t).collect()}
    assert out == {1: (True, 1), 2: (True, 2), 3: (True, 1), 4: (False, 1)}


def _hunk(*lines):
    return "--- a\n+++ b\n@@\n" + "\n".join("+" + x for x in lines)


def test_script_variants(spark):
    five = ["a", "b", "c", "d", "e"]
    t = (Rows().trial().change(1, "/one.py", hunk=_hunk(*five)).change(2, "/two.py", hunk=_hunk("a", " b ", "c", "x", "y")).change(3, "/few.py", hunk=_hunk("a", "b"))
         .change(4, "/best.py", hunk=_hunk("a", "b", "c", "x", "q")).change(4, "/same.py", hunk=_hunk(*five)).change(5, "/no.txt", hunk=_hunk(*five)).change(6, "/none.py")).tables(spark)
    out = {r.path: (r.is_script_add, r.variant_of) for r in views.delta_flags(t).collect()}
    assert out == {"/one.py": (True, None), "/two.py": (True, "/one.py"), "/few.py": (True, None), "/best.py": (True, "/two.py"), "/same.py": (True, "/one.py"), "/no.txt": (False, None), "/none.py": (True, None)}


def test_path_versions_keep_a_last_null(spark):
    t = Rows().trial().change(2, "/a", "x", "y", hunk="h").change(1, "/a", None, "x", hunk="g").change(5, "/a", "y", None).tables(spark)
    (row,) = views.path_versions(t).collect()
    assert (row.versions, row.steps, row.first_step, row.last_step, row.last_op, row.last_hunk) == (3, [1, 2, 5], 1, 5, "delete", None)


def test_trial_summary(spark):
    r = Rows()
    for name, said, test_at, failed in (("a", "All tests pass", 3, False), ("b", "All done", 1, False), ("c", "done", 3, True), ("d", "not done", 1, False), ("e", "", 1, False)):
        r.trial(name).change(2, "/f.py", trial_id=name, hunk="+x").call(2, trial_id=name).call(test_at, command="pytest", error=failed, trial_id=name).message(9, said, trial_id=name).message(10, " ", trial_id=name).message(11, "done", trial_id=name, source="user")
    r.trial("empty")
    out = {x.trial_id: x for x in views.trial_summary(r.tables(spark)).collect()}
    assert {k for k, x in out.items() if x.unverified_completion} == {"b", "c"}
    assert (out["a"].tool_calls, out["a"].mutating_calls, out["a"].scripts_added, out["a"].tail_probes) == (2, 1, 1, 1)
    assert (out["empty"].tool_calls, out["empty"].first_error_step, out["empty"].unverified_completion) == (0, None, False)


def test_step_jobs(spark):
    t = (Rows().trial().call(1, command="train", output="Command running in background with ID: b1x").call(2, command="serve &").call(3, command="a && b 2>&1").call(4, output="moved to the background (ID: z9)").call(6, tool="Read", command="/x")
         .notice(1, "b1x", 3.5)).tables(spark)
    out = {r.step_idx: r for r in views.step_jobs(t).collect()}
    assert (out[1].backgrounded, out[1].task_id, out[1].job_status, out[1].background_done_step) == (True, "b1x", "completed", 4)
    assert out[4].task_id == "z9" and out[4].job_end == at(6) + timedelta(seconds=1) and out[4].background_done_step is None
    assert [i for i, r in out.items() if r.launches_job] == [2] and out[2].job_end is None and out[6].backgrounded is False


def attributed(spark, rows):
    return {r.step_idx: r for r in views.delta_attribution(rows.tables(spark)).collect()}


def test_attribution_rules(spark):
    done = {"checkpoint_at": None}
    r = Rows().trial().call(1, command="nohup python gen.py > /w/d/log_$s.txt &").call(2, command="python train.py --out /w/d", output="Command running in background with ID: b1", **done)
    r.call(3, tool="Write", command="/w/d/log_7.txt").call(4, command="ls").call(5, command="ls").call(6, command="ls").call(7, command="ls").call(8, command="ls").notice(2, "b1", 5.5)
    r.change(3, "/w/d/log_7.txt", mtime=at(3)).change(4, "/w/d/log_8.txt", mtime=at(4)).change(5, "/other", mtime=at(5)).change(6, "/late", mtime=at(5.2)).change(7, "/old", mtime=at(-100)).change(8, "/gone", "x", None)
    out = attributed(spark, r)
    assert out[3].attribution == "contested" and out[3].causal_step == 3
    assert (out[4].attribution, out[4].causal_step, out[4].is_late) == ("background_untracked", 1, True)
    assert out[5].attribution == "foreground" and out[5].launched_by_step == 5
    assert (out[6].attribution, out[6].launcher_step) == ("background", 2)
    assert (out[7].attribution, out[7].launched_by_step) == ("untrusted_mtime", None)
    assert out[8].attribution == "unknown" and out[8].write_at is None


def test_attribution_by_path_beats_the_latest(spark):
    r = Rows().trial().call(1, command="gen --out result.csv", output="Command running in background with ID: a1").call(2, command="serve", output="Command running in background with ID: a2").call(5).change(5, "/w/result.csv", mtime=at(4))
    assert (attributed(spark, r)[5].attribution, attributed(spark, r)[5].causal_step) == ("background_by_path", 1)


def test_recorded_writers_come_first(spark):
    r = Rows().trial().call(1).call(2).call(3).call(4).change(2, "/a", mtime=at(2)).change(3, "/b", mtime=at(3)).change(4, "/c", mtime=at(4)).write(2, "/a", 1).write(3, "/b", 1).write(3, "/b", 2).write(4, "/c", None)
    out = attributed(spark, r)
    assert (out[2].attribution, out[2].causal_step, out[2].is_late, out[2].rule_attribution) == ("recorded", 1, True, "foreground")
    assert (out[3].attribution, out[3].causal_step, out[3].writer_steps) == ("multi_writer", 3, [1, 2])
    assert (out[4].attribution, out[4].writer_steps) == ("foreground", [])


def test_views_do_not_depend_on_other_trials(spark):
    a, both = Rows(), Rows()
    for r, names in ((a, "a"), (both, "ab")):
        for n in names:
            r.trial(n, "write /f.py").call(1, command="x > /f.py &", trial_id=n).call(2, trial_id=n).change(2, "/f.py", hunk=_hunk(*"abcde"), trial_id=n, mtime=at(1.5)).message(3, "done", trial_id=n)
    one, two = a.tables(spark), both.tables(spark)
    for name, build in views.VIEWS.items():
        assert build(one).exceptAll(build(two).where("trial_id = 'a'")).count() == 0, name


def test_questions_in_full(spark):
    from wayfold.plans import catalog
    from wayfold.sources import adapter

    sf = "/root/testdata/sf0.001"
    t = adapter.model(spark, sf)
    calls = catalog.QUERIES["q4_calls"](spark, sf)
    assert calls.count() == views.step_flags(t).where("is_tool_call").count()
    assert calls.where("not has_error_marker").count() > 0
    diffs = catalog.QUERIES["q3b_diffs"](spark, sf)
    assert diffs.count() == views.delta_flags(t).where("not is_cache").join(t["deltas"].where("hunk is not null"), ["trial_id", "step_idx", "path"]).count()
    assert diffs.where("op <> 'add'").count() > 0
