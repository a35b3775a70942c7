"""Writer attribution by its rules, one by one."""

import pytest
from pyspark.sql import functions as F
from wayfold.operators import writers

S = 1_000_000
STEPS = "trial_id string, step_idx int, tool string, command string, t_start long, t_end long"
EVENTS = "trial_id string, event_id long, at long, agent boolean, sid long, started_at long, origin_started long, shell struct<pid: long, started_at: long, command_sha256: string>"


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([
        ("t", 1, "Bash", "make", 10 * S, 20 * S), ("t", 2, "Bash", "make", 100 * S, 400 * S), ("t", 3, "Bash", "make", 150 * S, 200 * S), ("t", 4, "Write", None, 500 * S, 510 * S),
        ("t", 5, "Bash", "ls 2>NUL", 600 * S, None), ("t", 6, "Edit", None, 508 * S, 520 * S), ("t", 7, "Bash", None, None, None), ("u", 1, "Bash", "make", 10 * S, 20 * S)], STEPS)


def found(spark, steps, *events):
    rows = [(e.get("trial", "t"), i, e.get("at", 0), e.get("agent", False), e.get("sid"), e.get("began"), e.get("origin"), e.get("shell")) for i, e in enumerate(events)]
    out = writers.attributed(spark.createDataFrame(rows, EVENTS), steps)
    return [(r.writer_step, r.mapped_by) for r in out.orderBy("event_id").collect()]


def test_each_rule(spark, steps):
    make, other = sha("make"), sha("other")
    cases = [
        ({"shell": (1, 160 * S, make)}, (3, "command")),  # two are running: the one that ends first
        ({"shell": (1, 300 * S, make)}, (2, "command")),
        ({"shell": (1, 450 * S, make)}, (3, "command")),  # none is running: the latest begun
        ({"shell": (1, None, make)}, (1, "command")),
        ({"shell": (1, 5 * S, make)}, (None, None)),  # begun before all of them
        ({"shell": (1, 600 * S, sha("ls 2>/dev/null"))}, (5, "command")),
        ({"shell": (1, None, sha("ls 2>NUL"))}, (5, "command")),
        ({"shell": (1, 15 * S, other)}, (1, "start_time")),
        ({"shell": (1, 160 * S, other)}, (None, None)),  # two steps hold it
        ({"at": 505 * S, "agent": True}, (4, "tool_window")),
        ({"at": 509 * S, "agent": True}, (None, None)),
        ({"at": 505 * S, "agent": True, "shell": (2, None, other)}, (None, None)),
        ({"began": 21 * S}, (1, "start_time")),  # a second over
        ({"began": 22 * S}, (None, None)),
        ({"began": 22 * S, "origin": 12 * S}, (1, "start_time")),
        ({"began": 12 * S, "agent": True}, (None, None)),
        ({"agent": None, "began": 12 * S}, (1, "start_time")),
        ({"trial": "v", "began": 12 * S}, (None, None)),
    ]
    assert found(spark, steps, *[c for c, _ in cases]) == [w for _, w in cases]


def test_a_pid_used_again_is_another_shell(spark, steps):
    make = sha("make")
    shells = [{"shell": (9, 15 * S, make)}, {"shell": (9, 160 * S, make)}, {"trial": "u", "shell": (9, 15 * S, make)}]
    asked = [{"sid": 9, "began": 100 * S, "at": 0}, {"sid": 9, "began": 159 * S}, {"sid": 9}, {"sid": 9, "began": 1 * S}, {"sid": 8}, {"trial": "u", "sid": 9}]
    assert found(spark, steps, *shells, *asked)[3:] == [(1, "session"), (3, "session"), (3, "session"), (None, None), (None, None), (1, "session")]


def test_a_shell_without_a_start_counts_as_begun_at_the_event(spark, steps):
    shells = [{"shell": (9, 160 * S, sha("make"))}, {"shell": (9, None, sha("ls 2>NUL"))}]
    asked = [{"sid": 9, "at": 161 * S}, {"sid": 9, "at": 160 * S}]
    assert found(spark, steps, *shells, *asked)[2:] == [(5, "session"), (3, "session")]


def test_no_events_and_no_steps(spark, steps):
    none = spark.createDataFrame([], EVENTS)
    assert writers.attributed(none, steps).count() == 0
    assert found(spark, steps.limit(0), {"shell": (1, 1, sha("make")), "sid": 1}) == [(None, None)]


def test_hashes_of_a_command(spark):
    rows = spark.createDataFrame([("a >NUL",), ("a $x >nul",), ("a >nullable",), (None,)], "c string").select(F.size(writers.command_hashes(F.col("c"))).alias("n"))
    assert [r.n for r in rows.collect()] == [2, 1, 1, 0]


def test_commands_are_hashed_once(spark, capsys):
    """What is found for shells reads written hashes, and hashes no command again each time it reads them."""
    steps = spark.createDataFrame([("t", 1, "Bash", "a >NUL", 0, 9), ("t", 2, "Bash", "b", 10, 19), ("t", 3, "Bash", "b", 20, 29)], "trial_id string, step_idx int, tool string, command string, t_start long, t_end long")
    shells = spark.createDataFrame([("t", 1, None, sha("a >/dev/null")), ("t", 2, None, sha("a >NUL")), ("t", 3, 2_000_000, sha("b")), ("t", 4, None, sha("c"))], "trial_id string, pid int, started_at long, command_sha256 string")
    found = writers.by_command(shells, steps)
    found.explain("extended")
    assert "sha2(" not in capsys.readouterr().out
    assert {r.pid: r.command_step for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: None}
