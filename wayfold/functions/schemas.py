"""Schemas of the record and held-out tables, and their row constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 6

RECORD = {
    "trials": "trial_id string not null, trial_name string not null, task string not null, attempt_idx int not null, parent_trial_id string, "
    "prompt string not null, model string not null, harness string not null, harness_version string, reward double, tokens_in bigint, "
    "tokens_out bigint, cost_usd double, wall_ms bigint",
    "steps": "trial_id string not null, step_idx int not null, atif_step_id int, source string not null, tool_call_id string, tool string, "
    "args_json string, output string, is_error boolean, message string, reasoning string, t_start timestamp, t_end timestamp, "
    "checkpoint_seq int, checkpoint_id string, checkpoint_at timestamp, command_shell string",
    "deltas": "trial_id string not null, step_idx int not null, path string not null, op string not null, kind_before string, kind_after string, "
    "is_text boolean, hunk string, blob_ref string, sha256_before string, sha256_after string, bytes_before bigint, bytes_after bigint, "
    "mode_before string, mode_after string, owner_before string, owner_after string, mtime_before timestamp, mtime_after timestamp",
    "job_notices": "trial_id string not null, task_id string not null, tool_call_id string not null, status string not null, noticed_at timestamp not null",
    "writes": "trial_id string not null, step_idx int not null, path string not null, writer_step int, mapped_by string, events int not null, "
    "ops array<string> not null, first_at timestamp not null, last_at timestamp not null, via_dir string",
}
HELD_OUT = {
    "checks": "trial_id string not null, check_id string not null, passed boolean, fault_id string",
    "faults": "trial_id string not null, fault_id string not null, kind string not null, method string not null, flags array<string> not null",
    "blame": "trial_id string not null, fault_id string not null, role string not null, fix_id string, tool_call_id string not null, step_idx int",
    "chains": "trial_id string not null, complete boolean not null, hooked_calls int not null, answered_calls int not null, "
    "timed_out_calls array<string> not null, unanswered_calls array<string> not null, interrupted_calls array<string> not null, "
    "rejected_calls array<string> not null, checkpoints int not null, images_checked boolean not null, missing_images array<int> not null, "
    "final_state_recorded boolean not null, reasons array<string> not null",
}
KEYS = {
    "trials": ["trial_id"], "steps": ["trial_id", "step_idx"], "deltas": ["trial_id", "step_idx", "path"], "job_notices": ["trial_id", "task_id"],
    "checks": ["trial_id", "check_id"], "faults": ["trial_id", "fault_id"], "chains": ["trial_id"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL({**RECORD, **HELD_OUT}[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of `name`, in order and typed; absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])


def _same_nullness(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() == F.col(cols[0]).isNull() for c in cols[1:]])


def _matches(col: str, pattern: str) -> Column:
    return F.col(col).isNull() | F.col(col).rlike(pattern)


def rules(name: str) -> dict[str, Column]:
    """What must hold of each row: rule name to a condition that is never null."""
    c = F.col
    if name == "trials":
        return {"first_attempt_has_no_parent": (c("attempt_idx") == 0) == c("parent_trial_id").isNull()}
    if name == "steps":
        return {
            "checkpoint_pair": _same_nullness("checkpoint_seq", "checkpoint_id"),
            "checkpoint_time": c("checkpoint_at").isNull() | c("checkpoint_seq").isNotNull(),
            "call_parts": c("tool").isNotNull() | (c("args_json").isNull() & c("output").isNull()),
            "command_only_for_shell": c("command_shell").isNull() | c("tool").eqNullSafe("Bash"),
        }
    if name == "deltas":
        before, after = c("kind_before").isNotNull(), c("kind_after").isNotNull()
        return {
            "op_fits_kinds": F.coalesce(F.when(c("op") == "add", ~before & after).when(c("op") == "delete", before & ~after).when(c("op") == "modify", before & after), F.lit(False)),
            "times_fit_kinds": (before | c("mtime_before").isNull()) & (after | c("mtime_after").isNull()),
            "hunk_is_text": c("hunk").isNull() | c("is_text").eqNullSafe(True),
            "blob_is_no_text": c("blob_ref").isNull() | (c("is_text").eqNullSafe(False) & after),
            "digests": _matches("sha256_before", r"^[0-9a-f]{64}\z") & _matches("sha256_after", r"^[0-9a-f]{64}\z"),
            "modes": _matches("mode_before", r"^[0-7]{4}\z") & _matches("mode_after", r"^[0-7]{4}\z"),
            "owners": _matches("owner_before", r"^\d+:\d+\z") & _matches("owner_after", r"^\d+:\d+\z"),
            "absolute_path": c("path").startswith("/"),
        }
    if name == "writes":
        return {
            "writer_and_rule": _same_nullness("writer_step", "mapped_by"), "times_in_order": c("first_at") <= c("last_at"),
            "has_events": (c("events") >= 1) & (F.size("ops") > 0),
        }
    if name == "chains":
        return {"complete_without_reasons": c("complete") == (F.size("reasons") == 0)}
    return {}


def violations(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` that break a constraint, with `broken`: the names of those they break."""
    checks = rules(name)
    required = {f"{f.name}_is_null": F.col(f.name).isNotNull() for f in schema(name).fields if not f.nullable}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in {**required, **checks}.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def repeated_keys(df: DataFrame, name: str) -> DataFrame:
    """Keys that more than one row has, with their count: the primary key check."""
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("rows")).where("rows > 1")
