"""One read-only query at a time: what may run, how much of it is shown, how long it may take."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_CAP, TIMEOUT_S = 200, 10.0
#: Functions that run code or read the machine (fixed values), lower case.
DENIED = ("reflect", "java_method", "try_reflect", "input_file_name", "raise_error", "assert_true", "sleep", "read_files")
#: What may stand before a table's name: the session's catalog and its databases. Anything else may be a format, or the class of one, before a file's name.
CATALOG, FILES_ON = "spark_catalog", "spark.sql.runSQLOnFiles"
#: Nodes of statements that are no queries, or that run a program.
_OTHER = re.compile(r"Command|Insert|Create|Replace(?:Table|Columns)|Drop|Alter|Merge|Update|Delete|Truncate|ScriptTransformation")
_LEAD = re.compile(r"(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.DOTALL)


class Refused(ValueError):
    """The statement is not one SELECT or WITH query of allowed functions."""


def check(spark: SparkSession, sql: str) -> None:
    """Raise Refused unless `sql` is one query that starts with SELECT or WITH; parsed by Spark, not run."""
    text = sql[_LEAD.match(sql).end() :]
    if not re.match(r"(?:select|with)\b", text, re.IGNORECASE):
        raise Refused("only a SELECT or WITH query")
    try:
        nodes = list(_nodes(json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.rstrip().rstrip(";")).toJSON())))
    except Exception as error:
        raise Refused(f"not valid SQL: {str(error).strip().splitlines()[0][:200]}") from error
    databases = [d.name.lower() for d in spark.catalog.listDatabases()] + [spark.conf.get("spark.sql.globalTempDatabase", "global_temp")]
    qualifiers = [q for d in databases for q in ([d], [CATALOG, d])]
    for kind, name in nodes:
        if _OTHER.search(kind):
            raise Refused("only a SELECT or WITH query")
        if "Identifier" in kind:
            raise Refused("names that are computed are not available")
        if "Function" in kind and name and name[-1].lower() in DENIED:
            raise Refused(f"function {name[-1].lower()} is not available")
        if "Relation" in kind and len(name) > 1 and [x.lower() for x in name[:-1]] not in qualifiers:
            raise Refused("files are not available")


def _nodes(tree):
    """(class, name parts) of every node of a parsed plan and of its expressions, subqueries included."""
    if isinstance(tree, dict):
        if "class" in tree:
            name = tree.get("nameParts") or tree.get("multipartIdentifier") or tree.get("name") or ""
            yield tree["class"].rsplit(".", 1)[-1], [x.strip() for x in name.strip("[]").split(",")] if isinstance(name, str) else []
        tree = list(tree.values())
    if isinstance(tree, list):
        for x in tree:
            yield from _nodes(x)


@dataclass(frozen=True)
class Outcome:
    """rows as JSON text and whether there were more, or an error; never both."""

    rows: tuple[str, ...] | None
    truncated: bool
    error: str | None
    latency_ms: int


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("value"))


def run(spark: SparkSession, sql: str, cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> Outcome:
    """At most `cap` rows of a checked query; jobs still running at the timeout are cancelled. Never raises."""
    began, group = time.monotonic(), f"guard-{uuid.uuid4().hex}"
    ms = lambda: int((time.monotonic() - began) * 1000)
    late, files = threading.Event(), spark.conf.get(FILES_ON, None)

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(group)

    timer = threading.Timer(timeout_s, stop)
    try:
        check(spark, sql)
        spark.conf.set(FILES_ON, "false")
        spark.sparkContext.addJobTag(group)
        timer.start()
        # One more than the cap tells that there are more; the rest is never counted.
        rows = [r.value for r in json_rows(spark.sql(sql.rstrip().rstrip(";"))).limit(cap + 1).collect()]
        return Outcome(tuple(rows[:cap]), len(rows) > cap, None, ms())
    except Refused as error:
        return Outcome(None, False, f"refused: {error}", ms())
    except Exception as error:
        return Outcome(None, False, f"timed out after {timeout_s:g} s" if late.is_set() else str(error).strip().splitlines()[0], ms())
    finally:
        spark.conf.unset(FILES_ON) if files is None else spark.conf.set(FILES_ON, files)
        timer.cancel()
        spark.sparkContext.removeJobTag(group)


def render(outcome: Outcome, cap: int = ROW_CAP) -> str:
    """What an agent is shown: a row a line, then how many there are."""
    if outcome.error:
        return outcome.error + "\n"
    lines = [*outcome.rows, f"({len(outcome.rows)} rows" + (f", cut at {cap})" if outcome.truncated else ")")]
    return "\n".join(lines) + "\n"


def log_row(query_id: str, trial_name: str, received_at, sql: str, outcome: Outcome) -> dict:
    """One row for each request, refusals included."""
    return {
        "query_id": query_id, "trial_name": trial_name, "received_at": received_at, "sql": sql, "rows": None if outcome.error else len(outcome.rows),
        "truncated": outcome.truncated, "latency_ms": outcome.latency_ms, "error": outcome.error}
