"""Versions of files: hunks, reverts, stale diffs, excluded paths, transcripts, labels as rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import ancestors

#: What a diff writes after a line without a line end (fixed value).
NO_END = "\\ No newline at end of file"


def normal_line(line: Column) -> Column:
    """A line as blame compares it: without blanks at its end."""
    return F.rtrim(line)


def first_seen(versions: DataFrame, by: Sequence[str], index: str = "index", lines: str = "lines") -> DataFrame:
    """(by, line, index): the first version that holds each line, moved and restored lines included."""
    each = versions.select(*by, index, F.explode(lines).alias("line")).withColumn("line", normal_line(F.col("line")))
    return each.groupBy(*by, "line").agg(F.min(index).alias(index))


def diff_hunk(before: Column, after: Column, context: int | None = None) -> Column:
    """One unified diff of two texts, of the whole file or with `context` lines around changes; null: no such file."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_rendered(x, y, context) for x, y in zip(a, b, strict=True)])

    return run(before, after)


def _rendered(before: str | None, after: str | None, context: int | None) -> str:
    old, new = ((x or "").splitlines(keepends=True) if "\r" not in (x or "") else re.findall(r"[^\n]*\n|[^\n]+", x) for x in (before, after))
    if not old and not new:
        return ""
    match = SequenceMatcher(None, old, new, autojunk=False)
    groups = match.get_grouped_opcodes(context) if context is not None else [match.get_opcodes()]
    out = ["--- /dev/null\n" if before is None else "--- a\n", "+++ /dev/null\n" if after is None else "+++ b\n"]
    for codes in groups:
        (_, i, _, j, _), (_, _, i_end, _, j_end) = codes[0], codes[-1]
        out.append(f"@@ -{i + (i_end > i)},{i_end - i} +{j + (j_end > j)},{j_end - j} @@\n")
        for tag, i1, i2, j1, j2 in codes:
            marked = [" " + x for x in old[i1:i2]] if tag == "equal" else ["-" + x for x in old[i1:i2]] + ["+" + x for x in new[j1:j2]]
            out += [x if x.endswith("\n") else f"{x}\n{NO_END}\n" for x in marked]
    return "".join(out)


def hunk_versions(hunk: Column) -> Column:
    """Struct (before, after) of a whole-file hunk: the texts on both sides, null for one that is not a file.

    An empty hunk is two empty texts; null, or a text that is no whole-file hunk, is null."""
    rows = F.split(hunk, "\n", -1)
    body = F.slice(rows, F.lit(4), F.greatest(F.size(rows) - 4, F.lit(0)))
    # Each line with the next one; an array looked up within the lambda would be made anew for every line.
    following = F.slice(rows, F.lit(5), F.greatest(F.size(rows) - 5, F.lit(0)))
    named = F.zip_with(body, following, lambda x, y: F.struct(F.left(x, F.lit(1)).alias("tag"), F.concat(
        x.substr(F.lit(2), F.length(x)), F.when(F.coalesce(y == NO_END, F.lit(False)), "").otherwise("\n")).alias("line")))
    side = lambda tag: F.array_join(F.transform(F.filter(named, lambda x: x["tag"].isin(" ", tag)), lambda x: x["line"]), "")
    whole = (F.size(rows) > 4) & F.get(rows, F.lit(0)).startswith("--- ") & F.get(rows, F.lit(1)).startswith("+++ ") & F.get(rows, F.lit(2)).rlike(
        r"^@@ -[01](?:,\d+)? \+[01](?:,\d+)? @@") & ~F.exists(F.slice(named, 1, F.size(named)), lambda x: ~x["tag"].isin(" ", "-", "+", "\\"))
    there = lambda at, name, text: F.when(F.get(rows, F.lit(at)) != f"{name} /dev/null", text)
    pair = F.struct(there(0, "---", side("-")).alias("before"), there(1, "+++", side("+")).alias("after"))
    return F.when(hunk == "", F.struct(F.lit("").alias("before"), F.lit("").alias("after"))).when(F.coalesce(whole, F.lit(False)), pair)


def narrowed(hunk: Column, context: int) -> Column:
    """A whole-file hunk with `context` lines around each change."""
    both = hunk_versions(hunk)
    return F.when(both.isNotNull(), diff_hunk(both["before"], both["after"], context))


def reverts(changes: DataFrame, by: Sequence[str], order: str, before: str = "sha256_before", after: str = "sha256_after") -> DataFrame:
    """`changes` with reverts_to: `original`, or the latest earlier change that left the same contents; null if neither.

    `by` names a file. What the change before left is no version to go back to."""
    file, same = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, after).orderBy(order)
    first = F.first(before).over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last, moved = F.lag(after).over(file), F.row_number().over(file) > 1
    away = moved & F.col(after).isNotNull() & ~F.col(after).eqNullSafe(last)
    return changes.withColumn("reverts_to", F.when(away & (F.col(after) == first), F.lit("original")).when(away, F.lag(order).over(same).cast("string")))


def stale(changes: DataFrame, by: Sequence[str], order: str, before: str = "sha256_before", after: str = "sha256_after") -> DataFrame:
    """`changes` with read_at and unread_at where a diff is against a version before the last one.

    A change is read if its contents were (a hash) or if it removed the file. read_at is the last read one that the
    diff starts from, unread_at the first unread one since; both null where the diff is against the last version."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    read = F.col(after).isNotNull() | (F.col("op") == "delete")
    at = changes.withColumn("_read", F.max(F.when(read, F.struct(F.col(order).alias("at"), F.col(after).alias("sha")))).over(past))
    since = Window.partitionBy(*by, "_read").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_unread", F.min(F.when(~read, F.col(order))).over(since))
    hit = F.col("_read").isNotNull() & F.col("_unread").isNotNull() & (F.col("op") == "modify") & (F.col(before) == F.col("_read.sha"))
    return at.withColumn("read_at", F.when(hit, F.col("_read.at"))).withColumn("unread_at", F.when(hit, F.col("_unread"))).drop("_read", "_unread")


def drop_excluded(changes: DataFrame, by: Sequence[str], excluded: str, path: str = "path", op: str = "op") -> DataFrame:
    """`changes` without paths that match `excluded`, nor added or deleted directories that hold only such ones."""
    out = changes.where(F.col(path).rlike(excluded))
    kept = changes.where(~F.col(path).rlike(excluded))
    above = lambda rows: rows.select(*by, F.explode(ancestors(F.col(path))).alias(path)).distinct()
    hollow = above(out).join(above(kept), [*by, path], "left_anti").withColumn("_hollow", F.lit(True))
    return kept.join(hollow, [*by, path], "left").where(F.col("_hollow").isNull() | ~F.col(op).isin("add", "delete")).select(*changes.columns)


def transcript(messages: DataFrame, by: Sequence[str], order: str, who: str, text: str) -> DataFrame:
    """(by, transcript): the messages of a run in order, each under its speaker; one run is one text."""
    said = F.concat(F.lit("## "), F.coalesce(F.col(who), F.lit("?")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("s"))))
    return messages.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n\n").alias("transcript"))


def label_rows(labels: DataFrame, by: Sequence[str], patterns: Sequence[str], steps: str = "steps") -> DataFrame:
    """(by, tool_call_id, judged, one 0/1 column for each pattern): a row for each label of the map `steps`."""
    each = labels.select(*by, F.explode(steps).alias("tool_call_id", "label"))
    found = [F.coalesce(F.array_contains("label.patterns", p), F.lit(False)).cast("int").alias(p) for p in patterns]
    return each.select(*by, "tool_call_id", F.col("label.patterns").isNotNull().alias("judged"), *found)


def first_passes(classes: DataFrame, points: DataFrame, by: Sequence[str], index: str = "index") -> DataFrame:
    """(by, check, point): checks that pass to the end and did not from the first point on."""
    start = points.groupBy(*by).agg(F.min(index).alias("_start"))
    return classes.where("verdict = 'passes'").join(start, list(by)).where(F.col("point") > F.col("_start")).select(*by, "check", "point")


def confirmed(replays: DataFrame, by: Sequence[str], quorum: int) -> DataFrame:
    """(by, replays, confirms): `quorum` replays or more, all of which fixed the check and broke none."""
    good = F.col("fixed") & ~F.col("broke_any")
    return replays.groupBy(*by).agg(F.count("*").alias("replays"), (F.bool_and(good) & (F.count("*") >= quorum)).alias("confirms"))
