"""Files rebuilt from chains of diffs.

A diff is an edit: an ordered list of ranges of the lines before and of new lines. Edits compose, and composing is associative, so the
edits of a file up to each of its changes come from joins of a change with the one 1, 2, 4, ... changes earlier; no task goes through
a file's changes one after another. An edit without ranges is a text. A text counts as known only if the diff's own context fits the text before, the
recorded hash before is that text's, and its hash is the recorded one."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import written

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: A range [f, t) of the lines before, t null: to their end; or, with f null, new lines.
PIECES = "array<struct<f: long, t: long, lines: array<string>>>"
#: What a diff says: its edit, what it takes the lines before to be, and the numbers of the lines it adds or changes, from 1.
DIFF = f"struct<edit: {PIECES}, old: array<struct<at: long, lines: array<string>>>, changed: array<int>>"


def _keep(f: int, t: int | None) -> dict:
    return {"f": f, "t": t, "lines": None}


def parsed(diff: str | None) -> dict | None:
    """A unified diff as DIFF; None if it is none. An empty one changes nothing; one from /dev/null has no ranges."""
    if diff is None:
        return None
    lines = diff.split("\n")
    fresh = diff.startswith("--- /dev/null")
    edit, old, changed, at, n = [], [], [], 0, 0
    while n < len(lines) and not lines[n].startswith("@@"):
        n += 1
    while n < len(lines):
        head = _HUNK.match(lines[n])
        if head is None:
            return None
        count, new_count = int(head[2] or 1), int(head[4] or 1)
        start, number = int(head[1]) - (count > 0), int(head[3]) + (new_count == 0)
        if start < at:
            return None
        if start > at and not fresh:
            edit.append(_keep(at, start))
        at, seen = start, []
        n += 1
        while n < len(lines) and not lines[n].startswith("@@"):
            tag, text = lines[n][:1], lines[n][1:]
            n += 1
            if tag in (" ", "-"):
                seen.append(text)
                if tag == " ":
                    edit.append(_keep(at, at + 1))
                    number += 1
                at += 1
            elif tag == "+":
                edit.append({"f": None, "t": None, "lines": [text]})
                changed.append(number)
                number += 1
            elif tag != "\\" and tag:
                return None
        old.append({"at": start, "lines": seen})
    if not fresh:
        edit.append(_keep(at, None))
    return {"edit": _joined(edit), "old": old, "changed": changed}


def _joined(edit: list[dict]) -> list[dict]:
    """Neighbouring ranges, and neighbouring new lines, as one."""
    out: list[dict] = []
    for p in edit:
        last = out[-1] if out else None
        if last and p["f"] is None and last["f"] is None:
            last["lines"] = [*last["lines"], *p["lines"]]
        elif last and p["f"] is not None and last["f"] is not None and last["t"] == p["f"]:
            last["t"] = p["t"]
        else:
            out.append(dict(p))
    return out


def composed(first: list, then: list) -> list[dict] | None:
    """The edit that is `first` and then `then`; None if `then` takes more lines than `first` leaves."""
    out = []
    for p in then:
        if p["f"] is None:
            out.append(dict(p))
            continue
        at, need_f, need_t = 0, p["f"], p["t"]
        for q in first:
            size = len(q["lines"]) if q["f"] is None else None if q["t"] is None else q["t"] - q["f"]
            end = None if size is None else at + size
            a = max(need_f, at)
            b = need_t if end is None else end if need_t is None else min(end, need_t)
            if b is None or a < b:
                if q["f"] is None:
                    out.append({"f": None, "t": None, "lines": list(q["lines"][a - at : b - at])})
                else:
                    out.append(_keep(q["f"] + a - at, None if b is None else q["f"] + b - at))
            at = end
            if at is None:
                break
        if at is not None and (need_f > at or need_t is not None and need_t > at):
            return None
    return _joined(out)


def read_diff(diff: Column) -> Column:
    """A unified diff as DIFF; its fields are null if it is none."""

    def run(diff: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(d) or {"edit": None, "old": None, "changed": None} for d in diff], columns=["edit", "old", "changed"])

    return F.pandas_udf(run, DIFF)(diff)


def compose(first: Column, then: Column) -> Column:
    """The edit that is `first` and then `then`."""

    def whole(x):  # places beside nulls come as floats
        return None if x is None or x != x else int(x)

    def pieces(edit) -> list[dict]:
        return [{"f": whole(p["f"]), "t": whole(p["t"]), "lines": None if p["lines"] is None else list(p["lines"])} for p in edit]

    def run(first: pd.Series, then: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else composed(pieces(a), pieces(b)) for a, b in zip(first, then)])

    return F.pandas_udf(run, PIECES)(first, then)


def _text(edit: Column) -> Column:
    """The lines of an edit without ranges, else null."""
    fixed = ~F.exists(edit, lambda p: p["f"].isNotNull())
    return F.when(fixed, F.flatten(F.transform(edit, lambda p: p["lines"])))


def file_after(changes: DataFrame, by: Sequence[str], order: str, op: str = "op", diff: str = "diff", sha_before: str | None = None, sha: str = "sha256") -> DataFrame:
    """`changes` with state, text and changed_lines: each file as it is after each of its changes.

    op `delete` removes the file; a null diff is a change that was not read. (by, order) is unique, without nulls in `by`. state: `deleted`;
    `verified`, the text's hash is the recorded one; `unverified`, it is another; `unknown`, the diffs do not tell the text (unread, unfit, or
    after a text that is not verified). text is null for a deleted file and an unknown one. A diff from /dev/null begins anew."""
    by = list(by)
    of = Window.partitionBy(*by)
    numbered = changes.select(*by, order).withColumns({"_t": F.row_number().over(of.orderBy(order)) - 1})
    said = changes.select(*by, order, F.col(op).alias("op"), F.col(diff).alias("diff"), F.col(sha).alias("sha"), (F.col(sha_before) if sha_before else F.lit(None).cast("string")).alias("sha_before"))
    gone = F.col("op") == "delete"
    rows = numbered.join(said, [*by, order]).withColumn("d", read_diff(F.col("diff")))
    rows = written(rows.withColumns({"gone": gone, "fresh": ~gone & F.col("diff").startswith("--- /dev/null")}).drop("diff"))
    # The edit of all changes up to each, as far as the last that begins anew or removes the file.
    upto = rows.select(*by, "_t", F.when(~F.col("gone"), F.col("d.edit")).alias("edit"), (F.col("gone") | F.coalesce("fresh", F.lit(False)) | F.col("d.edit").isNull()).alias("ends"))
    most, step = rows.agg(F.max("_t")).first()[0] or 0, 1
    while step <= most:
        before = upto.select(*by, (F.col("_t") + step).alias("_t"), F.col("edit").alias("edit0"), F.col("ends").alias("ends0"))
        open_ = upto.where("not ends").join(before, [*by, "_t"], "left")
        moved = open_.select(*by, "_t", F.when(F.col("ends0").isNull(), F.col("edit")).otherwise(compose(F.col("edit0"), F.col("edit"))).alias("edit"), F.coalesce("ends0", F.lit(False)).alias("ends"))
        upto = written(moved.unionByName(upto.where("ends")))
        step *= 2
    texts = upto.select(*by, "_t", _text(F.col("edit")).alias("lines"))
    prior = texts.select(*by, (F.col("_t") + 1).alias("_t"), F.col("lines").alias("before"))
    at = rows.join(texts, [*by, "_t"]).join(prior, [*by, "_t"], "left")
    body = F.array_join("lines", "\n")
    forms = F.array(F.concat(body, F.lit("\n")), body)
    text = F.coalesce(F.get(F.filter(forms, lambda x: F.sha2(x, 256) == F.col("sha")), F.lit(0)), F.when(F.size("lines") > 0, body).otherwise(""))
    fits = F.forall("d.old", lambda o: F.slice("before", (o["at"] + 1).cast("int"), F.size(o["lines"])) == o["lines"])
    earlier = F.array_join("before", "\n")
    same_before = F.col("sha_before").isNull() | F.col("sha_before").isin(F.sha2(earlier, 256), F.sha2(F.concat(earlier, F.lit("\n")), 256))
    at = at.withColumn("text", F.when(~F.col("gone") & F.col("lines").isNotNull(), text))
    at = at.withColumn("holds", F.coalesce(F.sha2("text", 256) == F.col("sha"), F.lit(False))).withColumn("fits", F.coalesce("fresh", F.lit(False)) | F.coalesce(fits & same_before, F.lit(False)))
    at = written(at.select(*by, order, "_t", "gone", F.coalesce("fresh", F.lit(False)).alias("fresh"), "text", "holds", "fits", F.col("d.changed").alias("changed_lines")))
    # Known before: since the last change that began anew, each one fitted and had its recorded hash.
    past = of.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("_t"))).over(past), F.lit(-1))
    good = F.col("holds") & F.col("fits")
    known = at.select(*by, "_t", (last(F.col("fresh") & good) > last(F.col("gone") | ~good)).alias("known"))
    at = at.join(known, [*by, "_t"])
    told = F.col("text").isNotNull() & F.col("fits") & (F.col("fresh") | F.col("known"))
    state = F.when(F.col("gone"), "deleted").when(told & F.col("holds"), "verified").when(told, "unverified").otherwise("unknown")
    out = at.select(*by, order, state.alias("state"), F.when(told, F.col("text")).alias("text"), F.coalesce("changed_lines", F.array().cast("array<int>")).alias("changed_lines"))
    return changes.join(out, [*by, order])


def rebuilt(changes: DataFrame, by: Sequence[str], order: str, **names) -> DataFrame:
    """(by, state, text): each file after its last change."""
    after = file_after(changes, by, order, **names)
    last = after.groupBy(*by).agg(F.max(order).alias(order))
    return after.join(last, [*by, order]).select(*by, "state", "text")
