"""Joins that Spark has no single operator for: as-of, interval, prefix, mention, cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """Each row of `left` with `take` of the nearest row of `right` in time, nulls if there is none.

    Backward: the last row at or before `on` (before, if strict); forward: the first at or after. Both sides
    go once through one sort on (by, on), so the work does not depend on how many rows lie in between."""
    both = left.withColumn("_of", F.struct(*left.columns)).select(*by, on, "_of", F.lit(None).alias("_is")).unionByName(
        right.select(*by, on, F.struct(*take).alias("_is")), allowMissingColumns=True)
    # On a tie the right row must come first for an inclusive match, last for a strict one.
    from_right = F.col("_of").isNull()
    tie = from_right.asc() if strict else from_right.desc()
    order = [F.col(on).desc() if forward else F.col(on).asc(), tie]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("_is", F.last("_is", ignorenulls=True).over(w)).where(F.col("_of").isNotNull())
    return rows.select("_of.*", *[F.col(f"_is.{c}").alias(c) for c in take])


def interval(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, width: int, closed_start: bool = True) -> DataFrame:
    """Points (`at`, a number) with the spans (`start`, `end`) that hold them, per `by`.

    Spans are laid on cells of `width`, so that the join is on equal (by, cell): a long stream of points is
    spread over its cells and meets only the spans that touch them. An open end is null; open spans lie on no cells, as they hold every later
    point of their `by`. Spans that end before they start hold none."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    begins = F.col(at) >= F.col(start) if closed_start else F.col(at) > F.col(start)
    laid = spans.where(F.col(end) >= F.col(start)).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    closed = points.withColumn("_cell", cell(at)).join(laid, [*by, "_cell"]).where(begins & (F.col(at) <= F.col(end))).drop("_cell")
    return closed.unionByName(points.join(spans.where(F.col(end).isNull()), list(by)).where(begins))


def in_one_span(points: DataFrame, spans: DataFrame, by: Sequence[str], key: Sequence[str], at: str, start: str, end: str, width: int, name: str) -> DataFrame:
    """(key, name) of the points that exactly one span holds."""
    met = interval(points, spans, by, at, start, end, width)
    return met.groupBy(*key).agg(F.count("*").alias("_n"), F.first(name).alias(name)).where("_n = 1").drop("_n")


def ancestors(path: Column, itself: bool = False) -> Column:
    """The directories above a path, nearest first, without the root; with the path itself in front if asked."""
    parts = F.split(path, "/")
    n = F.size(parts)
    up = F.transform(F.sequence(n if itself else n - 1, F.lit(2), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(n > (1 if itself else 2), up).otherwise(F.array().cast("array<string>"))


def under(rows: DataFrame, roots: DataFrame, by: Sequence[str] = (), path: str = "path", root: str = "root", how: str = "left_semi") -> DataFrame:
    """Rows whose path is a root or lies under one (left_anti: the others): an equal join on ancestors."""
    keyed = rows.withColumn("_id", F.struct(*by, path)).select("_id", *by, F.explode(ancestors(F.col(path), itself=True)).alias(root))
    hit = keyed.join(roots.select(*by, root).distinct(), [*by, root]).select("_id").distinct()
    return rows.join(hit, F.struct(*[F.col(c) for c in [*by, path]]) == hit["_id"], how)


def nearest_ancestor(rows: DataFrame, carriers: DataFrame, by: Sequence[str], take: Sequence[str], path: str = "path") -> DataFrame:
    """(by, path, take) of the carrier on the nearest directory above each path."""
    up = rows.select(*by, path, F.posexplode(ancestors(F.col(path))).alias("_depth", "_dir")).distinct()
    met = up.join(carriers.select(*by, F.col(path).alias("_dir"), *take), [*by, "_dir"])
    best = F.min(F.struct("_depth", *take)).alias("_b")
    return met.groupBy(*by, path).agg(best).select(*by, path, *[F.col(f"_b.{c}").alias(c) for c in take])


def quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def mentions(texts: DataFrame, needles: DataFrame, key: str, text: str, name: str, needle: str) -> DataFrame:
    """(key, name): the needles that stand in a text, not touched by a letter, digit or underscore.

    A needle meets texts by its longest word, an equal join; the whole needle is then looked for. Needles
    without a word are left out."""
    word = r"[A-Za-z0-9_]+"
    tokens = F.regexp_extract_all(F.col(needle), F.lit(word), F.lit(0))
    best = F.array_max(F.transform(tokens, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))
    sought = needles.select(name, needle, best["w"].alias("_w")).where("_w is not null")
    seen = texts.select(key, text, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0)))).alias("_w"))
    # Only words that some needle is met by carry their text on.
    met = seen.join(sought, "_w")
    whole = F.rlike(F.col(text), F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted(F.col(needle)), F.lit("(?![A-Za-z0-9_])")))
    return met.where(whole).select(key, name).distinct()


def full_outer(before: DataFrame, after: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, change): add, delete or modify of the entries of two maps; equal ones are left out."""
    a = before.select(*by, F.struct(value).alias("_a"))
    b = after.select(*by, F.struct(value).alias("_b"))
    rows = a.join(b, list(by), "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return rows.select(*by, F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").otherwise("modify").alias("change"))


def cascade(rows: DataFrame, rules: Sequence[tuple[str, DataFrame]], key: Sequence[str], value: str) -> DataFrame:
    """`rows` with `value` and `mapped_by` from the first of the rules (name, (key, value)) that has them."""
    for i, (_, found) in enumerate(rules):
        rows = rows.join(found.select(*key, F.col(value).alias(f"_v{i}")), list(key), "left")
    n = range(len(rules))
    rows = rows.withColumn("mapped_by", F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(rules[i][0])) for i in n]))
    return rows.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in n])).drop(*[f"_v{i}" for i in n])


def view_lookup(top: DataFrame, hidden: DataFrame, base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries of a layered view: all of `top`, and those of `base` neither replaced nor under a hidden root."""
    key = [*by, "path"]
    return top.unionByName(under(base.join(top.select(*key), key, "left_anti"), hidden, by, how="left_anti"))


def copy_rows(tables: dict[str, DataFrame], trial_id: str) -> dict[str, DataFrame]:
    """One trial's rows of each table, for another store."""
    return {name: df.where(F.col("trial_id") == trial_id) for name, df in tables.items()}
