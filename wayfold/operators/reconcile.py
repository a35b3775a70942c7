"""What changed between layered file system views, and which recorded writes explain it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import ancestors

#: Paths that no view keeps (fixed values).
EXCLUDED = r"^/(proc|sys|dev|run)(/|\z)|^/\.dockerenv\z"
TEXT_BYTES = 1024 * 1024


def _latest(layers: DataFrame, upto: DataFrame) -> DataFrame:
    """Entries of all layers at or below each view: (trial_id, seq, layer, path, ...)."""
    v = upto.select("trial_id", F.col("seq").alias("view"))
    return layers.join(v, "trial_id").where(F.col("seq") <= F.col("view"))


def fold(layers: DataFrame, views: DataFrame) -> DataFrame:
    """(trial_id, view, path, kind, mode, owner, sha256): what each view (trial_id, seq) shows.

    `layers` has a row for each entry of a layer: trial_id, seq, path, marker (null, whiteout or opaque), and
    its metadata. Of a path the highest layer counts; a whiteout hides the path and all below it in lower
    layers, an opaque directory all below it, and a path that is no directory hides what lay under it."""
    rows = _latest(layers, views)
    top = rows.where("marker is null or marker = 'whiteout'").groupBy("trial_id", "view", "path").agg(F.max(F.struct("seq", F.col("marker").isNull().alias("there"), "kind", "mode", "owner", "sha256")).alias("e"))
    shown = top.where("e.there").select("trial_id", "view", "path", "e.seq", "e.kind", "e.mode", "e.owner", "e.sha256")
    hiding = rows.where("marker is not null or kind <> 'dir'").groupBy("trial_id", "view", F.col("path").alias("root")).agg(F.max("seq").alias("hidden_below"))
    up = shown.select("trial_id", "view", "path", "seq", F.explode(ancestors(F.col("path"))).alias("root"))
    gone = up.join(hiding, ["trial_id", "view", "root"]).where(F.col("seq") < F.col("hidden_below")).select("trial_id", "view", "path").distinct()
    # An entry and a marker of one layer: the entry stays.
    return shown.drop("seq").join(gone, ["trial_id", "view", "path"], "left_anti").where(~F.col("path").rlike(EXCLUDED))


def changes(layers: DataFrame, views: DataFrame) -> DataFrame:
    """(trial_id, view, path, op, before, after): each view against the one before it, by kind, mode, owner and content.

    Only paths that a layer between touches, or that lie under one it hides, can differ; times never count."""
    facts = F.struct("kind", "mode", "owner", "sha256")
    order = views.select("trial_id", F.col("seq").alias("view")).withColumn("_prev", F.lag("view").over(Window.partitionBy("trial_id").orderBy("view")))
    now = fold(layers, views).select("trial_id", "view", "path", facts.alias("after"))
    later = order.where("_prev is not null").select("trial_id", F.col("view").alias("_next"), F.col("_prev").alias("view"))
    was = now.join(later, ["trial_id", "view"]).select("trial_id", F.col("_next").alias("view"), "path", F.col("after").alias("before"))
    now = now.join(order.where("_prev is not null").select("trial_id", "view"), ["trial_id", "view"], "left_semi")
    rows = was.join(now, ["trial_id", "view", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "delete").otherwise("modify")
    return rows.select("trial_id", "view", "path", op.alias("op"), "before", "after")


def is_text(content: str = "content"):
    """Text: at most 1 MiB, valid UTF-8 and without a zero byte."""
    c = F.col(content)
    return (F.length(c) <= TEXT_BYTES) & F.try_validate_utf8(c.cast("string")).isNotNull() & ~F.contains(c, F.lit(bytearray(b"\0")))


#: How events are mapped, the surest first (fixed values).
SUREST = ("command", "session", "tool_window", "start_time")


def write_rows(deltas: DataFrame, events: DataFrame) -> DataFrame:
    """(trial_id, step_idx, path, writer_step, mapped_by, events, ops, first_at, last_at, via_dir).

    deltas: trial_id, step_idx, path, op, since (exclusive; null: from the beginning), upto. events: trial_id, path, at, op, is_dir, writer_step,
    mapped_by. Events on the path within the interval; without any, those of the nearest directory above that
    carried the path along (moved in for an add or modify, deleted for a delete)."""
    key = ["trial_id", "step_idx", "path"]
    inside = F.coalesce(F.col("at") > F.col("since"), F.lit(True)) & (F.col("at") <= F.col("upto"))
    facts = ["at", "event_op", "writer_step", "mapped_by"]
    e = events.withColumnRenamed("op", "event_op")
    direct = deltas.join(e.select("trial_id", "path", *facts), ["trial_id", "path"]).where(inside).withColumn("via_dir", F.lit(None).cast("string"))
    alone = deltas.join(direct.select(*key).distinct(), key, "left_anti")
    moved = e.where("is_dir").select(F.col("trial_id").alias("_t"), F.col("path").alias("via_dir"), *facts)
    up = alone.withColumn("_up", F.explode(F.transform(ancestors(F.col("path")), lambda d, i: F.struct(i.alias("depth"), d.alias("dir")))))
    met = up.join(moved, (F.col("trial_id") == F.col("_t")) & (F.col("_up.dir") == F.col("via_dir")))
    met = met.where(inside & (F.col("event_op") == F.when(F.col("op") == "delete", "delete").otherwise("moved_to")))
    near = met.groupBy(*key).agg(F.min("_up.depth").alias("_least"))
    carried = met.join(near, key).where(F.col("_up.depth") == F.col("_least")).select(*direct.columns)
    rows = direct.unionByName(carried)
    return rows.groupBy(*key, "writer_step").agg(
        F.min_by("mapped_by", F.array_position(F.array(*map(F.lit, SUREST)), F.col("mapped_by"))).alias("mapped_by"), F.count("*").cast("int").alias("events"), F.sort_array(F.collect_set("event_op")).alias("ops"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("via_dir").alias("via_dir"))
