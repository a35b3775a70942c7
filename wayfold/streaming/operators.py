"""Structured Streaming forms of the capture's event loops. Each takes and returns a streaming DataFrame; most run
on a batch DataFrame as well, with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.lineage import shared_folder


def first_per_key(rows: DataFrame, key: list[str], at: str, horizon: str) -> DataFrame:
    """The first row of each key; repeats within the horizon are retries. In a stream the first to arrive, in a batch the first by `at`."""
    if rows.isStreaming:
        return rows.withWatermark(at, horizon).dropDuplicatesWithinWatermark(key)
    first = rows.groupBy(*key).agg(F.min_by(F.struct("*"), F.struct(at, F.xxhash64("*"))).alias("_first"))
    return first.select("_first.*")


def at_most_once_a(rows: DataFrame, key: list[str], at: str, window: str = "1 second", horizon: str = "10 seconds") -> DataFrame:
    """One row a key and tumbling window: (key, window start, rows dropped into it)."""
    rows = rows.withWatermark(at, horizon) if rows.isStreaming else rows
    w = F.window(at, window)
    return rows.groupBy(*key, w.alias("w")).agg(F.min(at).alias(at), F.count("*").alias("events")).select(*key, F.col("w.start").alias("start"), at, "events")


def hold_until_known(events: DataFrame, owners: DataFrame, key: str, at: str, hold: str = "15 seconds") -> DataFrame:
    """Events joined to the owner of their key that becomes known up to `hold` later; others are dropped.

    owners: (key, owner, known_at)."""
    if events.isStreaming:
        events, owners = events.withWatermark(at, hold), owners.withWatermark("known_at", hold)
    e, o = events.alias("e"), owners.alias("o")
    on = (F.col(f"e.{key}") == F.col(f"o.{key}")) & (F.col("o.known_at") <= F.col(f"e.{at}") + F.expr(f"interval {hold}")) & (F.col("o.known_at") >= F.col(f"e.{at}") - F.expr(f"interval {hold}"))
    return e.join(o, on).select("e.*", "o.owner")


def every_nth(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows with `due`: every n-th of a key, and every stop. State: how many calls since the last due one.

    rows: (key, order long, is_stop boolean), sorted by `order` within a trigger."""
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else 0
        frame = pd.concat(list(parts)).sort_values(order)
        due = []
        for stop in frame["is_stop"]:
            since += 1
            due.append(bool(stop) or since >= n)
            since = 0 if due[-1] else since
        state.update((since,))
        yield pd.DataFrame({key: frame[key], order: frame[order], "due": due})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} bigint, due boolean", "since long", "append", GroupStateTimeout.NoTimeout)


def change_gate(rows: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Rows whose digest differs from the one emitted before for the key. State: that digest."""
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(parts)).sort_values(order)
        keep = []
        for d in frame[digest]:
            keep.append(d != last)
            last = d
        state.update((last,))
        yield frame[keep][[key, order, digest]]

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} bigint, {digest} string", "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(rows: DataFrame, key: list[str], at: str, window: str, horizon: str, slide: str | None = None) -> DataFrame:
    """Events a key and window, late ones up to the horizon included."""
    rows = rows.withWatermark(at, horizon) if rows.isStreaming else rows
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return rows.groupBy(*key, w.alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("start"), "n")


def sessions(rows: DataFrame, key: list[str], at: str, gap: str, horizon: str) -> DataFrame:
    """Sessions of a key: runs of events less than `gap` apart."""
    rows = rows.withWatermark(at, horizon) if rows.isStreaming else rows
    return rows.groupBy(*key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def answer_each(requests: DataFrame, answer, out: str, checkpoint: str):
    """Start answering requests (query_id, sql): each once, by the checkpoint and by the answers already written.

    answer(sql) -> (text, error)."""
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        # A trigger's requests are a handful of files; each is one query of its own.
        for r in df.dropDuplicates(["query_id"]).orderBy("query_id").collect():
            text, error = answer(r.sql)
            spark.createDataFrame([(r.query_id, text, error)], "query_id string, text string, error string").coalesce(1).write.mode("overwrite").json(f"{out}/{r.query_id}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is now, as a DataFrame, by way of the shared checkpoint folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
        return spark.read.schema(schema).parquet(f"{at}/rows")

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/{batch_id:06d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/rows")
