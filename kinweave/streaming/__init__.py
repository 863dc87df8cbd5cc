"""Interactions from a stream: an extension, as monthly tables are read whole otherwise."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.network import edges_of_counts, weighted
from kinweave.scratch import discard, materialize
from kinweave.sources import children, exists, remove


def windowed_activity(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their values by type in tumbling windows of event time; later rows than ``late`` are dropped.

    Works on a stream and on a table (where the watermark has no effect).
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def monthly_activity(events: DataFrame) -> DataFrame:
    """By calendar month, which is no fixed span: the month is a key beside the time."""
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("period"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


def merge_batches(stream: DataFrame, path: str, checkpoint: str, merge):
    """Additive upsert of a stream into a versioned table: each batch is merged with the version before it.

    ``merge`` takes (old or None, batch).  A batch that runs again rewrites its own version from the one before, so a
    restart adds nothing twice.  The whole table is written again: for tables of a fixed size; see ``add_up`` for others.
    """

    def each(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/v{number - 1}") if number else None
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


# --- sums by key, kept up by a stream

#: Hash buckets of a table of sums; a batch rewrites those that hold one of its keys.
BUCKETS = 64


def add_up(stream: DataFrame, path: str, checkpoint: str, keys: list[str], sums: list[str], buckets: int = BUCKETS):
    """Keep ``sums`` by ``keys`` up to date in a table of hash buckets: a writer to be started, read by ``added_up``.

    A batch is summed by key first.  Of the table only the buckets of its keys are read and written again, into folders
    of a new version; what is current is said by the version's manifest, written last (a line for each bucket).  Readers
    see whole versions only, and a version's files stay until two later ones are there.  The manifest also names the
    stream's last batch: a batch that comes again adds nothing, and one that was broken off is written anew.  Null keys
    are keys like others, null numbers count as 0.  One stream at a time may write to a table.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        old = _version(spark, path) or {"version": -1, "done": {}, "parts": {}}
        if old["done"].get(writer, -1) >= number:
            return
        version = old["version"] + 1
        total = [F.coalesce(F.sum(c), F.lit(0)).cast(batch.schema[c].dataType).alias(c) for c in sums]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        fresh = materialize(batch.groupBy(*keys).agg(*total).select(bucket, *keys, *sums), "batch")
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most ``buckets`` rows
        parts = dict(old["parts"])
        if touched:
            before = [parts[str(b)] for b in touched if str(b) in parts]
            both = fresh
            if before:
                stored = spark.read.schema(fresh.schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{p}" for p in before])
                both = stored.select(fresh.columns).unionByName(fresh)
            merged = both.groupBy("bucket", *keys).agg(*total).hint("rebalance", "bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
            parts |= {str(b): f"version={version}/bucket={b}" for b in touched}
        said = {"version": version, "done": old["done"] | {writer: number}, "parts": parts}
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/versions/{version}")
        discard(fresh)
        _forget(spark, path, version)

    return stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint)


def added_up(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a table of ``add_up``; an error if there is none or no row has come yet."""
    said = _version(spark, path)
    if not said or not said["parts"]:
        raise ValueError(f"no sums in {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/{p}" for p in said["parts"].values()]).drop("version", "bucket")


def _written(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, the newest first."""
    folder = f"{path}/versions"
    return [n for n in sorted(map(int, children(spark, folder)), reverse=True) if exists(spark, f"{folder}/{n}/_SUCCESS")]


def _version(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    found = _written(spark, path) if number is None else [number]
    return json.loads(spark.read.text(f"{path}/versions/{found[0]}").first()["value"]) if found else None


def _forget(spark: SparkSession, path: str, version: int) -> None:
    """Delete what only versions before the last two need, the manifests that name it first."""
    numbers = _written(spark, path)
    kept, gone = [n for n in numbers if n >= version - 1], [n for n in numbers if n < version - 1]
    needed = {p for n in kept for p in _version(spark, path, n)["parts"].values()}
    free = {p for n in gone for p in _version(spark, path, n)["parts"].values()} - needed
    for name in [f"versions/{n}" for n in gone] + [f"data/{p}" for p in sorted(free)]:
        remove(spark, f"{path}/{name}")


def stream_edges(messages: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, key: str | None = None, time: str | None = None, late: str = "1 hour"):
    """Messages of each pair of author and spreader, added up from a stream: a writer to be started, read by ``edges``.

    With ``key`` and ``time`` a message that is delivered again within ``late`` of event time counts once.
    """
    if key:
        messages = messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    single = messages.where(F.col("from_id").isNotNull()).select(F.col("from_id").alias("source"), F.col("forwarder_id").alias("target"), F.lit(1).cast("long").alias("shared_post"))
    return add_up(single, path, checkpoint, ["source", "target"], ["shared_post"], buckets)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges with absolute and relative weights of all messages that a stream has brought so far."""
    return edges_of_counts(added_up(spark, path))


def stream_interactions(edges: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Interactions of a stream merged by pair, counts adding up, without edges to oneself; read by ``interactions``."""
    return add_up(edges.where("source <> target"), path, checkpoint, ["source", "target"], ["total_post", "shared_post"], buckets)


def interactions(spark: SparkSession, path: str) -> DataFrame:
    return weighted(added_up(spark, path))
