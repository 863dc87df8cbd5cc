"""Tables that streams keep up: restarts, repeated deliveries, untouched buckets."""

import json
import os

import pytest
from kinweave import streaming
from kinweave.operators import network as net
from pyspark.sql import functions as F


def taken(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_edges_of_a_stream_are_those_of_the_whole(spark, tmp_path):
    schema, inbox, out = "from_id string, forwarder_id string", str(tmp_path / "in"), str(tmp_path / "out")
    deliveries = [[("u1", "u2"), ("u1", "u2"), ("u1", "u1"), ("u1", None)], [(None, "u2"), ("u2", "u3")], [("u1", "u2"), ("u2", None), ("u3", "u1")]]
    for rows in deliveries:
        arrive(spark, inbox, rows, schema)
        stream = spark.readStream.schema(schema).parquet(inbox)
        taken(streaming.stream_edges(stream, out, f"{out}/state", buckets=4))
        every = sum(deliveries[: deliveries.index(rows) + 1], [])
        want = sorted(map(tuple, net.edge_metrics(spark.createDataFrame(every, schema)).collect()))
        assert sorted(map(tuple, streaming.edges(spark, out).collect())) == want
    taken(streaming.stream_edges(stream, out, f"{out}/state", buckets=4))  # nothing new
    assert sorted(map(tuple, streaming.edges(spark, out).collect())) == want


def test_a_batch_that_comes_again_adds_nothing_and_a_broken_one_is_written_anew(spark, tmp_path):
    schema, inbox, out = "k int, v long", str(tmp_path / "in"), str(tmp_path / "out")
    start = lambda: taken(streaming.add_up(spark.readStream.schema(schema).parquet(inbox), out, f"{out}/state", ["k"], ["v"], 4))
    rows = lambda: sorted(map(tuple, streaming.added_up(spark, out).collect()), key=str)
    arrive(spark, inbox, [(1, 2), (1, 3), (None, 4), (None, None), (2, None)], schema)
    start()
    assert rows() == [(1, 5), (2, 0), (None, 4)]
    commit = tmp_path / "out/state/commits/0"
    for f in (commit, commit.with_name(".0.crc")):  # the stream takes batch 0 for one that wasn't ended
        f.unlink(missing_ok=True)
    start()
    assert rows() == [(1, 5), (2, 0), (None, 4)]
    arrive(spark, inbox, [(1, 10)], schema)
    os.makedirs(tmp_path / "out/data/version=1/bucket=0")  # what a broken version left
    spark.createDataFrame([(9, 9)], schema).write.mode("append").parquet(str(tmp_path / "out/data/version=1/bucket=0"))
    start()
    assert rows() == [(1, 15), (2, 0), (None, 4)]


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    schema, inbox, out = "k int, v long", str(tmp_path / "in"), str(tmp_path / "out")
    start = lambda: taken(streaming.add_up(spark.readStream.schema(schema).parquet(inbox), out, f"{out}/state", ["k"], ["v"], 8))
    arrive(spark, inbox, [(k, 1) for k in range(40)], schema)
    start()
    assert len(os.listdir(tmp_path / "out/data/version=0")) - 2 == 8  # with two files of the writer's
    for _ in range(3):
        arrive(spark, inbox, [(7, 1)], schema)
        start()
    version = json.loads(spark.read.text(f"{out}/versions/3").first()["value"])
    assert sum(p.startswith("version=3/") for p in version["parts"].values()) == 1 and len(version["parts"]) == 8
    assert sorted(n for n in os.listdir(tmp_path / "out/versions")) == ["2", "3"]
    assert not any(n.startswith("bucket") for n in os.listdir(tmp_path / "out/data/version=1"))
    assert sum(n.startswith("bucket") for n in os.listdir(tmp_path / "out/data/version=0")) == 7
    assert sorted(map(tuple, streaming.added_up(spark, out).collect())) == [(k, 4 if k == 7 else 1) for k in range(40)]


def test_two_streams_into_one_table_one_after_the_other(spark, tmp_path):
    schema, out = "k int, v long", str(tmp_path / "out")
    for name in ("a", "b"):  # both begin with batch 0
        arrive(spark, str(tmp_path / name), [(1, 2)], schema)
        taken(streaming.add_up(spark.readStream.schema(schema).parquet(str(tmp_path / name)), out, str(tmp_path / f"state_{name}"), ["k"], ["v"]))
    assert [tuple(r) for r in streaming.added_up(spark, out).collect()] == [(1, 4)]


def test_a_message_delivered_again_counts_once(spark, tmp_path):
    schema, inbox, out = "id int, from_id string, forwarder_id string, ts timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.sql("SELECT 1 AS id, 'a' AS from_id, 'b' AS forwarder_id, timestamp'2024-01-01 00:00:00' AS ts").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        taken(streaming.stream_edges(stream, out, f"{out}/state", key="id", time="ts", late="10 minutes"))
    assert [tuple(r) for r in streaming.edges(spark, out).collect()] == [("a", "b", 1, 1, 1.0)]


def test_interactions_add_up_without_edges_to_oneself(spark, tmp_path):
    schema, inbox, out = "source string, target string, total_post long, shared_post long", str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "b", 4, 1), ("a", "a", 4, 4)], [("a", "b", 4, 3), ("c", "d", 0, 0)]):
        arrive(spark, inbox, rows, schema)
        taken(streaming.stream_interactions(spark.readStream.schema(schema).parquet(inbox), out, f"{out}/state"))
    assert sorted(map(tuple, streaming.interactions(spark, out).collect())) == [("a", "b", 8, 4, 0.5), ("c", "d", 0, 0, 0.0)]


def test_no_table_and_an_empty_stream(spark, tmp_path):
    with pytest.raises(ValueError, match="no sums"):
        streaming.added_up(spark, str(tmp_path / "none"))
    spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    taken(streaming.add_up(spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), ["k"], ["v"]))
    with pytest.raises(ValueError, match="no sums"):
        streaming.added_up(spark, str(tmp_path / "out"))
