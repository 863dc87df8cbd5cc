"""Queries whose rows come through a stream: tables are written as files, which streams take some at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave import streaming
from kinweave.operators import network as net
from kinweave.plans.bundles import place
from kinweave.plans.network import EDGES, KEPT, messages
from kinweave.registry import query


def arriving(df, by: str, batches: int = 4):
    """``df`` as a stream that brings it in about ``batches`` batches; files are those of the values of ``by``."""
    path = place(df.sparkSession, "arrivals")
    df.write.partitionBy(by).parquet(path)
    n = len(df.sparkSession.read.parquet(path).inputFiles())
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-n // batches))).parquet(path)


def taken(writer) -> None:
    """Run a stream until all that is there has been taken in."""
    writer.trigger(availableNow=True).start().awaitTermination()


@query("st_edge_metrics", f"WITH {EDGES} SELECT * FROM e")
def stream_edges(spark, sf_dir):
    """Edges of messages that arrive by year."""
    path, m = place(spark, "edges"), messages(spark, sf_dir).withColumn("year", F.year("created_at"))
    taken(streaming.stream_edges(arriving(m, "year"), path, f"{path}/state"))
    return streaming.edges(spark, path)


@query("st_upsert_interactions", f"""WITH {KEPT}, o AS (SELECT * FROM e WHERE source % 2 = 0 UNION ALL SELECT * FROM k),
g AS (SELECT source, target, sum(total_post)::BIGINT AS total_post, sum(shared_post)::BIGINT AS shared_post FROM o GROUP BY 1, 2)
SELECT *, CASE WHEN total_post = 0 THEN 0.0 ELSE shared_post::DOUBLE / total_post END AS weighted_post FROM g""")
def stream_upsert(spark, sf_dir):
    """Two deliveries of edges, merged as they come."""
    path, e = place(spark, "interactions"), net.edge_metrics(messages(spark, sf_dir)).drop("weighted_post")
    both = e.where("source % 2 = 0").withColumn("delivery", F.lit(1)).unionByName(net.threshold(e, 5, 2).withColumn("delivery", F.lit(2)))
    taken(streaming.stream_interactions(arriving(both, "delivery", 2), path, f"{path}/state"))
    return streaming.interactions(spark, path)
