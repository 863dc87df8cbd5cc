"""Communities given as a membership table (node, community_number) and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.ordering import numbered


def prominent(membership: DataFrame, min_members: int = 3) -> DataFrame:
    """Communities with enough nodes, numbered anew from 0 in their old order."""
    sizes = membership.groupBy("community_number").agg(F.count_distinct("node").alias("size")).where(F.col("size") >= min_members)
    anew = numbered(sizes, "community_number", name="renumbered")
    return membership.join(anew.select("community_number", "renumbered"), "community_number").select("node", F.col("renumbered").alias("community_number"))


def community_edges(edges: DataFrame, membership: DataFrame, metric: str) -> DataFrame:
    """Edges inside a community: source, target, community_number, direction, weight."""
    a = membership.select(F.col("node").alias("source"), F.col("community_number").alias("sc"))
    b = membership.select(F.col("node").alias("target"), F.col("community_number").alias("tc"))
    joined = edges.join(a, "source").join(b, "target").where("sc = tc")
    return joined.select("source", "target", F.col("sc").alias("community_number"), F.lit("Directed").alias("direction"), F.col(metric).cast("double").alias("weight"))


def community_interactions(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """For each ordered pair of different communities: user pairs, sources, targets, weight and rounded count.

    Counts are rounded half to even, as sums of counts may come as doubles.
    """
    a = membership.select(F.col("node").alias("source"), F.col("community_number").alias("source_community"))
    b = membership.select(F.col("node").alias("target"), F.col("community_number").alias("target_community"))
    joined = edges.join(a, "source").join(b, "target").where("source_community <> target_community")
    return joined.groupBy("source_community", "target_community").agg(
        F.count_distinct("source", "target").alias("user_pairs"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"),
        F.sum("weighted_post").alias("weight"), F.rint(F.sum("shared_post").cast("double")).cast("bigint").alias("interactions"),
    )


def summary(community_edges: DataFrame) -> DataFrame:
    """edge_count, total_weight and node_count of each community, in one pass over its edges."""
    ends = community_edges.select("community_number", F.explode(F.array("source", "target")).alias("node"))
    nodes = ends.groupBy("community_number").agg(F.count_distinct("node").alias("node_count"))
    sums = community_edges.groupBy("community_number").agg(F.count(F.lit(1)).alias("edge_count"), F.sum("weight").alias("total_weight"))
    return sums.join(nodes, "community_number")


def members(community_edges: DataFrame) -> DataFrame:
    """Sorted distinct nodes of each community as an array: what a published member list holds."""
    ends = community_edges.select("community_number", F.explode(F.array("source", "target")).alias("node")).distinct()
    return ends.groupBy("community_number").agg(F.sort_array(F.collect_list("node")).alias("members"))


def messages_inside(community_edges: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages that run along a community's edges, with the community."""
    keys = community_edges.select("source", "target", "community_number")
    return messages.join(keys, (messages["from_id"] == keys["source"]) & (messages["forwarder_id"] == keys["target"])).drop("source", "target")


def documents(inside: DataFrame, order: str, text: str) -> DataFrame:
    """Each community's messages and their ids, in order, and their number."""
    return inside.groupBy("community_number").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("id"), F.col(text).alias("text")))).alias("x")).select(
        "community_number", F.col("x.text").alias("messages"), F.col("x.id").alias("message_ids"), F.size("x").alias("total_messages")
    )


def cross_statistics(interactions: DataFrame) -> DataFrame:
    """Weight into and out of each community and its different neighbours, from the table of community pairs."""
    both = interactions.select(F.explode(F.array(
        F.struct(F.col("source_community").alias("c"), F.col("target_community").alias("n"), F.lit(0.0).alias("i"), F.col("weight").alias("o")),
        F.struct(F.col("target_community").alias("c"), F.col("source_community").alias("n"), F.col("weight").alias("i"), F.lit(0.0).alias("o")),
    )).alias("x"))
    return both.groupBy(F.col("x.c").alias("community_number")).agg(F.sum("x.i").alias("inbound_weight"), F.sum("x.o").alias("outbound_weight"), F.count_distinct("x.n").alias("neighbours"))


def only_community(membership: DataFrame) -> DataFrame:
    """Each user's community if there is exactly one, else null."""
    return membership.groupBy("node").agg(F.when(F.count_distinct("community_number") == 1, F.min("community_number")).alias("community_number"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlaps of two partitions (node, community_number): shared, sizes and Jaccard similarity of each pair that shares
    a node.  An equi-join on nodes; pairs that share nothing never exist."""
    a = left.select("node", F.col("community_number").alias("a"))
    b = right.select("node", F.col("community_number").alias("b"))
    shared = a.join(b, "node").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    size_a = a.groupBy("a").agg(F.count(F.lit(1)).alias("size_a"))
    size_b = b.groupBy("b").agg(F.count(F.lit(1)).alias("size_b"))
    return shared.join(size_a, "a").join(size_b, "b").withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))


def unmatched(side: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    """Communities of one partition that share no node with the other."""
    return side.select(F.col("community_number").alias(column)).distinct().join(matches, column, "left_anti")


def seats(sizes: DataFrame, total: int, least: int = 2) -> DataFrame:
    """Places for each community: ``least`` each, the rest one by one to the largest sqrt(size) / (places + 1).

    The highest averages are ranked at once: a community's seat s has score sqrt(size) / s, and no community has more
    seats than nodes.  Ties go to the smaller number.  ``sizes`` has a row for each community.
    """
    base = sizes.select("community_number", "size", F.least(F.lit(least), F.col("size")).alias("base"))
    more = base.where("size > base").select("community_number", "size", F.explode(F.sequence(F.col("base") + 1, F.least(F.col("size"), F.lit(total)))).alias("seat"))
    taken = base.agg(F.sum("base").alias("taken"))
    ranked = more.withColumn("score", F.sqrt("size") / F.col("seat"))
    best = ranked.orderBy(F.desc("score"), "community_number", "seat").limit(total)
    placed = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "community_number", "seat")))
    given = placed.crossJoin(F.broadcast(taken)).where(F.col("rank") <= F.lit(total) - F.col("taken")).groupBy("community_number").agg(F.count(F.lit(1)).alias("extra"))
    return base.join(given, "community_number", "left").select("community_number", "size", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("quota"))
