"""Read-side tables: overviews, evidence, comparisons and bounded views of published runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import clustering as cl
from kinweave.operators import vectors as vec
from kinweave.sources import pages


def cross_similarity(steps: DataFrame, similarity: DataFrame) -> DataFrame:
    """Theme similarity of each pair of steps of a path, upper triangle with the diagonal; null where one is missing.

    ``similarity`` has a, b and score of labels; ``steps`` path_id, step_index and label.
    """
    left = steps.select("path_id", F.col("step_index").alias("i"), F.col("label").alias("a"))
    right = steps.select("path_id", F.col("step_index").alias("j"), F.col("label").alias("b"))
    pairs = left.join(right, "path_id").where("i <= j")
    scored = pairs.join(similarity, ["a", "b"], "left")
    return scored.select("path_id", "i", "j", F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("score")).alias("similarity"))


def full_matrix(upper: DataFrame, keys: list[str]) -> DataFrame:
    """A symmetric matrix as rows of arrays, from its upper triangle (i, j, similarity)."""
    both = upper.select(*keys, "i", "j", "similarity").unionByName(upper.where("i < j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))
    return both.groupBy(*keys, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col("similarity").alias("s")))), lambda x: x["s"]).alias("row"))


def balanced_selection(edges: DataFrame, membership: DataFrame, quotas: DataFrame, max_edges: int) -> DataFrame:
    """The heaviest edges between nodes chosen by community quota: by degree, weight and id inside each community."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "weight")
    strength = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("w"))
    ranked = membership.join(strength, "node", "left").fillna(0, ["degree"]).fillna(0.0, ["w"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("community_number").orderBy(F.desc("degree"), F.desc("w"), "node"))
    )
    chosen = ranked.join(quotas.select("community_number", "quota"), "community_number").where("place <= quota").select("node")
    inside = edges.join(chosen.toDF("source"), "source", "left_semi").join(chosen.toDF("target"), "target", "left_semi")
    return inside.select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target").limit(max_edges)


def overview(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: edges, weight, and matched communities in percent of the larger partition, rounded to two digits."""
    m = matches.agg(F.count_if(F.col("jaccard") == 1).alias("matched"), F.count_distinct("a").alias("absolute"), F.count_distinct("b").alias("weighted"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("shared_post").alias("interactions"))
    return m.crossJoin(e).withColumn("matched_percent", F.round(F.col("matched") / F.nullif(F.greatest("absolute", "weighted"), F.lit(0)) * 100, 2))


def continuity_paths(paths: DataFrame, retained: DataFrame) -> DataFrame:
    """Each path's months, retained total and whether sizes at its joints disagree."""
    joints = paths.select("path", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("i", "p"))
    linked = joints.join(retained, (F.col("p.a") == retained["source_node"]) & (F.col("p.b") == retained["target_node"]))
    following = F.lead("source_size").over(Window.partitionBy("path").orderBy("i"))
    checked = linked.withColumn("odd", F.coalesce(F.col("target_size") != following, F.lit(False)))
    return checked.groupBy("path").agg((F.count(F.lit(1)) + 1).alias("months"), F.sum("retained").alias("retained_total"), F.max("odd").alias("inconsistent"))


def user_graph(edges: DataFrame, membership: DataFrame, least: float = 0.0, max_edges: int | None = None) -> dict[str, DataFrame]:
    """A bounded view of a network: its edges, its nodes with their communities of either side, and what it covers.

    ``edges`` has source, target and weight; ``membership`` node, community_number and side (absolute or weighted).
    Edges below ``least`` are left out; of the others the ``max_edges`` heaviest are shown, all if it is None.  Nodes
    have their degree and weight in the view, and sorted lists of communities, empty where they are in none.
    """
    kept = edges.where(F.col("weight") >= least)
    shown = kept if max_edges is None else kept.orderBy(F.desc("weight"), "source", "target").limit(max_edges)
    ends = lambda df: df.select(F.explode(F.array("source", "target")).alias("node"), "weight")
    degrees = ends(shown).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 9).alias("weight"))
    lists = membership.join(degrees.select("node"), "node", "left_semi").groupBy("node").agg(
        *(F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("community_number")))).alias(side) for side in ("absolute", "weighted"))
    )
    empty = F.array().cast(lists.schema["absolute"].dataType)
    nodes = degrees.join(lists, "node", "left").withColumns({side: F.coalesce(side, empty) for side in ("absolute", "weighted")})
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    coverage = count(kept, "all_edges").crossJoin(count(shown, "edges")).crossJoin(count(degrees, "nodes")).crossJoin(count(ends(kept).select("node").distinct(), "all_nodes"))
    return {"edges": shown.select("source", "target", "weight"), "nodes": nodes, "coverage": coverage.withColumn("truncated", F.col("all_edges") > F.col("edges"))}


def evidence_page(rows: DataFrame, period: str, theme: str, order: list, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the observations (period, theme and others) of one theme in one period, with the ``total`` of them.

    An error if the theme is blank or the period has no observation of any theme; a theme that is not there gives no rows.
    """
    if not (theme or "").strip():
        raise ValueError("a theme is required")
    of_period = rows.where(F.col("period") == period)
    if of_period.isEmpty():
        raise ValueError(f"no evidence for the period {period}")
    return pages([of_period.where(F.col("theme") == theme.strip())], order, offset, limit).drop("table_number")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on a key that may be in no side twice; a row that repeats it is an error when the result is read."""
    def once(df: DataFrame) -> DataFrame:
        at = F.count(F.lit(1)).over(Window.partitionBy(key))
        return df.withColumn(key, F.when(at > 1, F.raise_error(F.concat(F.lit("a key is there twice: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key)))

    return once(left).join(once(right), key, "left")


def family_impact(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: families and the largest one's share before and after, and families that were made of several."""
    share = lambda c, name: rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias(f"families_{name}"), F.round(F.max("n") / F.sum("n"), 6).alias(f"share_{name}"))
    merged = rows.groupBy(after).agg(F.count_distinct(before).alias("n")).agg(F.count_if(F.col("n") > 1).alias("merged"))
    return share(before, "before").crossJoin(share(after, "after")).crossJoin(merged).select("families_before", "families_after", "share_before", "share_after", "merged")


def matched_topics(matches: DataFrame, absolute: DataFrame, weighted: DataFrame) -> DataFrame:
    """a, b, side, word and weight: the keywords of both communities of each matched pair, each side up to its knee.

    ``absolute`` and ``weighted`` have the side's community (a or b), word and weight.  A pair of which a side has no
    keywords keeps those of the other.
    """
    def side(words: DataFrame, key: str) -> DataFrame:
        return matches.select("a", "b").join(cl.keep_to_knee(words, key, "word", "weight"), key).select("a", "b", F.lit(key).alias("side"), "word", "weight")

    return side(absolute, "a").unionByName(side(weighted, "b"))


def two_stage(rows: DataFrame, period: str, key: str, vector: str, cut: float = 0.35) -> DataFrame:
    """family, periods, clusters, observations and share: density clusters of each period, then linked over all periods.

    Noise is in no cluster.  A cluster stands for its members by its mean unit vector; clusters of all periods are
    linked into families.  Shares are of all clustered observations.
    """
    clustered = cl.density_clusters(rows, period, key, vector).where("cluster >= 0")
    named = clustered.withColumn("cluster_id", F.concat_ws("_", period, "cluster"))
    centres = vec.centroids(rows.join(named.select(key, "cluster_id"), key), "cluster_id", vector)
    families = cl.linked_families(centres.withColumn("all", F.lit(0)), "all", "cluster_id", "centroid", cut).select("cluster_id", "family")
    joined = named.join(families, "cluster_id").groupBy("family").agg(F.sort_array(F.collect_set(period)).alias("periods"), F.count_distinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("observations"))
    total = joined.agg(F.sum("observations").alias("total"))  # one row
    return joined.crossJoin(F.broadcast(total)).select("family", "periods", "clusters", "observations", F.round(F.col("observations") / F.col("total"), 6).alias("share"))
