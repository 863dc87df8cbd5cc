"""Queries of joined views: user graphs, topics of matched communities, families before and after, two-stage themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import clustering as cl
from kinweave.operators import communities as com
from kinweave.operators import published as pub
from kinweave.operators.ordering import numbered
from kinweave.plans.communities import IF, INSIDE, MATCH, PAIRS, by_balance, by_nation, inside, matches
from kinweave.plans.network import KEPT, MESSAGES, kept, messages
from kinweave.plans.themes import ROWS, observations
from kinweave.registry import query, table

GRAPH = f"""{KEPT}, {IF}, g AS (SELECT source, target, weighted_post AS weight FROM k WHERE shared_post >= 3),
sw AS (SELECT * FROM g ORDER BY weight DESC, source, target LIMIT 400),
x AS (SELECT source AS node, target AS other, weight FROM sw UNION ALL SELECT target, source, weight FROM sw)"""


def user_graph(spark, sf_dir):
    edges = kept(spark, sf_dir).where("shared_post >= 3").select("source", "target", F.col("weighted_post").alias("weight"))
    both = by_nation(spark, sf_dir).withColumn("side", F.lit("absolute")).unionByName(by_balance(spark, sf_dir).withColumn("side", F.lit("weighted")))
    return pub.user_graph(edges, both, max_edges=400)


@query("t12_user_graph_edges", f"WITH {GRAPH} SELECT source, target, weight FROM sw")
def graph_edges(spark, sf_dir):
    return user_graph(spark, sf_dir)["edges"]


@query("t12_user_graph_nodes", f"""WITH {GRAPH}, nd AS (SELECT node, count(*) AS degree, round(sum(weight), 9) AS weight FROM x GROUP BY 1),
w AS (SELECT c_custkey AS node, CASE WHEN c_acctbal < 0 THEN c_nationkey + 25 ELSE c_nationkey END AS community_number FROM customer)
SELECT node, degree, weight, CASE WHEN mi.community_number IS NULL THEN [] ELSE [mi.community_number] END AS absolute, CASE WHEN w.community_number IS NULL THEN [] ELSE [w.community_number] END AS weighted
FROM nd LEFT JOIN mi USING (node) LEFT JOIN w USING (node)""")
def graph_nodes(spark, sf_dir):
    return user_graph(spark, sf_dir)["nodes"]


@query("t12_user_graph_coverage", f"WITH {GRAPH} SELECT (SELECT count(*) FROM g) AS all_edges, (SELECT count(*) FROM sw) AS edges, (SELECT count(DISTINCT node) FROM x) AS nodes, (SELECT count(*) FROM (SELECT source FROM g UNION SELECT target FROM g)) AS all_nodes, (SELECT count(*) FROM g) > (SELECT count(*) FROM sw) AS truncated")
def graph_coverage(spark, sf_dir):
    return user_graph(spark, sf_dir)["coverage"]


@query("j09_topics_of_matches", f"WITH {MATCH}, t AS (SELECT DISTINCT a AS absolute, b AS weighted, 'topic ' || (a * 7 + b) % 15 AS topic FROM mt WHERE (a + b) % 3 > 0) SELECT a, b, jaccard, topic FROM mt JOIN t ON absolute = a AND weighted = b")
def topics_of_matches(spark, sf_dir):
    m = matches(spark, sf_dir)
    t = m.where((F.col("a") + F.col("b")) % 3 > 0).select("a", "b", F.concat(F.lit("topic "), (F.col("a") * 7 + F.col("b")) % 15).alias("topic"))
    return m.join(t, ["a", "b"]).select("a", "b", "jaccard", "topic")


@query("j10_interactions_with_sizes", f"WITH {PAIRS}, sz AS (SELECT community_number, count(*) AS size FROM mi GROUP BY 1) SELECT source_community, target_community, user_pairs, size FROM ci LEFT JOIN sz ON community_number = source_community")
def interactions_with_sizes(spark, sf_dir):
    sizes = by_nation(spark, sf_dir).groupBy(F.col("community_number").alias("source_community")).agg(F.count(F.lit(1)).alias("size"))
    found = com.community_interactions(kept(spark, sf_dir), by_nation(spark, sf_dir))
    return found.join(sizes, "source_community", "left").select("source_community", "target_community", "user_pairs", "size")


@query("j11_summary_with_layout", f"""WITH {INSIDE}, su AS (SELECT community_number, count(*) AS edge_count FROM ce GROUP BY 1), p AS (SELECT community_number, row_number() OVER (ORDER BY community_number) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT community_number FROM mi WHERE community_number % 4 > 0))
SELECT community_number, edge_count, round(cos(2 * pi() * i / n), 6) + 0.0 AS x, round(sin(2 * pi() * i / n), 6) + 0.0 AS y FROM su LEFT JOIN p USING (community_number)""")
def summary_with_layout(spark, sf_dir):
    """Communities without coordinates keep their row."""
    place = numbered(by_nation(spark, sf_dir).where("community_number % 4 > 0").select("community_number").distinct(), "community_number", name="i")
    angle = 2 * F.pi() * F.col("i") / F.col("n")
    layout = place.crossJoin(F.broadcast(place.agg(F.count(F.lit(1)).alias("n")))).select("community_number", (F.round(F.cos(angle), 6) + 0.0).alias("x"), (F.round(F.sin(angle), 6) + 0.0).alias("y"))
    return com.summary(inside(spark, sf_dir)).join(layout, "community_number", "left").select("community_number", "edge_count", "x", "y")


@query("j16_representatives_with_diagnostics", "SELECT label, min(vec_id) AS representative, count(*) AS n, count(*) FILTER (vec_id % 10 = 0) AS tenths FROM embeddings GROUP BY 1")
def representatives_with_diagnostics(spark, sf_dir):
    """One to one: a side with a label twice is an error."""
    e = table(spark, sf_dir, "embeddings")
    chosen = e.groupBy("label").agg(F.min("vec_id").alias("representative"))
    diagnostics = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 10 == 0).alias("tenths"))
    return pub.one_to_one(chosen, diagnostics, "label")


@query("u06_creators_then_spreaders", f"""WITH {MESSAGES}, u AS (SELECT DISTINCT 0 AS side, from_id AS user_id FROM n UNION SELECT DISTINCT 1, forwarder_id FROM n), f AS (SELECT user_id, min(side) AS side FROM u GROUP BY 1)
SELECT user_id, row_number() OVER (ORDER BY side, user_id) - 1 AS position FROM f""")
def creators_then_spreaders(spark, sf_dir):
    """Each user once, creators first: the order is a column, as tables have none."""
    m = messages(spark, sf_dir)
    users = m.select(F.col("from_id").alias("user_id"), F.lit(0).alias("side")).unionByName(m.select(F.col("forwarder_id").alias("user_id"), F.lit(1).alias("side")))
    first = users.groupBy("user_id").agg(F.min("side").alias("side"))
    return numbered(first, "side", "user_id", name="position").select("user_id", "position")


@query("a38_stage_b_impact", f"""WITH {ROWS}, b AS (SELECT label AS family, count(*) AS n FROM ob GROUP BY 1), a AS (SELECT left(label, 1) AS family, count(*) AS n FROM ob GROUP BY 1)
SELECT (SELECT count(*) FROM b) AS families_before, (SELECT count(*) FROM a) AS families_after, round((SELECT max(n)::DOUBLE / sum(n) FROM b), 6) AS share_before, round((SELECT max(n)::DOUBLE / sum(n) FROM a), 6) AS share_after,
(SELECT count(*) FROM (SELECT left(label, 1) AS f FROM ob GROUP BY 1 HAVING count(DISTINCT label) > 1)) AS merged""")
def stage_b_impact(spark, sf_dir):
    """Families before and after labels of one initial are made one."""
    o = observations(spark, sf_dir).select(F.col("label").alias("before"), F.left("label", F.lit(1)).alias("after"))
    return pub.family_impact(o, "before", "after")


@query("a41_stage_metrics", f"WITH {KEPT}, {ROWS} SELECT 'network' AS stage, 'edges' AS metric, count(*) AS value FROM k UNION ALL SELECT 'network', 'nodes', count(*) FROM (SELECT source FROM k UNION SELECT target FROM k) UNION ALL SELECT 'themes', 'observations', count(*) FROM ob UNION ALL SELECT 'themes', 'labels', count(DISTINCT label) FROM ob UNION ALL SELECT 'themes', 'periods', count(DISTINCT period) FROM ob")
def stage_metrics(spark, sf_dir):
    k, o = kept(spark, sf_dir), observations(spark, sf_dir)
    network = k.select(F.explode(F.array("source", "target")).alias("node")).agg((F.count(F.lit(1)) / 2).cast("bigint").alias("edges"), F.count_distinct("node").alias("nodes"))
    themes = o.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("label").alias("labels"), F.count_distinct("period").alias("periods"))
    long = lambda df, stage: df.unpivot([], df.columns, "metric", "value").withColumn("stage", F.lit(stage))
    return long(network, "network").unionByName(long(themes, "themes")).select("stage", "metric", "value")


@query("a37_variant_shares", f"""WITH {ROWS}, v AS (SELECT 'labels' AS variant, label AS family FROM ob UNION ALL SELECT 'initials', left(label, 1) FROM ob), f AS (SELECT variant, family, count(*) AS n FROM v GROUP BY 1, 2)
SELECT variant, count(*) AS families, sum(n)::BIGINT AS observations, max(n) AS largest, round(max(n)::DOUBLE / sum(n), 6) AS largest_share, count(*) FILTER (n = 1) AS singletons FROM f GROUP BY 1""")
def variant_shares(spark, sf_dir):
    """Family sizes and shares of two variants of a grouping."""
    o = observations(spark, sf_dir)
    v = o.select(F.lit("labels").alias("variant"), F.col("label").alias("family")).unionByName(o.select(F.lit("initials").alias("variant"), F.left("label", F.lit(1)).alias("family")))
    f = v.groupBy("variant", "family").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy("variant").agg(
        F.count(F.lit(1)).alias("families"), F.sum("n").alias("observations"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.count_if(F.col("n") == 1).alias("singletons")
    )


def _topic_words(spark, sf_dir, side: str):
    """Keywords of each community on one side: words of its customers' segments and comments by how often they occur."""
    members = by_nation(spark, sf_dir) if side == "a" else by_balance(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.split(F.concat_ws(" ", "c_mktsegment", "c_name"), "[ #0]+")).alias("word"))
    return c.join(members, "node").groupBy(F.col("community_number").alias(side), "word").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("v07_knee_cutoff")
def knee_cutoff(spark, sf_dir):
    """Keywords of each community up to the knee of their weights."""
    return cl.keep_to_knee(_topic_words(spark, sf_dir, "a"), "a", "word", "weight")


@query("m14_matched_topics")
def matched_topics(spark, sf_dir):
    """For each matched pair of communities the keywords of both sides, each up to its knee."""
    return pub.matched_topics(matches(spark, sf_dir), _topic_words(spark, sf_dir, "a"), _topic_words(spark, sf_dir, "b"))


@query("m09_two_stage_themes")
def two_stage(spark, sf_dir):
    """Clusters of each period, their representatives, families of those over all periods, and each family's summary."""
    e = table(spark, sf_dir, "embeddings").withColumn("period", F.col("vec_id") % 8)
    return pub.two_stage(e, "period", "vec_id", "embedding")
