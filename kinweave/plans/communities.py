"""Queries over communities: customers' nations are one partition, nation and sign of the balance another."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import communities as com
from kinweave.operators import network as net
from kinweave.operators.ordering import numbered
from kinweave.plans.network import KEPT, kept, messages
from kinweave.registry import query, table

IF = "mi AS (SELECT c_custkey AS node, c_nationkey AS community_number FROM customer)"
WIF = "mw AS (SELECT c_custkey AS node, CASE WHEN c_acctbal < 0 THEN c_nationkey + 25 ELSE c_nationkey END AS community_number FROM customer)"
BASE = f"{KEPT}, {IF}"
INSIDE = BASE + """, ce AS (SELECT source, target, a.community_number, 'Directed' AS direction, shared_post::DOUBLE AS weight
 FROM k JOIN mi a ON a.node = source JOIN mi b ON b.node = target WHERE a.community_number = b.community_number)"""
PAIRS = BASE + """, ci AS (SELECT a.community_number AS source_community, b.community_number AS target_community, count(DISTINCT (source, target)) AS user_pairs, count(DISTINCT source) AS sources,
 count(DISTINCT target) AS targets, sum(weighted_post) AS weight, sum(shared_post)::BIGINT AS interactions
 FROM k JOIN mi a ON a.node = source JOIN mi b ON b.node = target WHERE a.community_number <> b.community_number GROUP BY 1, 2)"""


def by_nation(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community_number"))


def by_balance(spark, sf_dir):
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, n + 25).otherwise(n).alias("community_number"))


def inside(spark, sf_dir):
    return com.community_edges(kept(spark, sf_dir), by_nation(spark, sf_dir), "shared_post")


@query("g03_community_edges", f"WITH {INSIDE} SELECT * FROM ce")
def community_edges(spark, sf_dir):
    return inside(spark, sf_dir)


@query("p04_prominent", f"""WITH {WIF}, z AS (SELECT community_number, row_number() OVER (ORDER BY community_number) - 1 AS r FROM (SELECT community_number FROM mw GROUP BY 1 HAVING count(DISTINCT node) >= 3))
SELECT node, r AS community_number FROM mw JOIN z USING (community_number)""")
def prominent(spark, sf_dir):
    return com.prominent(by_balance(spark, sf_dir))


@query("a03_community_interactions", f"WITH {PAIRS} SELECT * FROM ci")
def community_interactions(spark, sf_dir):
    return com.community_interactions(kept(spark, sf_dir), by_nation(spark, sf_dir))


@query("a05_community_summary", f"""WITH {INSIDE}, x AS (SELECT community_number, source AS node FROM ce UNION SELECT community_number, target FROM ce)
SELECT community_number, edge_count, total_weight, node_count FROM (SELECT community_number, count(*) AS edge_count, sum(weight) AS total_weight FROM ce GROUP BY 1) JOIN (SELECT community_number, count(*) AS node_count FROM x GROUP BY 1) USING (community_number)""")
def summary(spark, sf_dir):
    return com.summary(inside(spark, sf_dir))


@query("a06_community_members", f"WITH {INSIDE}, x AS (SELECT community_number, source AS node FROM ce UNION SELECT community_number, target FROM ce) SELECT community_number, list(node ORDER BY node) AS members FROM x GROUP BY 1")
def members(spark, sf_dir):
    return com.members(inside(spark, sf_dir))


@query("j03_community_messages", f"WITH {INSIDE} SELECT n.from_id, n.forwarder_id, n.created_at, n.unique_id, ce.community_number FROM n JOIN ce ON from_id = source AND forwarder_id = target")
def community_messages(spark, sf_dir):
    return com.messages_inside(inside(spark, sf_dir), messages(spark, sf_dir))


@query("a07_community_documents", f"""WITH {INSIDE}, m AS (SELECT ce.community_number, unique_id AS id, 'm' || unique_id AS text FROM n JOIN ce ON from_id = source AND forwarder_id = target)
SELECT community_number, list(text ORDER BY id) AS messages, list(id ORDER BY id) AS message_ids, count(*)::INT AS total_messages FROM m GROUP BY 1""")
def community_documents(spark, sf_dir):
    m = com.messages_inside(inside(spark, sf_dir), messages(spark, sf_dir)).withColumn("text", F.concat(F.lit("m"), F.col("unique_id")))
    return com.documents(m, "unique_id", "text")


@query("j04_edge_detail_usernames", f"""WITH {INSIDE}, u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS username FROM customer)
SELECT source, target, community_number, weight, coalesce(nullif(trim(a.username), ''), 'anonymous' || source) AS source_name, coalesce(nullif(trim(b.username), ''), 'anonymous' || target) AS target_name
FROM ce LEFT JOIN u a ON a.id = source LEFT JOIN u b ON b.id = target""")
def edge_detail(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, " ").when(F.col("c_custkey") % 7 != 0, F.col("c_name"))
    users = c.select(F.col("c_custkey").alias("id"), F.nullif(F.trim(name), F.lit("")).alias("username"))
    a, b = users.toDF("source", "sn"), users.toDF("target", "tn")
    filled = lambda c, i: F.coalesce(c, F.concat(F.lit("anonymous"), F.col(i)))
    return inside(spark, sf_dir).join(a, "source", "left").join(b, "target", "left").select("source", "target", "community_number", "weight", filled("sn", "source").alias("source_name"), filled("tn", "target").alias("target_name"))


@query("j05_cross_edges", f"WITH {BASE} SELECT source, target, a.community_number AS source_community, b.community_number AS target_community FROM k JOIN mi a ON a.node = source JOIN mi b ON b.node = target WHERE a.community_number <> b.community_number")
def cross_edges(spark, sf_dir):
    m = by_nation(spark, sf_dir)
    e = kept(spark, sf_dir).join(m.toDF("source", "source_community"), "source").join(m.toDF("target", "target_community"), "target")
    return e.where("source_community <> target_community").select("source", "target", "source_community", "target_community")


@query("a14_cross_community_statistics", f"""WITH {PAIRS}, x AS (SELECT source_community AS c, target_community AS o, 0.0 AS i, weight AS w FROM ci UNION ALL SELECT target_community, source_community, weight, 0.0 FROM ci)
SELECT c AS community_number, round(sum(i), 9) AS inbound_weight, round(sum(w), 9) AS outbound_weight, count(DISTINCT o) AS neighbours FROM x GROUP BY 1""")
def cross_statistics(spark, sf_dir):
    found = com.cross_statistics(com.community_interactions(kept(spark, sf_dir), by_nation(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 9) for c in ("inbound_weight", "outbound_weight")})


MATCH = f"{IF}, {WIF}" + """, sh AS (SELECT i.community_number AS a, w.community_number AS b, count(*) AS shared FROM mi i JOIN mw w USING (node) GROUP BY 1, 2),
sa AS (SELECT community_number AS a, count(*) AS size_a FROM mi GROUP BY 1), sb AS (SELECT community_number AS b, count(*) AS size_b FROM mw GROUP BY 1),
mt AS (SELECT a, b, shared, size_a, size_b, shared::DOUBLE / (size_a + size_b - shared) AS jaccard FROM sh JOIN sa USING (a) JOIN sb USING (b))"""


def matches(spark, sf_dir):
    return com.match(by_nation(spark, sf_dir), by_balance(spark, sf_dir))


@query("j06_community_match", f"WITH {MATCH} SELECT * FROM mt")
def community_match(spark, sf_dir):
    return matches(spark, sf_dir)


@query("a13_match_counts", f"WITH {MATCH} SELECT count(*) FILTER (jaccard = 1) AS matched, count(*) FILTER (jaccard < 1) AS partial, (SELECT count(*) FROM sa) AS absolute_total, (SELECT count(*) FROM sb) AS weighted_total FROM mt")
def match_counts(spark, sf_dir):
    m = matches(spark, sf_dir).agg(F.count_if(F.col("jaccard") == 1).alias("matched"), F.count_if(F.col("jaccard") < 1).alias("partial"))
    a = by_nation(spark, sf_dir).agg(F.count_distinct("community_number").alias("absolute_total"))
    b = by_balance(spark, sf_dir).agg(F.count_distinct("community_number").alias("weighted_total"))
    return m.crossJoin(a).crossJoin(b)


@query("j07_unmatched", f"WITH {MATCH} SELECT DISTINCT community_number AS b FROM mw WHERE community_number NOT IN (SELECT b FROM mt WHERE jaccard >= 0.1)")
def unmatched(spark, sf_dir):
    return com.unmatched(by_balance(spark, sf_dir), matches(spark, sf_dir).where("jaccard >= 0.1"), "b")


@query("p14_pair_key", f"WITH {MATCH} SELECT a, b, 'if:' || a || '|wif:' || b AS pair_key FROM mt")
def pair_key(spark, sf_dir):
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    empty = F.lit("")
    key = F.when(a.isNotNull() | b.isNotNull(), F.concat(F.lit("if:"), F.coalesce(a, empty), F.lit("|wif:"), F.coalesce(b, empty)))
    return matches(spark, sf_dir).select("a", "b", key.alias("pair_key"))


@query("j18_actor_community", f"""WITH {INSIDE}, {WIF}, x AS (SELECT node, community_number FROM mi UNION ALL SELECT node, community_number FROM mw)
SELECT node, CASE WHEN count(DISTINCT community_number) = 1 THEN min(community_number) END AS community_number FROM x GROUP BY 1""")
def actor_community(spark, sf_dir):
    return com.only_community(by_nation(spark, sf_dir).unionByName(by_balance(spark, sf_dir)))


@query("t01_strongest_edges", f"WITH {INSIDE} SELECT * FROM ce ORDER BY weight DESC, community_number::VARCHAR, source, target LIMIT 50")
def strongest(spark, sf_dir):
    return net.strongest_edges(inside(spark, sf_dir), 50)


@query("a04_parallel_edge_fold", "SELECT conv_id % 13 AS source, turn % 5 AS target, sum(coalesce(try_cast(nullif(regexp_extract(text, '[0-9]+'), '') AS DOUBLE), 0.0)) AS weight FROM conversations GROUP BY 1, 2")
def parallel_fold(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy((F.col("conv_id") % 13).alias("source"), (F.col("turn") % 5).alias("target")).agg(F.sum(F.coalesce(F.regexp_extract("text", "[0-9]+", 0).try_cast("double"), F.lit(0.0))).alias("weight"))


SUMMARY = INSIDE + """, nd AS (SELECT community_number, source AS node FROM ce UNION SELECT community_number, target FROM ce),
su AS (SELECT community_number, edge_count, total_weight, node_count FROM (SELECT community_number, count(*) AS edge_count, sum(weight) AS total_weight FROM ce GROUP BY 1) JOIN (SELECT community_number, count(*) AS node_count FROM nd GROUP BY 1) USING (community_number))"""


@query("t04_community_list", f"WITH {SUMMARY} SELECT * FROM su ORDER BY node_count DESC, edge_count DESC, community_number::VARCHAR LIMIT 10 OFFSET 5")
def community_list(spark, sf_dir):
    return com.summary(inside(spark, sf_dir)).orderBy(F.desc("node_count"), F.desc("edge_count"), F.col("community_number").cast("string")).offset(5).limit(10)


@query("t05_numeric_aware_order", f"WITH {MATCH}, x AS (SELECT DISTINCT CASE WHEN b > 40 THEN 'c' || b ELSE b::VARCHAR END AS id FROM mt) SELECT id, row_number() OVER (ORDER BY try_cast(id AS INT) IS NULL, try_cast(id AS INT), id) AS place FROM x")
def numeric_order(spark, sf_dir):
    b = F.col("b")
    ids = matches(spark, sf_dir).select(F.when(b > 40, F.concat(F.lit("c"), b)).otherwise(b.cast("string")).alias("id")).distinct()
    number = F.col("id").try_cast("int")
    return numbered(ids, number.isNull(), number, "id", name="place").withColumn("place", F.col("place") + 1)


@query("t08_community_map", f"""WITH {PAIRS}, sz AS (SELECT community_number AS c, count(*) AS size FROM mi GROUP BY 1), top AS (SELECT c FROM sz ORDER BY size DESC, c LIMIT 10)
SELECT * FROM ci WHERE source_community IN (SELECT c FROM top) AND target_community IN (SELECT c FROM top) ORDER BY weight DESC, source_community, target_community LIMIT 40""")
def community_map(spark, sf_dir):
    m = by_nation(spark, sf_dir)
    top = m.groupBy("community_number").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community_number").limit(10).select("community_number")
    pairs = com.community_interactions(kept(spark, sf_dir), m)
    chosen = pairs.join(top.toDF("source_community"), "source_community", "left_semi").join(top.toDF("target_community"), "target_community", "left_semi")
    return chosen.select(*pairs.columns).orderBy(F.desc("weight"), "source_community", "target_community").limit(40)


@query("w07_community_quota", f"""WITH {IF}, sz AS (SELECT community_number, count(*) AS size FROM mi GROUP BY 1), bs AS (SELECT *, least(2, size) AS base FROM sz), tk AS (SELECT sum(base) AS taken FROM bs),
mo AS (SELECT community_number, s, sqrt(size) / s AS score FROM bs, unnest(generate_series(base + 1, least(size, 120))) AS u(s) WHERE size > base),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, community_number, s) AS r FROM mo), gv AS (SELECT community_number, count(*) AS extra FROM rk, tk WHERE r <= 120 - taken GROUP BY 1)
SELECT community_number, size, base + coalesce(extra, 0) AS quota FROM bs LEFT JOIN gv USING (community_number)""")
def quota(spark, sf_dir):
    sizes = by_nation(spark, sf_dir).groupBy("community_number").agg(F.count(F.lit(1)).alias("size"))
    return com.seats(sizes, 120)


@query("w08_rank_in_community", f"""WITH {INSIDE}, x AS (SELECT community_number, source AS node, weight FROM ce UNION ALL SELECT community_number, target, weight FROM ce), g AS (SELECT community_number, node, count(*) AS degree, sum(weight) AS weight FROM x GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY community_number ORDER BY degree DESC, weight DESC, node) AS place FROM g QUALIFY place <= 10""")
def rank_in_community(spark, sf_dir):
    from pyspark.sql import Window

    ends = inside(spark, sf_dir).select("community_number", F.explode(F.array("source", "target")).alias("node"), "weight")
    g = ends.groupBy("community_number", "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("community_number").orderBy(F.desc("degree"), F.desc("weight"), "node"))).where("place <= 10")


@query("a12_prominent_centrality", f"""WITH {KEPT}, {WIF}, p AS (SELECT node FROM mw JOIN (SELECT community_number FROM mw GROUP BY 1 HAVING count(*) >= 3) USING (community_number)), c AS (SELECT count(*) AS n FROM p),
ie AS (SELECT * FROM k WHERE source IN (SELECT node FROM p) AND target IN (SELECT node FROM p))
SELECT p.node, coalesce(i.d, 0) * (1.0::DOUBLE / (n - 1)) AS in_centrality, coalesce(o.d, 0) * (1.0::DOUBLE / (n - 1)) AS out_centrality FROM p CROSS JOIN c
LEFT JOIN (SELECT source AS node, count(*) AS d FROM ie GROUP BY 1) o USING (node) LEFT JOIN (SELECT target AS node, count(*) AS d FROM ie GROUP BY 1) i USING (node)""")
def prominent_centrality(spark, sf_dir):
    p = com.prominent(by_balance(spark, sf_dir)).select("node").distinct()
    return net.centrality(p, net.induced(kept(spark, sf_dir), p))


@query("t13_coverage", f"WITH {INSIDE} SELECT available, represented, round(represented::DOUBLE / nullif(available, 0), 6) AS ratio FROM (SELECT count(*) AS available FROM k), (SELECT count(*) AS represented FROM ce)")
def coverage(spark, sf_dir):
    a = kept(spark, sf_dir).agg(F.count(F.lit(1)).alias("available"))
    b = inside(spark, sf_dir).agg(F.count(F.lit(1)).alias("represented"))
    return a.crossJoin(b).withColumn("ratio", F.round(F.col("represented") / F.nullif("available", F.lit(0)), 6))


@query("p08_weight_pushdown", f"WITH {INSIDE} SELECT * FROM ce WHERE weight >= 2 AND community_number = 7")
def pushdown(spark, sf_dir):
    return inside(spark, sf_dir).where("weight >= 2 AND community_number = 7")


@query("p06_community_predicate", f"WITH {MATCH} SELECT * FROM mt WHERE a::VARCHAR = '7' OR b::VARCHAR = '7'")
def community_predicate(spark, sf_dir):
    m = matches(spark, sf_dir)
    hit = F.lit(False)
    for c in ("a", "b", "community"):
        if c in m.columns:
            hit = hit | (F.col(c).cast("string") == "7")
    return m.where(hit)
