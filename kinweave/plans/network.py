"""Queries over interaction networks: authors are suppliers, spreaders are customers, messages are order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import network as net
from kinweave.registry import query, table

#: Messages, edges and thresholded edges as SQL, used by the checks.
MESSAGES = """n AS (SELECT l_suppkey AS from_id, o_custkey AS forwarder_id, o_orderdate AS created_at, l_orderkey * 10 + l_linenumber AS unique_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EDGES = MESSAGES + """,
t AS (SELECT from_id, count(*) AS total_post FROM n WHERE from_id IS NOT NULL GROUP BY from_id),
s AS (SELECT from_id, forwarder_id, count(*) AS shared_post FROM n WHERE from_id IS NOT NULL AND forwarder_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT s.from_id AS source, s.forwarder_id AS target, total_post, shared_post, shared_post::DOUBLE / total_post AS weighted_post
 FROM s JOIN t USING (from_id) WHERE s.from_id <> s.forwarder_id)"""
#: Thresholds that keep the check from being nearly empty at small sizes.
KEPT = EDGES + ", k AS (SELECT * FROM e WHERE total_post >= 5 AND shared_post >= 2)"


#: Order lines that one task joins, in tables of over four times as many.
LINES = 1_000_000


def messages(spark, sf_dir):
    """The number of parts grows with the lines: keys compress so well that a part of the usual bytes is ten times as large in memory."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if (n := lines.count()) > 4 * LINES:
        lines, orders = lines.repartition(-(-n // LINES), "l_orderkey"), orders.repartition(-(-n // LINES), "o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_suppkey").alias("from_id"), F.col("o_custkey").alias("forwarder_id"), F.col("o_orderdate").alias("created_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unique_id"),
    )


def kept(spark, sf_dir):
    return net.threshold(net.edge_metrics(messages(spark, sf_dir)), 5, 2)


def nodes(spark, sf_dir):
    return net.endpoints(kept(spark, sf_dir))


@query("a01_edge_metrics", f"WITH {EDGES} SELECT * FROM e")
def edge_metrics(spark, sf_dir):
    return net.edge_metrics(messages(spark, sf_dir))


@query("a01_edge_metrics_filtered", f"WITH {EDGES} SELECT * FROM e WHERE total_post >= 10 AND shared_post >= 5")
def edge_metrics_filtered(spark, sf_dir):
    return net.threshold(net.edge_metrics(messages(spark, sf_dir)), 10, 5)


@query("p02_edge_threshold_5_2", f"WITH {KEPT} SELECT * FROM k")
def edges_5_2(spark, sf_dir):
    return kept(spark, sf_dir)


@query("a02_single_author", f"""WITH {MESSAGES}, m AS (SELECT * FROM n WHERE from_id = 3), t AS (SELECT count(*) AS total_post FROM m)
SELECT forwarder_id AS target, count(*) AS shared_post, any_value(total_post) AS total_post, count(*)::DOUBLE / any_value(total_post) AS weighted_post
FROM m, t WHERE forwarder_id IS NOT NULL AND forwarder_id <> 3 GROUP BY 1""")
def single_author(spark, sf_dir):
    return net.single_author(messages(spark, sf_dir), 3)


RELATIONS = """r AS (SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR AS message_id, l_suppkey AS user_id, 'PRODUCED' AS relation FROM lineitem
UNION ALL SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR, o_custkey, 'FORWARDED_BY' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 2)"""


def relations(spark, sf_dir):
    """Who made each order line, with an order or without, and who spread it."""
    m = messages(spark, sf_dir)
    message = F.col("unique_id").cast("string").alias("message_id")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("message_id")
    made = table(spark, sf_dir, "lineitem").select(line, F.col("l_suppkey").alias("user_id"), F.lit("PRODUCED").alias("relation"))
    spread = m.where(F.col("unique_id") % 10 != 2).select(message, F.col("forwarder_id").alias("user_id"), F.lit("FORWARDED_BY").alias("relation"))
    return made.unionByName(spread)


@query("j01_creator_spreader_join", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS from_id FROM lineitem),
s AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS forwarder_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 2)
SELECT id::VARCHAR AS message_id, from_id, forwarder_id FROM c JOIN s USING (id)""")
def creator_spreader(spark, sf_dir):
    return net.join_relations(relations(spark, sf_dir), "PRODUCED", "FORWARDED_BY")


@query("p01_relation_split", f"WITH {RELATIONS} SELECT relation, count(*) AS n, count(DISTINCT user_id) AS users FROM r GROUP BY relation")
def relation_split(spark, sf_dir):
    return relations(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("j02_edge_totals", f"WITH {EDGES} SELECT source, target, shared_post, sum(shared_post) OVER (PARTITION BY source) AS edge_total FROM e")
def edge_totals(spark, sf_dir):
    e = net.edge_metrics(messages(spark, sf_dir)).select("source", "target", "shared_post")
    return e.join(e.groupBy("source").agg(F.sum("shared_post").alias("edge_total")), "source")


@query("p05_snapshot", f"WITH {KEPT} SELECT 'twitter' AS data_type, 'reply' AS content_type, 2017 AS year, 3 AS month, * FROM k")
def snapshot(spark, sf_dir):
    return net.snapshot(kept(spark, sf_dir), "twitter", "reply", 3, 2017)


@query("k06_upsert_interactions", f"""WITH {KEPT}, o AS (SELECT * FROM e WHERE source % 2 = 0 UNION ALL SELECT * FROM k),
g AS (SELECT source, target, sum(total_post)::BIGINT AS total_post, sum(shared_post)::BIGINT AS shared_post FROM o GROUP BY 1, 2)
SELECT *, CASE WHEN total_post = 0 THEN 0.0 ELSE shared_post::DOUBLE / total_post END AS weighted_post FROM g""")
def upsert(spark, sf_dir):
    e = net.edge_metrics(messages(spark, sf_dir))
    return net.upsert(e.where("source % 2 = 0"), net.threshold(e, 5, 2))


@query("u03_endpoints", f"WITH {KEPT} SELECT source AS node FROM k UNION SELECT target FROM k")
def endpoints(spark, sf_dir):
    return nodes(spark, sf_dir)


@query("s19_distinct_users", f"WITH {MESSAGES} SELECT from_id AS user_id, 'creator' AS side FROM n UNION SELECT forwarder_id, 'spreader' FROM n")
def distinct_users(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select(F.explode(F.array(F.struct(F.col("from_id").alias("user_id"), F.lit("creator").alias("side")), F.struct(F.col("forwarder_id").alias("user_id"), F.lit("spreader").alias("side")))).alias("x")).select("x.*").distinct()


@query("s18_snapshot_edges_range", f"""WITH {MESSAGES} SELECT from_id AS source, forwarder_id AS target, count(*) AS messages FROM n
WHERE created_at >= TIMESTAMP '1997-12-01' AND created_at < TIMESTAMP '1998-01-01' GROUP BY ALL""")
def month_range(spark, sf_dir):
    """Half-open month bounds, with the roll-over of December."""
    start = F.make_date(F.lit(1997), F.lit(12), F.lit(1))
    m = messages(spark, sf_dir).where((F.col("created_at") >= start) & (F.col("created_at") < F.add_months(start, 1)))
    return m.groupBy(F.col("from_id").alias("source"), F.col("forwarder_id").alias("target")).agg(F.count(F.lit(1)).alias("messages"))


@query("s14_month_export_union", f"""WITH {MESSAGES}, w AS (SELECT * FROM n WHERE created_at >= TIMESTAMP '1996-02-01' AND created_at < TIMESTAMP '1996-03-01')
SELECT unique_id AS message_id, from_id AS user_id, 'PRODUCED' AS relation FROM w UNION SELECT unique_id, forwarder_id, 'FORWARDED_BY' FROM w""")
def month_export(spark, sf_dir):
    """Branches of a monthly export, each a filter and projection, united without repeats."""
    start = F.make_date(F.lit(1996), F.lit(2), F.lit(1))
    w = messages(spark, sf_dir).where((F.col("created_at") >= start) & (F.col("created_at") < F.add_months(start, 1)))
    branch = lambda c, r: w.select(F.col("unique_id").alias("message_id"), F.col(c).alias("user_id"), F.lit(r).alias("relation"))
    return branch("from_id", "PRODUCED").union(branch("forwarder_id", "FORWARDED_BY")).distinct()


@query("a08_daily_statistics", f"""WITH {MESSAGES}, d AS (SELECT day(created_at) AS day, count(*) AS n FROM n GROUP BY 1)
SELECT min(n) AS min_messages, (SELECT day FROM d ORDER BY n, day LIMIT 1) AS min_day, max(n) AS max_messages, (SELECT day FROM d ORDER BY n DESC, day LIMIT 1) AS max_day,
stddev_samp(n) AS std_messages, avg(n) AS mean_messages FROM d""")
def daily(spark, sf_dir):
    return net.daily_statistics(messages(spark, sf_dir), F.dayofmonth("created_at"))


@query("a08_event_days", """WITH d AS (SELECT event_type, day(ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
SELECT event_type, count(*) AS days, max(n) AS most, max(users) AS most_users, avg(n) AS mean_events FROM d GROUP BY event_type""")
def event_days(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), F.max("n").alias("most"), F.max("users").alias("most_users"), F.avg("n").alias("mean_events"))


@query("a09_user_message_totals", f"""WITH {KEPT}, u AS (SELECT source AS x FROM k UNION SELECT target FROM k), tt AS (SELECT source, max(total_post) AS total_post FROM k GROUP BY 1)
SELECT (SELECT count(*) FROM u) AS users, (SELECT sum(total_post)::BIGINT FROM tt) AS total_messages, (SELECT sum(shared_post)::BIGINT FROM k) AS shared_messages, (SELECT round(sum(weighted_post), 9) FROM k) AS weight""")
def totals(spark, sf_dir):
    k = kept(spark, sf_dir)
    users = net.endpoints(k).agg(F.count(F.lit(1)).alias("users"))
    total = k.groupBy("source").agg(F.max("total_post").alias("t")).agg(F.sum("t").alias("total_messages"))
    return users.crossJoin(total).crossJoin(k.agg(F.sum("shared_post").alias("shared_messages"), F.round(F.sum("weighted_post"), 9).alias("weight")))


CENTRAL = KEPT + """, v AS (SELECT source AS node FROM k UNION SELECT target FROM k), c AS (SELECT count(*) AS n FROM v),
o AS (SELECT source AS node, count(*) AS d FROM k GROUP BY 1), i AS (SELECT target AS node, count(*) AS d FROM k GROUP BY 1),
z AS (SELECT v.node, coalesce(i.d, 0) * (1.0::DOUBLE / (n - 1)) AS in_centrality, coalesce(o.d, 0) * (1.0::DOUBLE / (n - 1)) AS out_centrality FROM v CROSS JOIN c LEFT JOIN o USING (node) LEFT JOIN i USING (node))"""


@query("a10_degree_centrality", f"WITH {CENTRAL} SELECT * FROM z")
def centrality(spark, sf_dir):
    return net.centrality(nodes(spark, sf_dir), kept(spark, sf_dir))


def _extreme(c: str, order: str) -> str:
    return f"(SELECT node FROM z ORDER BY {c} {order}, node LIMIT 1)"


@query("a10_centrality_summary", f"""WITH {CENTRAL} SELECT max(in_centrality) AS max_in, {_extreme('in_centrality', 'DESC')} AS max_in_node, min(in_centrality) AS min_in, {_extreme('in_centrality', 'ASC')} AS min_in_node, avg(in_centrality) AS avg_in,
max(out_centrality) AS max_out, {_extreme('out_centrality', 'DESC')} AS max_out_node, min(out_centrality) AS min_out, {_extreme('out_centrality', 'ASC')} AS min_out_node, avg(out_centrality) AS avg_out FROM z""")
def centrality_summary(spark, sf_dir):
    return net.centrality_summary(net.centrality(nodes(spark, sf_dir), kept(spark, sf_dir)))


@query("t07_top_central", f"WITH {CENTRAL} SELECT node, out_centrality FROM z ORDER BY out_centrality DESC, node LIMIT 5")
def top_central(spark, sf_dir):
    return net.centrality(nodes(spark, sf_dir), kept(spark, sf_dir)).orderBy(F.desc("out_centrality"), "node").limit(5).select("node", "out_centrality")


@query("p16_masked_leaders", f"""WITH {CENTRAL} SELECT CASE WHEN length(x) > 6 THEN left(x, 2) || repeat('•', least(6, length(x) - 4)) || right(x, 2) ELSE x END AS masked, out_centrality
FROM (SELECT 'user' || node AS x, out_centrality FROM z)""")
def masked(spark, sf_dir):
    x = F.concat(F.lit("user"), F.col("node"))
    long = F.concat(F.substring(x, 1, 2), F.repeat(F.lit("•"), F.least(F.lit(6), F.length(x) - 4)), F.right(x, F.lit(2)))
    return net.centrality(nodes(spark, sf_dir), kept(spark, sf_dir)).select(F.when(F.length(x) > 6, long).otherwise(x).alias("masked"), "out_centrality")


@query("a11_graph_info", f"WITH {KEPT}, v AS (SELECT source AS x FROM k UNION SELECT target FROM k) SELECT nodes, edges, edges::DOUBLE / (nodes * (nodes - 1)) AS density FROM (SELECT count(*) AS nodes FROM v), (SELECT count(*) AS edges FROM k)")
def graph_info(spark, sf_dir):
    return net.graph_info(kept(spark, sf_dir))


@query("a43_undirected_edges", f"""WITH {KEPT} SELECT least(source, target) AS a, greatest(source, target) AS b, sum(CASE WHEN source <= target THEN weighted_post ELSE 0.0 END) AS forward_weight,
sum(CASE WHEN source > target THEN weighted_post ELSE 0.0 END) AS reverse_weight, sum(CASE WHEN source <= target THEN 1 ELSE 0 END)::BIGINT AS forward_edges, sum(CASE WHEN source > target THEN 1 ELSE 0 END)::BIGINT AS reverse_edges FROM k GROUP BY 1, 2""")
def undirected(spark, sf_dir):
    return net.undirected(kept(spark, sf_dir).withColumn("weight", F.col("weighted_post")))


@query("a44_returned_degrees", f"WITH {KEPT}, x AS (SELECT source AS node, 1 AS o, 0 AS i FROM k UNION ALL SELECT target, 0, 1 FROM k) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY 1")
def returned_degrees(spark, sf_dir):
    return net.degrees(nodes(spark, sf_dir), kept(spark, sf_dir))


@query("j19_induced_subgraph", f"WITH {KEPT} SELECT k.* FROM k WHERE source IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND target IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def induced(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return net.induced(kept(spark, sf_dir), chosen)


@query("p12_numeric_coercion", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN event_type ELSE value::VARCHAR END AS DOUBLE), 0.0) AS weight FROM events")
def numeric_coercion(spark, sf_dir):
    raw = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("weight"))


@query("p13_identifier_normalization", "SELECT event_id, nullif(regexp_replace(trim(CASE event_id % 4 WHEN 0 THEN user_id || '.0' WHEN 1 THEN ' ' || user_id || ' ' WHEN 2 THEN '  ' ELSE event_type END), '^(-?[0-9]+)\\.0$', '\\1'), '') AS id FROM events")
def identifiers(spark, sf_dir):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(u, F.lit(".0"))).when(k == 1, F.concat(F.lit(" "), u, F.lit(" "))).when(k == 2, F.lit("  ")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", net.normalized_id(raw).alias("id"))


@query("w06_first_record", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_record(spark, sf_dir):
    return net.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


#: Edges from larger to smaller keys, so that ways lead back.
RETURNING = KEPT + ", b AS (SELECT source, target FROM k UNION SELECT target, source FROM k WHERE target % 3 = 0)"


def returning(spark, sf_dir):
    k = kept(spark, sf_dir).select("source", "target")
    return k.unionByName(k.where("target % 3 = 0").select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


@query("a11_strong_components", f"""WITH RECURSIVE {RETURNING}, v AS (SELECT source AS node FROM b UNION SELECT target FROM b),
r(x, y) AS (SELECT source, target FROM b UNION SELECT r.x, b.target FROM r JOIN b ON r.y = b.source),
m AS (SELECT p.x AS node, min(p.y) AS other FROM r p JOIN r q ON q.x = p.y AND q.y = p.x GROUP BY 1)
SELECT node, coalesce(least(node, other), node) AS component FROM v LEFT JOIN m USING (node)""")
def strong_components(spark, sf_dir):
    return net.strong_components(returning(spark, sf_dir))


@query("a11_strongly_connected", f"""WITH RECURSIVE {RETURNING}, v AS (SELECT source AS node FROM b UNION SELECT target FROM b), o AS (SELECT min(node) AS o FROM v),
f(n) AS (SELECT o FROM o UNION SELECT target FROM f JOIN b ON source = n), g(n) AS (SELECT o FROM o UNION SELECT source FROM g JOIN b ON target = n)
SELECT (SELECT count(*) FROM f) = (SELECT count(*) FROM v) AND (SELECT count(*) FROM g) = (SELECT count(*) FROM v) AS is_strongly_connected""")
def strongly_connected(spark, sf_dir):
    return net.strongly_connected(returning(spark, sf_dir))
