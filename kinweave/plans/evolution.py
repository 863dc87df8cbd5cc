"""Queries over time: the customers who ordered in a year, by nation; in even years nations are split in two."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import evolution as ev
from kinweave.registry import query, table
from kinweave.scratch import materialize

PERIODS = 7
LEAST = 0.3
MEMBERS = """me AS (SELECT DISTINCT year(o_orderdate)::VARCHAR AS period, c_nationkey + CASE WHEN year(o_orderdate) % 2 = 0 AND c_custkey % 2 = 0 THEN 25 ELSE 0 END AS community, o_custkey AS node
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
TRANSITIONS = MEMBERS + f""", sz AS (SELECT period, community, count(*) AS size FROM me GROUP BY 1, 2), pe AS (SELECT period, lead(period) OVER (ORDER BY period) AS next_period FROM (SELECT DISTINCT period FROM me)),
sh AS (SELECT a.period, next_period, a.community AS source, b.community AS target, count(*) AS retained FROM me a JOIN pe USING (period) JOIN me b ON b.period = next_period AND b.node = a.node GROUP BY ALL),
tr AS (SELECT sh.*, x.size AS source_size, y.size AS target_size, y.size - retained AS joined, x.size - retained AS exited, retained::DOUBLE / (x.size + y.size - retained) AS jaccard,
 sh.period || '_' || source AS source_node, next_period || '_' || target AS target_node
 FROM sh JOIN sz x ON x.period = sh.period AND x.community = source JOIN sz y ON y.period = next_period AND y.community = target WHERE retained::DOUBLE / (x.size + y.size - retained) >= {LEAST})"""
PATHS = TRANSITIONS + """, st AS (SELECT DISTINCT source_node AS node FROM tr WHERE source_node NOT IN (SELECT target_node FROM tr)), en AS (SELECT DISTINCT target_node AS node FROM tr WHERE target_node NOT IN (SELECT source_node FROM tr)),
pa AS (SELECT [node] AS path, node AS last FROM st UNION ALL SELECT list_append(path, target_node), target_node FROM pa JOIN tr ON source_node = last WHERE NOT list_contains(path, target_node)),
fp AS (SELECT path, 'path_' || left(sha256(array_to_string(path, chr(31))), 16) AS path_id FROM pa WHERE last IN (SELECT node FROM en) AND len(path) > 1),
ps AS (SELECT path_id, i - 1 AS step_index, path[i] AS node FROM fp, unnest(generate_series(1, len(path))) AS u(i))"""
PATH_TABLE = PATHS + """, pt AS (SELECT path_id, count(*) AS duration, count(*) - 1 AS transitions, round(avg(jaccard), 6) AS mean_jaccard, coalesce(sum(retained), 0)::BIGINT AS retained_total, list(node ORDER BY step_index) AS nodes
 FROM (SELECT *, lag(node) OVER (PARTITION BY path_id ORDER BY step_index) AS before FROM ps) p LEFT JOIN tr ON tr.source_node = p.before AND tr.target_node = p.node GROUP BY 1)"""


def members(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    year = F.year("o_orderdate")
    half = F.when((year % 2 == 0) & (F.col("c_custkey") % 2 == 0), 25).otherwise(0)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(year.cast("string").alias("period"), (F.col("c_nationkey") + half).alias("community"), F.col("o_custkey").alias("node")).distinct()


def transition_rows(spark, sf_dir):
    """Written once: paths walk over it again and again."""
    return materialize(ev.transitions(members(spark, sf_dir), LEAST), "transitions")


def paths(spark, sf_dir):
    return ev.all_paths(transition_rows(spark, sf_dir), PERIODS)


def paths_and_transitions(spark, sf_dir):
    t = transition_rows(spark, sf_dir)
    return ev.all_paths(t, PERIODS), t


@query("j08_transitions", f"WITH {TRANSITIONS} SELECT * FROM tr")
def transitions(spark, sf_dir):
    return ev.transitions(members(spark, sf_dir), LEAST)


@query("w01_consecutive_periods", f"WITH {MEMBERS} SELECT * FROM (SELECT period, lead(period) OVER (ORDER BY period) AS next_period FROM (SELECT DISTINCT period FROM me)) WHERE next_period IS NOT NULL")
def consecutive(spark, sf_dir):
    return ev.next_periods(members(spark, sf_dir))


@query("a26_transition_members", f"WITH {TRANSITIONS} SELECT period, sum(retained)::BIGINT AS retained, sum(joined)::BIGINT AS joined, sum(exited)::BIGINT AS exited, count(*) AS transitions, avg(jaccard) AS mean_jaccard FROM tr GROUP BY 1")
def transition_members(spark, sf_dir):
    sums = [F.sum(c).alias(c) for c in ("retained", "joined", "exited")]
    return transition_rows(spark, sf_dir).groupBy("period").agg(*sums, F.count(F.lit(1)).alias("transitions"), F.avg("jaccard").alias("mean_jaccard"))


@query("g06_start_and_end_nodes", f"WITH RECURSIVE {PATHS} SELECT node, 'start' AS kind FROM st UNION ALL SELECT node, 'end' FROM en")
def starts_and_ends(spark, sf_dir):
    return ev.starts_and_ends(transition_rows(spark, sf_dir))


@query("g07_all_paths", f"WITH RECURSIVE {PATHS} SELECT path FROM fp")
def all_paths(spark, sf_dir):
    return paths(spark, sf_dir)


@query("g08_path_table", f"WITH RECURSIVE {PATH_TABLE} SELECT * FROM pt")
def path_table(spark, sf_dir):
    return ev.path_table(*paths_and_transitions(spark, sf_dir))


@query("w04_path_rank", f"WITH RECURSIVE {PATH_TABLE} SELECT path_id, row_number() OVER (ORDER BY duration DESC, retained_total DESC, array_to_string(nodes, ' > ')) AS display_rank FROM pt")
def path_rank(spark, sf_dir):
    return ev.ranked_paths(ev.path_table(*paths_and_transitions(spark, sf_dir))).select("path_id", "display_rank")


@query("w05_step_attributes", f"""WITH RECURSIVE {PATHS} SELECT p.path_id, p.step_index, p.node, p.before, tr.jaccard, tr.retained FROM (SELECT *, lag(node) OVER (PARTITION BY path_id ORDER BY step_index) AS before FROM ps) p
LEFT JOIN tr ON tr.source_node = p.before AND tr.target_node = p.node""")
def step_attributes(spark, sf_dir):
    from pyspark.sql import Window

    steps = ev.path_steps(paths(spark, sf_dir)).withColumn("before", F.lag("node").over(Window.partitionBy("path_id").orderBy("step_index")))
    t = transition_rows(spark, sf_dir).select(F.col("source_node").alias("before"), F.col("target_node").alias("node"), "jaccard", "retained")
    return steps.join(t, ["before", "node"], "left").select("path_id", "step_index", "node", "before", "jaccard", "retained")


@query("w03_path_mobility", f"""WITH RECURSIVE {PATHS}, mm AS (SELECT period || '_' || community AS node, list(node) AS m FROM me GROUP BY 1), w AS (SELECT path_id, step_index, m, lag(m) OVER p AS pm,
 coalesce(flatten(list(m) OVER (PARTITION BY path_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS seen FROM ps JOIN mm USING (node) WINDOW p AS (PARTITION BY path_id ORDER BY step_index))
SELECT path_id, step_index, len(m) AS size, CASE WHEN step_index = 0 THEN len(m) ELSE len(list_intersect(m, pm)) END AS existing, CASE WHEN step_index = 0 THEN 0 ELSE len(list_filter(m, lambda x: NOT list_contains(seen, x))) END AS new,
CASE WHEN step_index = 0 THEN 0 ELSE len(list_filter(pm, lambda x: NOT list_contains(m, x))) END AS lost, CASE WHEN step_index = 0 THEN 0 ELSE len(list_filter(m, lambda x: list_contains(seen, x) AND NOT list_contains(pm, x))) END AS reappearing, len(m) - len(pm) AS size_delta FROM w""")
def mobility(spark, sf_dir):
    m = members(spark, sf_dir).select(F.concat_ws("_", "period", "community").alias("node"), F.col("node").alias("member"))
    return ev.membership_changes(ev.path_steps(paths(spark, sf_dir)), m)


@query("g04_transition_components", f"""WITH RECURSIVE {TRANSITIONS}, bo AS (SELECT source_node AS a, target_node AS b FROM tr UNION SELECT target_node, source_node FROM tr), re AS (SELECT a AS node, a AS other FROM bo UNION SELECT node, b FROM re JOIN bo ON other = a)
SELECT node, min(other) AS component FROM re GROUP BY 1""")
def transition_components(spark, sf_dir):
    return ev.components(transition_rows(spark, sf_dir))


@query("g14_persistent_communities", f"WITH RECURSIVE {PATH_TABLE} SELECT path_id, duration, nodes[1] AS first_node, nodes[len(nodes)] AS last_node FROM pt WHERE duration >= 3")
def persistent(spark, sf_dir):
    t = ev.path_table(*paths_and_transitions(spark, sf_dir)).where("duration >= 3")
    return t.select("path_id", "duration", F.get("nodes", F.lit(0)).alias("first_node"), F.element_at("nodes", -1).alias("last_node"))


@query("g05_sankey_indices", f"""WITH {TRANSITIONS}, nn AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS place FROM (SELECT source_node AS node FROM tr UNION SELECT target_node FROM tr))
SELECT source_node, target_node, a.place AS source_index, b.place AS target_index, jaccard FROM tr JOIN nn a ON a.node = source_node JOIN nn b ON b.node = target_node""")
def sankey(spark, sf_dir):
    return ev.sankey(transition_rows(spark, sf_dir))


@query("t09_top_links", f"WITH {TRANSITIONS} SELECT source_node, target_node, jaccard FROM tr ORDER BY jaccard DESC, source_node, target_node LIMIT 60")
def top_links(spark, sf_dir):
    return transition_rows(spark, sf_dir).orderBy(F.desc("jaccard"), "source_node", "target_node").limit(60).select("source_node", "target_node", "jaccard")


@query("w09_percent_change", f"WITH {MEMBERS}, c AS (SELECT community, period, count(*) AS members FROM me GROUP BY 1, 2), l AS (SELECT *, lag(members) OVER (PARTITION BY community ORDER BY period) AS p FROM c) SELECT community, period, members, (members - p) / abs(nullif(p, 0))::DOUBLE * 100 AS percent_change FROM l")
def percent_change(spark, sf_dir):
    c = members(spark, sf_dir).groupBy("community", "period").agg(F.count(F.lit(1)).alias("members"))
    return ev.percent_change(c, ["community"], "period", "members")


@query("w09_first_to_last_trend", f"WITH {MEMBERS}, c AS (SELECT community, period, count(*) AS members FROM me GROUP BY 1, 2) SELECT community, arg_max(members, period) - arg_min(members, period) AS trend FROM c GROUP BY 1")
def trend(spark, sf_dir):
    c = members(spark, sf_dir).groupBy("community", "period").agg(F.count(F.lit(1)).alias("members"))
    return c.groupBy("community").agg((F.max_by("members", "period") - F.min_by("members", "period")).alias("trend"))


@query("u04_member_sets", f"""WITH {MEMBERS}, a AS (SELECT node FROM me WHERE period = '1996' AND community = 3), b AS (SELECT node FROM me WHERE period = '1997' AND community = 3)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'lost', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def member_sets(spark, sf_dir):
    m = members(spark, sf_dir)
    a, b = (m.where(f"period = '{p}' AND community = 3").select("node") for p in ("1996", "1997"))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "lost": a.exceptAll(b), "new": b.exceptAll(a)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@query("v05_jaccard", f"WITH {TRANSITIONS} SELECT source_node, target_node, round(jaccard, 6) AS jaccard FROM tr WHERE jaccard < 1")
def jaccard(spark, sf_dir):
    """The same similarity from arrays of members, for pairs that are linked."""
    sets = members(spark, sf_dir).groupBy(F.concat_ws("_", "period", "community").alias("n")).agg(F.collect_set("node").alias("s"))
    t = transition_rows(spark, sf_dir).select("source_node", "target_node")
    both = t.join(sets.toDF("source_node", "a"), "source_node").join(sets.toDF("target_node", "b"), "target_node")
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return both.select("source_node", "target_node", F.round(j, 6).alias("jaccard")).where("jaccard < 1")


@query("g13_best_paths", f"WITH RECURSIVE {PATH_TABLE} SELECT path_id, duration, retained_total, mean_jaccard, nodes FROM pt ORDER BY duration DESC, retained_total DESC, mean_jaccard DESC, nodes LIMIT 5")
def best_paths(spark, sf_dir):
    return ev.best_paths(transition_rows(spark, sf_dir), PERIODS)
