"""Queries of the read side over what the other modules derive."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import evolution as ev
from kinweave.operators import published as pub
from kinweave.plans import themes as th
from kinweave.plans.communities import IF, MATCH, by_nation, matches
from kinweave.plans.evolution import PATHS, members, paths, paths_and_transitions
from kinweave.plans.network import KEPT, kept
from kinweave.registry import query, table


@query("g10_path_theme_similarity", f"""WITH RECURSIVE {PATHS}, l AS (SELECT path_id, step_index, CASE WHEN step_index % 3 = 2 THEN NULL ELSE split_part(node, '_', 2)::INT % 5 END AS label FROM ps)
SELECT a.path_id, a.step_index::INT AS i, b.step_index::INT AS j, CASE WHEN a.label IS NULL OR b.label IS NULL THEN NULL WHEN a.label = b.label THEN 1.0 ELSE 1.0 / (1 + abs(a.label - b.label)) END AS similarity FROM l a JOIN l b USING (path_id) WHERE a.step_index <= b.step_index""")
def path_similarity(spark, sf_dir):
    label = F.when(F.col("step_index") % 3 != 2, F.split_part("node", F.lit("_"), F.lit(2)).cast("int") % 5)
    steps = ev.path_steps(paths(spark, sf_dir)).withColumn("label", label)
    labels = spark.range(5).select(F.col("id").cast("int").alias("a"))
    scores = labels.crossJoin(labels.toDF("b")).withColumn("score", 1.0 / (1 + F.abs(F.col("a") - F.col("b"))))
    return pub.cross_similarity(steps.select("path_id", "step_index", "label"), scores)


@query("c12_similarity_matrix", f"""WITH RECURSIVE {PATHS}, l AS (SELECT path_id, step_index, split_part(node, '_', 2)::INT AS c FROM ps)
SELECT a.path_id, a.step_index::INT AS i, list(1.0::DOUBLE / (1 + abs(a.c - b.c)) ORDER BY b.step_index) AS row FROM l a JOIN l b USING (path_id) GROUP BY 1, 2""")
def similarity_matrix(spark, sf_dir):
    s = ev.path_steps(paths(spark, sf_dir)).withColumn("c", F.split_part("node", F.lit("_"), F.lit(2)).cast("int"))
    a, b = s.select("path_id", F.col("step_index").alias("i"), F.col("c").alias("ca")), s.select("path_id", F.col("step_index").alias("j"), F.col("c").alias("cb"))
    upper = a.join(b, "path_id").where("i <= j").withColumn("similarity", 1.0 / (1 + F.abs(F.col("ca") - F.col("cb"))))
    return pub.full_matrix(upper, ["path_id"])


@query("t03_balanced_selection", f"""WITH {KEPT}, {IF}, sz AS (SELECT community_number, count(*) AS size FROM mi GROUP BY 1), x AS (SELECT source AS node, weighted_post AS w FROM k UNION ALL SELECT target, weighted_post FROM k),
g AS (SELECT node, count(*) AS degree, round(sum(w), 9) AS w FROM x GROUP BY 1), r AS (SELECT mi.node, row_number() OVER (PARTITION BY community_number ORDER BY coalesce(degree, 0) DESC, coalesce(w, 0) DESC, mi.node) AS place FROM mi LEFT JOIN g USING (node)),
c AS (SELECT node FROM r WHERE place <= 4) SELECT source, target, weighted_post AS weight FROM k WHERE source IN (SELECT node FROM c) AND target IN (SELECT node FROM c) ORDER BY weight DESC, source, target LIMIT 100""")
def balanced(spark, sf_dir):
    m = by_nation(spark, sf_dir)
    quotas = m.select("community_number").distinct().withColumn("quota", F.lit(4))
    e = kept(spark, sf_dir).select("source", "target", F.col("weighted_post").alias("weight"))
    return pub.balanced_selection(e, m, quotas, 100)


@query("a24_period_overview", f"WITH {KEPT}, {MATCH} SELECT matched, absolute, weighted, edges, interactions, round(matched::DOUBLE / nullif(greatest(absolute, weighted), 0) * 100, 2) AS matched_percent FROM (SELECT count(*) FILTER (jaccard = 1) AS matched, count(DISTINCT a) AS absolute, count(DISTINCT b) AS weighted FROM mt), (SELECT count(*) AS edges, sum(shared_post)::BIGINT AS interactions FROM k)")
def overview(spark, sf_dir):
    return pub.overview(kept(spark, sf_dir), matches(spark, sf_dir))


@query("g12_continuity_paths", f"""WITH RECURSIVE {PATHS}, j AS (SELECT path_id, step_index, node, lag(node) OVER (PARTITION BY path_id ORDER BY step_index) AS before FROM ps)
SELECT f.path, count(tr.retained) + 1 AS months, sum(tr.retained)::BIGINT AS retained_total, false AS inconsistent FROM fp f JOIN j USING (path_id) JOIN tr ON tr.source_node = j.before AND tr.target_node = j.node GROUP BY 1""")
def continuity(spark, sf_dir):
    return pub.continuity_paths(*paths_and_transitions(spark, sf_dir))


@query("g09_ordered_paths", f"WITH RECURSIVE {PATHS} SELECT path_id, list(split_part(node, '_', 2)::INT ORDER BY step_index) AS communities, list(split_part(node, '_', 1) ORDER BY step_index) AS periods FROM ps GROUP BY 1")
def ordered_paths(spark, sf_dir):
    part = lambda i: F.transform("path", lambda n: F.split_part(n, F.lit("_"), F.lit(i)))
    p = paths(spark, sf_dir)
    return p.select(ev.path_id(F.col("path")).alias("path_id"), part(2).cast("array<int>").alias("communities"), part(1).alias("periods"))


@query("j13_path_theme_lookup", f"""WITH RECURSIVE {PATHS}, s AS (SELECT source_node AS node, min(target::VARCHAR) AS t FROM tr GROUP BY 1), e AS (SELECT target_node AS node, min(source::VARCHAR) AS t FROM tr GROUP BY 1)
SELECT path_id, step_index, ps.node, coalesce(s.t, e.t, '') AS theme FROM ps LEFT JOIN s ON s.node = ps.node LEFT JOIN e ON e.node = ps.node""")
def theme_lookup(spark, sf_dir):
    """A step's theme from the transition it starts, else from the one it ends, else empty."""
    p, t = paths_and_transitions(spark, sf_dir)
    s = t.groupBy(F.col("source_node").alias("node")).agg(F.min(F.col("target").cast("string")).alias("s"))
    e = t.groupBy(F.col("target_node").alias("node")).agg(F.min(F.col("source").cast("string")).alias("e"))
    return ev.path_steps(p).join(s, "node", "left").join(e, "node", "left").select("path_id", "step_index", "node", F.coalesce("s", "e", F.lit("")).alias("theme"))


@query("j14_observation_family", f"""WITH {th.ROWS}, fam AS (SELECT label, 'ct_' || left(sha256(label), 16) AS family_id FROM (SELECT DISTINCT label FROM ob WHERE label NOT LIKE 'Brand%'))
SELECT ob.period, ob.pair_key, ob.label, family_id, family_id IS NULL AS noise FROM ob LEFT JOIN fam USING (label)""")
def observation_family(spark, sf_dir):
    o = th.observations(spark, sf_dir).select("period", "pair_key", "label")
    fam = o.where("label NOT LIKE 'Brand%'").select("label").distinct().withColumn("family_id", F.concat(F.lit("ct_"), F.substring(F.sha2(F.col("label").cast("binary"), 256), 1, 16)))
    return o.join(fam, "label", "left").select("period", "pair_key", "label", "family_id", F.col("family_id").isNull().alias("noise"))


@query("a17_clustered_monthly", f"WITH {th.ROWS} SELECT period, label AS theme_id, count(DISTINCT pair_key) AS pairs, max(seq) AS run_total FROM ob GROUP BY 1, 2")
def clustered_monthly(spark, sf_dir):
    return th.observations(spark, sf_dir).groupBy("period", F.col("label").alias("theme_id")).agg(F.count_distinct("pair_key").alias("pairs"), F.max("seq").alias("run_total"))


@query("j21_theme_intersection", f"WITH {th.ROWS} SELECT DISTINCT label FROM ob WHERE period = '2017-01' AND lower(trim(label)) IN (SELECT lower(trim(label)) FROM ob WHERE period = '2017-02')")
def theme_intersection(spark, sf_dir):
    o = th.observations(spark, sf_dir).select("period", "label", F.lower(F.trim("label")).alias("k"))
    return o.where("period = '2017-01'").join(o.where("period = '2017-02'").select("k"), "k", "left_semi").select("label").distinct()


@query("a25_run_overview", f"""WITH RECURSIVE {PATHS}, mm AS (SELECT period, count(DISTINCT community) AS communities, count(*) AS memberships FROM me GROUP BY 1), pp AS (SELECT count(*) AS persistent FROM fp)
SELECT mm.*, coalesce(t.transitions, 0) AS transitions, persistent FROM mm LEFT JOIN (SELECT period, count(*) AS transitions FROM tr GROUP BY 1) t USING (period), pp""")
def run_overview(spark, sf_dir):
    p, t = paths_and_transitions(spark, sf_dir)
    per = members(spark, sf_dir).groupBy("period").agg(F.count_distinct("community").alias("communities"), F.count(F.lit(1)).alias("memberships"))
    moves = t.groupBy("period").agg(F.count(F.lit(1)).alias("transitions"))
    return per.join(moves, "period", "left").fillna(0, ["transitions"]).crossJoin(p.agg(F.count(F.lit(1)).alias("persistent")))


@query("p11_run_filter", "SELECT event_type AS platform, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'view') AND value >= 20 AND year(ts) = 2024 AND month(ts) = 1 GROUP BY 1")
def run_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "view") & (F.col("value") >= 20) & (F.year("ts") == 2024) & (F.month("ts") == 1))
    return e.groupBy(F.col("event_type").alias("platform")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_period_resolution", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2017-03' WHEN 1 THEN '2016-11' ELSE '2015' END AS period FROM documents")
def period_resolution(spark, sf_dir):
    """From a path with YYYY/MM, a key with YYYY-MM, else a fallback year."""
    k = F.col("doc_id") % 3
    path = F.when(k == 0, "runs/2017/03/x.parquet").when(k == 1, "edges_2016-11_if").otherwise("edges.parquet")
    slash = F.regexp_replace(F.nullif(F.regexp_extract(path, r"(\d{4}/\d{2})(?:/|$)", 1), F.lit("")), "/", "-")
    key = F.nullif(F.regexp_extract(path, r"(\d{4}-(?:0[1-9]|1[0-2]))", 1), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(slash, key, F.lit("2015")).alias("period"))


@query("s08_page", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100 OFFSET 250")
def page(spark, sf_dir):
    from kinweave.sources import page as one_page

    return one_page(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 250, 100)


@query("s07_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag IN ('A', 'N')")
def projected_scan(spark, sf_dir):
    from kinweave.sources import projected

    return projected(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], [("l_quantity", ">=", 45), ("l_returnflag", "in", ["A", "N"])])


@query("s10_row_counts", "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def row_counts(spark, sf_dir):
    n = lambda t: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
    return n("lineitem").union(n("documents"))


@query("s23_cache_lookup", "SELECT c.conv_id, c.turn, l.quality AS cached FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id")
def cache_lookup(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.col("quality").alias("cached"))
    return table(spark, sf_dir, "conversations").join(cache, "conv_id", "left").select("conv_id", "turn", "cached")


@query("k07_property_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, count(*) AS writes FROM events GROUP BY 1")
def property_upsert(spark, sf_dir):
    """Later properties win: the newest write of each key."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", at).alias("last_type"), F.max_by("value", at).alias("last_value"), F.count(F.lit(1)).alias("writes"))


@query("a37_family_shares", f"WITH {th.ROWS}, f AS (SELECT label, count(*) AS n FROM ob GROUP BY 1) SELECT label, n, round(n::DOUBLE / (SELECT sum(n) FROM f), 6) AS share FROM f")
def family_shares(spark, sf_dir):
    f = th.observations(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return f.crossJoin(F.broadcast(f.agg(F.sum("n").alias("t")))).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("m13_partition_fidelity", "WITH p AS (SELECT vec_id, label AS a, min(vec_id) OVER (PARTITION BY label, vec_id % 500 = 7) AS b FROM embeddings), x AS (SELECT a, count(DISTINCT b) AS n FROM p GROUP BY 1), y AS (SELECT b, count(DISTINCT a) AS n FROM p GROUP BY 1) SELECT (SELECT max(n) FROM x) = 1 AND (SELECT max(n) FROM y) = 1 AS equal, (SELECT count(*) FROM x) AS groups, (SELECT count(*) FROM x WHERE n > 1) AS split, (SELECT count(*) FROM y WHERE n > 1) AS merged")
def fidelity(spark, sf_dir):
    """Two partitions are equal if each group of either meets one group of the other."""
    e = table(spark, sf_dir, "embeddings")
    odd = F.col("vec_id") % 500 == 7  # vectors that the other partition puts into groups of their own
    other = e.groupBy("label", odd.alias("odd")).agg(F.min("vec_id").alias("b"))
    p = e.select("label", odd.alias("odd")).join(other, ["label", "odd"]).select(F.col("label").alias("a"), "b")
    x = p.groupBy("a").agg(F.count_distinct("b").alias("n")).agg(F.max("n").alias("x"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("split"))
    y = p.groupBy("b").agg(F.count_distinct("a").alias("n")).agg(F.max("n").alias("y"), F.count_if(F.col("n") > 1).alias("merged"))
    return x.crossJoin(y).select(((F.col("x") == 1) & (F.col("y") == 1)).alias("equal"), "groups", "split", "merged")


@query("v10_similarity_embedding", "SELECT p_partkey, [len(list_filter(string_split(p_type, ' '), lambda w: w IN ('STANDARD', 'SMALL', 'LARGE')))::DOUBLE, len(list_filter(string_split(p_type, ' '), lambda w: w IN ('STEEL', 'TIN', 'BRASS')))::DOUBLE, len(string_split(p_type, ' '))::DOUBLE] AS embedding FROM part")
def similarity_embedding(spark, sf_dir):
    words = F.split("p_type", " ")
    hits = lambda vocabulary: F.size(F.filter(words, lambda w: w.isin(*vocabulary))).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.array(hits(("STANDARD", "SMALL", "LARGE")), hits(("STEEL", "TIN", "BRASS")), F.size(words).cast("double")).alias("embedding"))


@query("b01_benchmark_examples", "SELECT item_id, mode, 'ex_' || left(sha256(mode || '|' || text), 16) AS example_id FROM benchmark, (VALUES ('general'), ('absolute'), ('weighted')) m(mode) WHERE trim(text) <> ''")
def examples(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("trim(text) <> ''").withColumn("mode", F.explode(F.lit(["general", "absolute", "weighted"])))
    return b.select("item_id", "mode", F.concat(F.lit("ex_"), F.substring(F.sha2(F.concat_ws("|", "mode", "text").cast("binary"), 256), 1, 16)).alias("example_id"))


@query("x03_response_cache", "WITH r AS (SELECT DISTINCT text FROM conversations), c AS (SELECT DISTINCT text FROM conversations WHERE turn = 0) SELECT sha256(r.text) AS request, c.text IS NOT NULL AS hit FROM r LEFT JOIN c ON c.text = r.text")
def response_cache(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    requests = c.select(F.sha2(F.col("text").cast("binary"), 256).alias("request")).distinct()
    cached = c.where("turn = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("request")).distinct().withColumn("h", F.lit(True))
    return requests.join(cached, "request", "left").select("request", F.col("h").isNotNull().alias("hit"))


@query("v12_percentile", "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.25) AS p25 FROM orders GROUP BY 1")
def percentile(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.9).alias("p90"), F.percentile("o_totalprice", 0.25).alias("p25"))


@query("s08_file_page", "SELECT event_id, event_type, user_id FROM events LIMIT 100 OFFSET 250")
def file_page(spark, sf_dir):
    """A page in the order of files and rows, from the files that hold it."""
    from kinweave.sources import file_page as one_page

    return one_page(spark, f"{sf_dir}/events.parquet", 250, 100).select("event_id", "event_type", "user_id")


@query("theme_evidence_page", f"WITH {th.ROWS}, e AS (SELECT period, label AS theme, pair_key, seq FROM ob WHERE period = '2017-03' AND label = 'STANDARD') SELECT *, (SELECT count(*) FROM e) AS total FROM e ORDER BY seq, pair_key LIMIT 20 OFFSET 5")
def theme_evidence(spark, sf_dir):
    """The second page of one theme's observations in one period, with their number."""
    o = th.observations(spark, sf_dir).select("period", F.col("label").alias("theme"), "pair_key", "seq")
    return pub.evidence_page(o, "2017-03", "STANDARD", ["seq", "pair_key"], 5, 20)
