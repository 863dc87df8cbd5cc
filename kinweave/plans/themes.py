"""Queries over themes: parts are themed communities, their types labels, their names keywords, sizes mod 6 periods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.registry import query, table

ROWS = """th AS (SELECT '2017-0' || (1 + p_size % 6) AS period, 'if:' || p_partkey || '|wif:' || p_partkey % 50 AS pair_key, p_partkey AS seq,
 CASE WHEN p_partkey % 11 = 0 THEN [] ELSE [split_part(p_type, ' ', 1), p_brand] END AS labels, string_split(p_name, ' ') AS keywords FROM part),
ob AS (SELECT period, pair_key, seq, unnest(labels) AS label, keywords FROM th)"""


def themes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    none = F.array().cast("array<string>")
    return p.select(
        F.concat(F.lit("2017-0"), (F.col("p_size") % 6 + 1)).alias("period"), F.concat(F.lit("if:"), key, F.lit("|wif:"), key % 50).alias("pair_key"), key.alias("seq"),
        F.when(key % 11 == 0, none).otherwise(F.array(F.split_part("p_type", F.lit(" "), F.lit(1)), F.col("p_brand"))).alias("labels"), F.split("p_name", " ").alias("keywords"),
    )


def observations(spark, sf_dir):
    return themes(spark, sf_dir).select("period", "pair_key", "seq", F.explode("labels").alias("label"), "keywords")


def monthly_trend(rows):
    """Per period and label: different pairs and their percentage of all pairs with a label."""
    pairs = rows.groupBy("period", "label").agg(F.count_distinct("pair_key").alias("pairs"))
    whole = rows.groupBy("period").agg(F.count_distinct("pair_key").alias("themed"))
    return pairs.join(whole, "period").withColumn("percentage", F.round(F.col("pairs") / F.col("themed") * 100, 6))


def ranked_keywords(rows, limit: int):
    """Keywords of each label by different pairs, then first seen, then text; case is folded, the first spelling kept."""
    words = rows.select("label", "pair_key", "seq", F.posexplode("keywords").alias("place", "keyword")).withColumn("folded", F.lower(F.trim("keyword"))).where("folded <> ''")
    stats = words.groupBy("label", "folded").agg(F.count_distinct("pair_key").alias("pairs"), F.min(F.struct("seq", "place")).alias("first_seen"))
    order = Window.partitionBy("label").orderBy(F.desc("pairs"), "first_seen", "folded")
    return stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("label", F.col("folded").alias("keyword"), "pairs", "rank")


def dominant(rows, all_periods):
    """Per label: months in all, months present, peak month (the earliest of a tie) and its count."""
    counts = rows.groupBy("label", "period").agg(F.count_distinct("pair_key").alias("n"))
    return counts.groupBy("label").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("months_present"), F.min_by("period", F.struct(-F.col("n"), F.col("period"))).alias("peak_period"), F.max("n").alias("peak")
    )


@query("c08_observation_explode", f"WITH {ROWS} SELECT period, count(*) AS observations, count(DISTINCT pair_key) AS pairs, (SELECT count(*) FROM th x WHERE x.period = ob.period AND len(labels) = 0) AS unlabelled FROM ob GROUP BY period")
def observation_explode(spark, sf_dir):
    t = themes(spark, sf_dir)
    o = t.select("period", "pair_key", F.explode_outer("labels").alias("label"))
    return o.groupBy("period").agg(F.count("label").alias("observations"), F.count_distinct(F.when(F.col("label").isNotNull(), F.col("pair_key"))).alias("pairs"), F.count_if(F.col("label").isNull()).alias("unlabelled")).where("observations > 0")


@query("a15_monthly_trend", f"WITH {ROWS}, w AS (SELECT period, count(DISTINCT pair_key) AS themed FROM ob GROUP BY 1) SELECT period, label, pairs, themed, round(pairs::DOUBLE / themed * 100, 6) AS percentage FROM (SELECT period, label, count(DISTINCT pair_key) AS pairs FROM ob GROUP BY 1, 2) JOIN w USING (period)")
def trend(spark, sf_dir):
    return monthly_trend(observations(spark, sf_dir))


@query("a16_dominant_themes", f"WITH {ROWS}, c AS (SELECT label, period, count(DISTINCT pair_key) AS n FROM ob GROUP BY 1, 2) SELECT label, sum(n)::BIGINT AS total, count(*) AS months_present, arg_min(period, (-n, period)) AS peak_period, max(n) AS peak FROM c GROUP BY 1")
def dominant_themes(spark, sf_dir):
    return dominant(observations(spark, sf_dir), None)


@query("a16_zero_filled_series", f"WITH {ROWS}, l AS (SELECT DISTINCT label FROM ob), p AS (SELECT DISTINCT period FROM th), c AS (SELECT label, period, count(DISTINCT pair_key) AS n FROM ob GROUP BY 1, 2) SELECT label, period, coalesce(n, 0) AS n FROM l CROSS JOIN p LEFT JOIN c USING (label, period)")
def zero_filled(spark, sf_dir):
    """A row for each label and period that occurs at all; the periods are a short spine on each label's row."""
    t = themes(spark, sf_dir)
    spine = t.agg(F.sort_array(F.collect_set("period")).alias("periods"))
    counts = observations(spark, sf_dir).groupBy("label", "period").agg(F.count_distinct("pair_key").alias("n"))
    every = counts.select("label").distinct().crossJoin(F.broadcast(spine)).select("label", F.explode("periods").alias("period"))
    return every.join(counts, ["label", "period"], "left").select("label", "period", F.coalesce("n", F.lit(0)).alias("n"))


@query("a21_ranked_keywords", f"""WITH {ROWS}, w AS (SELECT label, pair_key, seq, i, lower(trim(keywords[i])) AS keyword FROM ob, unnest(generate_series(1, len(keywords))) AS g(i)), s AS (SELECT label, keyword, count(DISTINCT pair_key) AS pairs, min((seq, i)) AS f FROM w WHERE keyword <> '' GROUP BY 1, 2)
SELECT label, keyword, pairs, row_number() OVER (PARTITION BY label ORDER BY pairs DESC, f, keyword)::INT AS rank FROM s QUALIFY rank <= 20""")
def keyword_ranks(spark, sf_dir):
    return ranked_keywords(observations(spark, sf_dir), 20)


@query("a22_pair_details", f"WITH {ROWS} SELECT pair_key, list(label ORDER BY label) AS labels, count(*) AS n FROM (SELECT DISTINCT pair_key, label FROM ob) GROUP BY 1")
def pair_details(spark, sf_dir):
    return observations(spark, sf_dir).select("pair_key", "label").distinct().groupBy("pair_key").agg(F.sort_array(F.collect_list("label")).alias("labels"), F.count(F.lit(1)).alias("n"))


@query("a23_top_themes", f"WITH {ROWS} SELECT label, count(*) AS n FROM ob GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def top_themes(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(5)


@query("w10_top_themes_per_period", f"WITH {ROWS}, c AS (SELECT period, label, count(*) AS n FROM ob GROUP BY 1, 2) SELECT period, label, n, row_number() OVER (PARTITION BY period ORDER BY n DESC, label)::INT AS place FROM c QUALIFY place <= 5")
def top_per_period(spark, sf_dir):
    c = observations(spark, sf_dir).groupBy("period", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "label"))).where("place <= 5")


@query("p07_exact_theme", f"WITH {ROWS} SELECT period, pair_key FROM th WHERE list_contains(labels, 'STANDARD') OR list_contains(labels, 'Brand#11')")
def exact_theme(spark, sf_dir):
    t = themes(spark, sf_dir)
    return t.where(F.array_contains("labels", "STANDARD") | F.array_contains("labels", T.display(F.lit("  Brand#11 ")))).select("period", "pair_key")


@query("p10_period_range", f"WITH {ROWS} SELECT period, count(*) AS n FROM th WHERE period BETWEEN '2017-02' AND '2017-04' GROUP BY 1")
def period_range(spark, sf_dir):
    return themes(spark, sf_dir).where(F.col("period").between("2017-02", "2017-04")).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("c03_keyword_sets", "WITH k AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS w FROM part) SELECT p_partkey, list_distinct(a || w).len()::INT AS general, list_distinct(a).len()::INT AS absolute, list_distinct(w).len()::INT AS weighted FROM k")
def keyword_sets(spark, sf_dir):
    a, w = F.split("p_name", " "), F.split("p_type", " ")
    size = lambda x: F.size(F.array_distinct(x))
    return table(spark, sf_dir, "part").select("p_partkey", size(F.concat(a, w)).alias("general"), size(a).alias("absolute"), size(w).alias("weighted"))


@query("c10_theme_map", "SELECT p_partkey, p_brand || '.' || split_part(p_type, ' ', 1) AS names, [p_brand, split_part(p_type, ' ', 1)] AS themes FROM part")
def theme_map(spark, sf_dir):
    """A map of themes to keywords, written as JSON and read back; names joined by full stops."""
    m = F.create_map(F.col("p_brand"), F.split("p_name", " "), F.split_part("p_type", F.lit(" "), F.lit(1)), F.split("p_type", " "))
    read = table(spark, sf_dir, "part").select("p_partkey", F.from_json(F.to_json(m), "map<string,array<string>>").alias("m"))
    return read.select("p_partkey", F.array_join(F.map_keys("m"), ".").alias("names"), F.map_keys("m").alias("themes"))


@query("f20_mock_themes", """WITH k AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part), u AS (SELECT p_partkey, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS u FROM k),
g AS (SELECT p_partkey, i, u[i:i + 3] AS kw FROM u, unnest(generate_series(1, len(u), 4)) AS s(i)) SELECT p_partkey, array_to_string(kw[1:2], ' and ') AS theme, kw AS keywords FROM g""")
def mock_themes(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.group_themes(words)).alias("t")).select("p_partkey", "t.theme", "t.keywords")


@query("v09_mock_embedding", """WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' '), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, list_transform(w, lambda x: ('0x' || left(sha256(x), 2))::INT % 16) AS b FROM t)
SELECT doc_id, list_transform(range(0, 16), lambda k: len(list_filter(b, lambda x: x = k))::DOUBLE) || [n::DOUBLE] AS embedding FROM p""")
def mock_embedding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.mock_embedding(F.col("text")).alias("embedding"))


@query("x13_theme_rows_provenance", f"""WITH {ROWS}, pl AS (SELECT DISTINCT keywords FROM th), rs AS (SELECT keywords, array_to_string(keywords[1:2], ' and ') AS theme, sha256(array_to_string(keywords, '|')) AS request FROM pl)
SELECT seq, period, theme, request FROM th LEFT JOIN rs USING (keywords)""")
def theme_rows(spark, sf_dir):
    """One request for each different payload, joined back to the rows that share it."""
    t = themes(spark, sf_dir)
    payload = t.select("keywords").distinct()
    answers = payload.select("keywords", F.array_join(F.slice("keywords", 1, 2), " and ").alias("theme"), F.sha2(F.array_join("keywords", "|").cast("binary"), 256).alias("request"))
    return t.join(answers, "keywords", "left").select("seq", "period", "theme", "request")


@query("a28_generation_coverage", f"WITH {ROWS}, r AS (SELECT keywords, seq % 13 AS s FROM th) SELECT count(*) AS requests, count(*) FILTER (s = 0) AS refused, count(*) FILTER (s = 1) AS failed, count(*) FILTER (s > 1) AS succeeded, count(DISTINCT keywords) AS payloads, count(DISTINCT CASE WHEN s > 1 THEN keywords END) AS covered, count(*) FILTER (s <= 1) > 0 AS partial FROM r")
def generation_coverage(spark, sf_dir):
    s = F.col("seq") % 13
    return themes(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(s == 0).alias("refused"), F.count_if(s == 1).alias("failed"), F.count_if(s > 1).alias("succeeded"),
        F.count_distinct("keywords").alias("payloads"), F.count_distinct(F.when(s > 1, F.col("keywords"))).alias("covered"), (F.count_if(s <= 1) > 0).alias("partial"),
    )


@query("a20_cluster_summary", f"""WITH {ROWS}, o AS (SELECT period, label AS family, pair_key, seq FROM ob), w AS (SELECT period, count(DISTINCT pair_key) AS themed FROM o GROUP BY 1)
SELECT period, family, pairs, observations, round(pairs::DOUBLE / themed * 100, 6) AS percentage, ids FROM (SELECT period, family, count(DISTINCT pair_key) AS pairs, count(*) AS observations, list(DISTINCT seq ORDER BY seq) AS ids FROM o GROUP BY 1, 2) JOIN w USING (period)""")
def cluster_summary(spark, sf_dir):
    o = observations(spark, sf_dir).select("period", F.col("label").alias("family"), "pair_key", "seq")
    per = o.groupBy("period", "family").agg(F.count_distinct("pair_key").alias("pairs"), F.count(F.lit(1)).alias("observations"), F.sort_array(F.collect_set("seq")).alias("ids"))
    whole = o.groupBy("period").agg(F.count_distinct("pair_key").alias("themed"))
    return per.join(whole, "period").select("period", "family", "pairs", "observations", F.round(F.col("pairs") / F.col("themed") * 100, 6).alias("percentage"), "ids")


@query("m10_family_table", f"WITH {ROWS} SELECT label AS family, list(DISTINCT period ORDER BY period) AS periods, count(DISTINCT pair_key) AS pairs, count(DISTINCT pair_key) = 1 AS singleton FROM ob GROUP BY 1")
def family_table(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(F.col("label").alias("family")).agg(F.sort_array(F.collect_set("period")).alias("periods"), F.count_distinct("pair_key").alias("pairs"), (F.count_distinct("pair_key") == 1).alias("singleton"))


@query("a19_timeline_totals", f"WITH {ROWS}, r AS (SELECT period, count(*) AS rows, count(DISTINCT label) AS labels FROM ob GROUP BY 1) SELECT sum(rows)::BIGINT AS rows, max(labels) AS most_labels, (SELECT count(DISTINCT label) FROM ob) AS labels, count(*) AS periods FROM r")
def timeline_totals(spark, sf_dir):
    o = observations(spark, sf_dir)
    r = o.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("n"))
    return r.agg(F.sum("rows").alias("rows"), F.max("n").alias("most_labels"), F.count(F.lit(1)).alias("periods")).crossJoin(o.agg(F.count_distinct("label").alias("labels")))
