"""Queries for benchmark data sets and provider metrics: benchmark items, labels and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.operators import review
from kinweave.operators.chunking import greedy_chunks
from kinweave.registry import query, table


@query("b02_request_expansion", "SELECT item_id, mode, 'req_' || left(sha256(item_id || '|' || mode), 16) AS request_id FROM benchmark CROSS JOIN (VALUES ('absolute'), ('general'), ('weighted')) AS m(mode)")
def request_expansion(spark, sf_dir):
    modes = F.explode(F.lit(["absolute", "general", "weighted"])).alias("mode")
    rid = F.concat(F.lit("req_"), F.substring(F.sha2(F.concat_ws("|", "item_id", "mode").cast("binary"), 256), 1, 16))
    return table(spark, sf_dir, "benchmark").select("item_id", modes).withColumn("request_id", rid)


STRATA = "s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS round FROM documents)"


def _strata(spark, sf_dir):
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id")).alias("round"))


@query("w11_stratified_round_robin", f"WITH {STRATA} SELECT doc_id, lang, round::INT AS round FROM s ORDER BY round, lang LIMIT 100")
def round_robin(spark, sf_dir):
    """One of each stratum per round, by hash inside the stratum, until 100 are chosen."""
    return _strata(spark, sf_dir).orderBy("round", "lang").limit(100)


@query("w12_split_assignment", f"WITH {STRATA}, t AS (SELECT * FROM s ORDER BY round, lang LIMIT 100), o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split' || doc_id), doc_id) AS n FROM t) SELECT doc_id, CASE WHEN n <= 20 THEN 'development' WHEN n <= 50 THEN 'pilot' ELSE 'heldout' END AS split FROM o")
def split_assignment(spark, sf_dir):
    chosen = _strata(spark, sf_dir).orderBy("round", "lang").limit(100)
    h = F.sha2(F.concat(F.lit("split"), F.col("doc_id")).cast("binary"), 256)
    n = F.row_number().over(Window.orderBy(h, "doc_id"))  # the 100 that were chosen
    return chosen.withColumn("n", n).select("doc_id", F.when(F.col("n") <= 20, "development").when(F.col("n") <= 50, "pilot").otherwise("heldout").alias("split"))


@query("b04_frozen_validation", "SELECT count(*) AS examples, count(DISTINCT item_id) AS unique_ids, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) - count(DISTINCT text) AS repeated FROM benchmark")
def frozen_validation(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("item_id").alias("unique_ids"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), (F.count(F.lit(1)) - F.count_distinct("text")).alias("repeated"))


@query("b05_unresolved_requests", "SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.item_id)")
def unresolved(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(cache, "item_id", "left_anti")


@query("b07_blinded_export", "SELECT event_id, 'provider_' || dense_rank() OVER (PARTITION BY user_id % 10 ORDER BY event_type) AS blinded FROM events")
def blinded(spark, sf_dir):
    rank = F.dense_rank().over(Window.partitionBy(F.col("user_id") % 10).orderBy("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("provider_"), rank).alias("blinded"))


@query("b08_review_problems", """WITH r AS (SELECT event_id // 2 AS review_id, value AS quality, user_id % 7 AS clarity, user_id FROM events),
p AS (SELECT 'hidden' AS problem, 'user_id' AS "column", count(*) AS n FROM r UNION ALL SELECT 'repeated', 'review_id', count(review_id) - count(DISTINCT review_id) FROM r
UNION ALL SELECT 'out of range', 'quality', count(*) FILTER (NOT coalesce(quality BETWEEN 1 AND 5, false)) FROM r UNION ALL SELECT 'out of range', 'clarity', count(*) FILTER (NOT coalesce(clarity BETWEEN 1 AND 5, false)) FROM r)
SELECT * FROM p WHERE n > 0""")
def review_problems(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.expr("event_id div 2").alias("review_id"), F.col("value").alias("quality"), (F.col("user_id") % 7).alias("clarity"), "user_id")
    return review.problems(r, "review_id", ("quality", "clarity"), ("user_id", "provider"))


@query("b08_review_validation", "SELECT count(*) AS rows, count(*) - count(DISTINCT event_id) AS repeated, count(*) FILTER (value IS NULL OR value < 1 OR value > 5) AS out_of_range FROM events")
def review_validation(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("repeated"), F.count_if(v.isNull() | (v < 1) | (v > 5)).alias("out_of_range"))


@query("b10_keyword_allow_list", "SELECT p_partkey, list_filter(string_split(p_type || ' ' || p_name, ' '), lambda w: list_contains(string_split(p_name, ' '), w)) AS kept FROM part")
def allow_list(spark, sf_dir):
    words, allowed = F.split(F.concat_ws(" ", "p_type", "p_name"), " "), F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.filter(words, lambda w: F.array_contains(allowed, w)).alias("kept"))


@query("a29_provider_rates", "SELECT event_type AS provider, count(*) AS n, avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END) AS error_rate, avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def provider_rates(spark, sf_dir):
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count(F.lit(1)).alias("n"), rate(F.col("value") < 10).alias("error_rate"), rate(F.col("user_id") % 3 == 0).alias("hit_rate"), F.count_distinct("user_id").alias("users"))


@query("a30_split_percentiles", "SELECT event_type AS provider, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("a31_weighted_combine", "WITH s AS (SELECT event_type, user_id % 4 AS split, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, sum(n)::BIGINT AS n, round(sum(v * n) / sum(n), 9) AS value FROM s GROUP BY 1")
def weighted_combine(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return s.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 9).alias("value"))


@query("a42_inventory", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, least(n_chars // 1000, 20) AS bin FROM documents GROUP BY lang, source, bin")
def inventory(spark, sf_dir):
    b = F.least(F.floor(F.col("n_chars") / 1000), F.lit(20)).alias("bin")
    return table(spark, sf_dir, "documents").groupBy("lang", "source", b).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("a29_label_rates", "SELECT source, count(*) AS n, avg(quality::DOUBLE) AS quality_rate, avg(toxic::DOUBLE) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("quality_rate"), F.avg("toxic").alias("toxic_rate"))


@query("x10_request_chunks", """WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, i, turn, c, 0 AS chunk, 1 AS items, c AS chars FROM m WHERE i = 1 UNION ALL
 SELECT m.conv_id, m.i, m.turn, m.c, CASE WHEN r.items + 1 > 3 OR r.chars + m.c > 2000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.items + 1 > 3 OR r.chars + m.c > 2000 THEN 1 ELSE r.items + 1 END, CASE WHEN r.items + 1 > 3 OR r.chars + m.c > 2000 THEN m.c ELSE r.chars + m.c END
 FROM r JOIN m ON m.conv_id = r.conv_id AND m.i = r.i + 1)
SELECT conv_id, chunk, count(*) AS items, sum(c)::BIGINT AS chars FROM r GROUP BY 1, 2""")
def request_chunks(spark, sf_dir):
    """Greedy chunks of a conversation's messages, 3 items and 2000 characters at most."""
    return greedy_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 3, 2000)
