"""Queries of iterative and learned operators; SQL can't express them, tests hold them against their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators import clustering as cl
from kinweave.operators import modularity as mod
from kinweave.operators import topics
from kinweave.plans.network import kept
from kinweave.registry import query, table
from kinweave.streaming import monthly_activity, windowed_activity


@query("g02_label_communities")
def communities(spark, sf_dir):
    return mod.modularity_communities(kept(spark, sf_dir).select("source", "target", F.col("weighted_post").alias("weight")))


@query("g02_modularity")
def modularity(spark, sf_dir):
    e = kept(spark, sf_dir).select("source", "target", F.col("weighted_post").alias("weight"))
    return mod.modularity(e, mod.modularity_communities(e))


@query("m05_density_clusters")
def density(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("period", F.col("vec_id") % 8)
    return cl.density_clusters(e, "period", "vec_id", "embedding")


@query("m06_linked_families")
def families(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("period", F.col("vec_id") % 8)
    return cl.linked_families(e, "period", "vec_id", "embedding")


def _sweep(spark, sf_dir, rows: str):
    e = table(spark, sf_dir, "embeddings").withColumn("period", F.col("vec_id") % 8)
    variants = spark.sql(f"SELECT * FROM VALUES {rows} AS t(variant, method, least, samples, cut, geometry, selection, single)")
    return cl.sweep(e, variants, "period", "vec_id", "embedding")


@query("m12_density_sweep")
def density_sweep(spark, sf_dir):
    """Three geometries, two selections and two densities, and once the whole may be a cluster: thirteen variants."""
    settings = [(g, s, m, False) for g in ("raw", "unit", "cosine") for s in ("mass", "leaf") for m in (3, 2)] + [("raw", "mass", 3, True)]
    rows = ", ".join(f"('{g} {s} {m}{' single' * one}', 'density', 2, {m}, 0.0D, '{g}', '{s}', {str(one).lower()})" for g, s, m, one in settings)
    return _sweep(spark, sf_dir, rows)


@query("m11_linkage_sweep")
def linkage_sweep(spark, sf_dir):
    """Two linkages at twenty thresholds of similarity."""
    cuts = [(m, round(0.03 * k, 2)) for m in ("complete", "average") for k in range(1, 21)]
    rows = ", ".join(f"('{m}, similarity {1 - c:.2f}', '{m}', 0, 0, {c}D, 'unit', 'leaf', false)" for m, c in cuts)
    return _sweep(spark, sf_dir, rows)


@query("a32_density_quality")
def density_quality(spark, sf_dir):
    """Of each period's clusters by excess of mass: sizes, share of noise, mean membership probability."""
    e = table(spark, sf_dir, "embeddings").withColumn("period", F.col("vec_id") % 8)
    q = cl.quality(cl.density_clusters(e, "period", "vec_id", "embedding", selection="mass"), "period")
    return q.withColumn("noise_share", F.round(F.col("noise") / F.col("observations"), 6))


@query("a33_density_quality_over_periods")
def density_quality_over_periods(spark, sf_dir):
    """The means of those over all periods, one row."""
    q = density_quality(spark, sf_dir)
    return q.agg(F.count(F.lit(1)).alias("periods"), F.round(F.avg("noise_share"), 6).alias("noise_share"), F.round(F.avg("mean_probability"), 6).alias("mean_probability"), F.round(F.avg("largest_share"), 6).alias("largest_share"), F.max("clusters").alias("most"))


def _words(spark, sf_dir):
    cleaned = T.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(cleaned, " "), lambda w: F.length(w) > 2).alias("words"))


@query("m04_topics")
def dominant_topics(spark, sf_dir):
    return topics.dominant(topics.fit(_words(spark, sf_dir)))


@query("m01_topic_keywords_to_knee")
def topic_keywords(spark, sf_dir):
    return cl.keep_to_knee(topics.keywords(topics.fit(_words(spark, sf_dir))), "topic", "word", "weight")


@query("t02_greedy_edges")
def greedy(spark, sf_dir):
    return cl.greedy_edges(kept(spark, sf_dir).select("source", "target", F.col("weighted_post").alias("weight")))


@query("st_windowed_activity", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    w = windowed_activity(table(spark, sf_dir, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("value", 6).alias("value"))


@query("st_monthly_activity", "SELECT strftime(ts, '%Y-%m') AS period, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def monthly(spark, sf_dir):
    return monthly_activity(table(spark, sf_dir, "events"))
