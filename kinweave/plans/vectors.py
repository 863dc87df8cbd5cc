"""Queries over vectors: embeddings in their labelled groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import vectors as V
from kinweave.operators import vectors as vec
from kinweave.registry import query, table



def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


UNIT = f"u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (SELECT vec_id, label, embedding, sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings))"
CENTROID = UNIT + """, cl AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY 1, 2), ce AS (SELECT label, list(m ORDER BY i) AS centroid FROM cl GROUP BY 1)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


@query("v03_unit_vectors", f"WITH {UNIT} SELECT vec_id, round(u[1], 9) AS first, round({_dot('u', 'u')}, 9) AS length FROM u")
def unit_vectors(spark, sf_dir):
    u = vectors(spark, sf_dir).select("vec_id", V.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(V.dot(F.col("u"), F.col("u")), 9).alias("length"))


@query("v01_cosine_matrix", f"WITH {CENTROID} SELECT a.label AS left_label, b.label AS right_label, round({_dot('a.centroid', 'b.centroid')} / sqrt({_dot('a.centroid', 'a.centroid')} * {_dot('b.centroid', 'b.centroid')}), 9) AS cosine FROM ce a, ce b")
def cosine_matrix(spark, sf_dir):
    """Cosines of all pairs of labels, by their centroids: as many rows as labels squared, whatever the corpus."""
    u = vectors(spark, sf_dir).withColumn("embedding", V.unit(F.col("embedding")))
    c = vec.centroids(u, "label", "embedding")
    pairs = c.toDF("left_label", "a").crossJoin(c.toDF("right_label", "b"))
    return pairs.select("left_label", "right_label", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query("v04_nearest_neighbours", f"""WITH {UNIT}, s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round({_dot('a.u', 'b.u')}, 9) AS cosine, round(sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 9) AS distance
FROM u a JOIN u b ON a.vec_id <> b.vec_id JOIN embeddings x ON x.vec_id = a.vec_id JOIN embeddings y ON y.vec_id = b.vec_id WHERE a.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour)::INT AS place FROM s QUALIFY place <= 2""")
def nearest(spark, sf_dir):
    """Two nearest rows of every row whose id is divisible by 100, against all rows."""
    v = vectors(spark, sf_dir)
    return vec.neighbours(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding")


@query("v06_medoid", f"WITH {CENTROID} SELECT label, vec_id AS medoid, score AS mean_cosine FROM (SELECT u.label, vec_id, round({_dot('u', 'centroid')}, 12) AS score FROM u JOIN ce USING (label)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def medoid(spark, sf_dir):
    return vec.medoids(vectors(spark, sf_dir), "label", "vec_id", "embedding")


@query("a36_cohesion", f"""WITH {UNIT}, s AS (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY 1, 2), q AS (SELECT label, sum(s * s) AS q FROM s GROUP BY 1)
SELECT label, n, round(CASE WHEN n = 1 THEN 1.0 ELSE (q - n) / (n * (n - 1)) END, 9) AS cohesion FROM (SELECT label, count(*) AS n FROM u GROUP BY 1) JOIN q USING (label)""")
def cohesion(spark, sf_dir):
    found = vec.cohesion(vectors(spark, sf_dir), "label", "embedding")
    return found.withColumn("cohesion", F.round("cohesion", 9))


@query("a39_centroids", "WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS dimension, round(avg(x::DOUBLE), 9) AS mean FROM x GROUP BY 1, 2")
def centroids(spark, sf_dir):
    c = vec.centroids(vectors(spark, sf_dir), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dimension", "m")).select("label", F.col("dimension").cast("bigint").alias("dimension"), F.round("m", 9).alias("mean"))


@query("a39_weighted_centroids", "WITH x AS (SELECT label, 1 + vec_id % 3 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i - 1 AS dimension, round(sum(w * x::DOUBLE) / sum(w), 9) AS mean FROM x GROUP BY 1, 2")
def weighted_centroids(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("w", (F.col("vec_id") % 3 + 1).cast("double"))
    c = vec.centroids(v, "label", "embedding", "w")
    return c.select("label", F.posexplode("centroid").alias("dimension", "m")).select("label", F.col("dimension").cast("bigint").alias("dimension"), F.round("m", 9).alias("mean"))


@query("a40_centroid_cosine", f"WITH {CENTROID} SELECT label, vec_id, round({_dot('u', 'centroid')} / sqrt({_dot('centroid', 'centroid')}), 9) AS cosine FROM u JOIN ce USING (label)")
def centroid_cosine(spark, sf_dir):
    u = vectors(spark, sf_dir).withColumn("embedding", V.unit(F.col("embedding")))
    found = vec.to_centroid(u, "label", "vec_id", "embedding")
    return found.withColumn("cosine", F.round("cosine", 9))


@query("a35_norm_diagnostics", f"WITH n AS (SELECT sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings) SELECT round(min(n), 9) AS least, round(avg(n), 9) AS mean, round(median(n), 9) AS middle, round(max(n), 9) AS most, round(stddev_pop(n), 9) AS deviation FROM n")
def norms(spark, sf_dir):
    n = vectors(spark, sf_dir).select(V.norm(F.col("embedding")).alias("n"))
    r = lambda c, name: F.round(c, 9).alias(name)
    return n.agg(r(F.min("n"), "least"), r(F.avg("n"), "mean"), r(F.percentile("n", 0.5), "middle"), r(F.max("n"), "most"), r(F.stddev_pop("n"), "deviation"))


@query("a34_identical_vectors", "WITH v AS (SELECT embedding, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT embedding, label FROM embeddings WHERE vec_id % 5 = 0), g AS (SELECT embedding, count(*) AS n, count(DISTINCT CASE WHEN label >= 0 THEN label END) AS labels, count(*) FILTER (label < 0) AS noise FROM v GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (labels > 1) AS split, count(*) FILTER (labels > 0 AND noise > 0) AS boundary FROM g")
def identical(spark, sf_dir):
    v = vectors(spark, sf_dir)
    noisy = v.select("embedding", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label")).alias("label"))
    both = noisy.unionByName(v.where("vec_id % 5 = 0").select("embedding", "label"))
    g = both.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("labels"), F.count_if(F.col("label") < 0).alias("noise"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("labels") > 1).alias("split"), F.count_if((F.col("labels") > 0) & (F.col("noise") > 0)).alias("boundary"))


@query("a32_cluster_quality", f"""WITH {UNIT}, s AS (SELECT label, count(*) AS n FROM u GROUP BY 1) SELECT count(*) AS clusters, sum(n)::BIGINT AS observations, median(n) AS median_size, avg(n) AS mean_size, max(n) AS largest, round(max(n)::DOUBLE / sum(n), 6) AS largest_share FROM s""")
def cluster_quality(spark, sf_dir):
    s = vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("observations"), F.percentile("n", 0.5).alias("median_size"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


@query("v11_embedding_validation", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS full_width, count(*) FILTER (len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)) AS finite FROM embeddings GROUP BY 1")
def validation(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") == 64).alias("full_width"), F.count_if(V.valid(F.col("embedding"))).alias("finite"))


@query("v02_cosine_with_missing", f"WITH {UNIT} SELECT a.vec_id, round(CASE WHEN a.vec_id % 4 <> 0 AND b.vec_id % 4 <> 0 THEN {_dot('a.u', 'b.u')} END, 9) AS next_cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def cosine_missing(spark, sf_dir):
    """Cosine to the following row; cells whose label is missing stay null."""
    u = vectors(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 4 != 0, V.unit(F.col("embedding"))).alias("u"))
    nxt = u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    return u.join(nxt, "vec_id").select("vec_id", F.round(V.dot(F.col("u"), F.col("v")), 9).alias("next_cosine"))
