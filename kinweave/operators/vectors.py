"""Groups of vectors: centroids, medoids and cohesion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import vectors as V


def centroids(rows: DataFrame, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """The (weighted) mean vector of each group: arrays are added up whole, in each task before the shuffle."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.groupBy(group).agg(vector_to_array(Summarizer.mean(_vector(F.col(vector)), w)).alias("centroid"))


def centre(vector: Column, weight: Column) -> Column:
    """The weighted mean of arrays, as an aggregate."""
    return vector_to_array(Summarizer.mean(_vector(vector), weight.cast("double")))


def _vector(array: Column) -> Column:
    return array_to_vector(array.cast("array<double>"))


def cohesion(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean pairwise cosine within each group without forming pairs.

    For unit vectors the sum over all pairs is (|sum|^2 - n) / 2, so one sum per dimension is enough; a group of one
    vector has cohesion 1.
    """
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(_vector(V.unit(F.col(vector))))).alias("s"))
    square = sums.select(group, "n", V.dot(F.col("s"), F.col("s")).alias("q"))
    pairs = F.col("n") * (F.col("n") - 1)
    return square.select(group, "n", F.when(F.col("n") == 1, 1.0).otherwise((F.col("q") - F.col("n")) / pairs).alias("cohesion"))


def medoids(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """The member with the largest mean cosine to its group, itself included; ties within 1e-12 go to the smaller key.

    The mean cosine to all members is the dot product with the mean unit vector, so no pairs are formed.
    """
    unit = rows.select(group, key, V.unit(F.col(vector)).alias("u"))
    scored = unit.join(centroids(unit, group, "u"), group).select(group, key, F.round(V.dot(F.col("u"), F.col("centroid")), 12).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).where("place = 1").select(group, F.col(key).alias("medoid"), F.col("score").alias("mean_cosine"))


def to_centroid(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Cosine of each member to its group's centroid."""
    return rows.join(centroids(rows, group, vector), group).select(group, key, V.cosine(F.col(vector), F.col("centroid")).alias("cosine"))


def neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 2, query_block: int = 512, row_block: int = 50_000) -> DataFrame:
    """The ``k`` nearest rows of each query by cosine, itself excluded: a stated query set against all rows, in blocks.

    Queries and rows are dealt into blocks of bounded size by their keys, and each block of queries meets each block of
    rows in a task.  There products of matrices give the cosines, a strip of queries at a time; the ``k`` largest of each
    query and all within 1e-7 of them are sent on, of equal vectors the ``k`` + 1 with the smallest keys.  These alone are
    scored as everywhere else, and ranked.  Rows without a cosine (null or of length zero) come last.
    """
    n_queries, n_rows = queries.count(), rows.count()
    q_blocks, r_blocks = -(-max(1, n_queries) // query_block), -(-max(1, n_rows) // row_block)
    side = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = [F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")]
    q = queries.select(*columns, side(q_blocks).alias("qb"), every(r_blocks).alias("rb"))
    r = rows.select(*columns, side(r_blocks).alias("rb"), every(q_blocks).alias("qb"))

    def placed(vectors: pd.Series) -> np.ndarray:
        size = next((len(v) for v in vectors if v is not None), 1)
        return np.stack([np.zeros(size) if v is None else v for v in vectors])

    def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("query", "neighbour", "q", "v")})]
        if len(q) and len(r):
            r = r.sort_values("key", kind="stable")
            x, y = placed(q["v"]), placed(r["v"])
            copy = pd.Series([v.tobytes() for v in y])
            first = (copy.groupby(copy).cumcount() <= k).to_numpy()
            r, y = r[first], y[first]
            lengths, others = (np.linalg.norm(z, axis=1) for z in (x, y))
            of_q, of_r = q["key"].to_numpy(), r["key"].to_numpy()
            for at in range(0, len(x), 64):
                with np.errstate(all="ignore"):
                    cosine = (x[at : at + 64] @ y.T) / (lengths[at : at + 64, None] * others)
                cosine[~np.isfinite(cosine)] = -3.0
                cosine[of_q[at : at + 64, None] == of_r] = -np.inf
                least = np.partition(cosine, -min(k, len(y)), axis=1)[:, -min(k, len(y))]
                i, j = np.nonzero((cosine >= least[:, None] - 1e-7) & np.isfinite(cosine))
                out.append(pd.DataFrame({"query": of_q[at + i], "neighbour": of_r[j], "q": q["v"].to_numpy()[at + i], "v": r["v"].to_numpy()[j]}))
        return pd.concat(out)

    kinds = [df.schema[key].dataType.simpleString() for df in (queries, rows)]
    met = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(near, f"query {kinds[0]}, neighbour {kinds[1]}, q array<double>, v array<double>")
    scored = met.select("query", "neighbour", F.round(V.cosine(F.col("q"), F.col("v")), 9).alias("cosine"), F.round(V.distance(F.col("q"), F.col("v")), 9).alias("distance"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("place") <= k)
