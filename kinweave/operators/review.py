"""Imported reviews, and values that must have been recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(reviews: DataFrame, key: str, scores: tuple[str, ...], hidden: tuple[str, ...] = (), least: float = 1, most: float = 5) -> DataFrame:
    """problem, column and n (rows) of imported reviews; a sound import has no row.

    Problems: ``missing`` and ``hidden`` (a column that names who was reviewed must not be there), both with all rows;
    ``unnamed`` and ``repeated`` keys (rows beyond the first of each); ``out of range`` scores, null and NaN included.
    """
    shape = [("missing", c) for c in (key, *scores) if c not in reviews.columns] + [("hidden", c) for c in hidden if c in reviews.columns]
    counts = [(p, c, F.count(F.lit(1))) for p, c in shape]
    if key in reviews.columns:
        counts += [("unnamed", key, F.count_if(F.col(key).isNull())), ("repeated", key, F.count(key) - F.count_distinct(key))]
    for c in scores:
        if c in reviews.columns:
            v = F.col(c).try_cast("double")
            counts.append(("out of range", c, F.count_if(~F.coalesce(v.between(least, most), F.lit(False)))))
    found = [F.struct(F.lit(p).alias("problem"), F.lit(c).alias("column"), n.alias("n"), F.lit(p in ("missing", "hidden")).alias("shape")) for p, c, n in counts]
    rows = reviews.agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.where("n > 0 OR shape").drop("shape")


def recorded(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``known``, one row for each ``on``; a row without one, or with a null key, is an error."""
    there = known.withColumn("__there", F.lit(True))
    joined = rows.join(there, on, "left")
    said = F.raise_error(F.concat(F.lit(f"nothing recorded for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return joined.where(F.coalesce(F.col("__there"), said.cast("boolean"))).drop("__there")
