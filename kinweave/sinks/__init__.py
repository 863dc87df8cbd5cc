"""Writers of published tables and run bundles."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources import digest, exists


def table(df: DataFrame, path: str) -> None:
    """A Parquet artifact; other names are refused."""
    if not path.endswith(".parquet"):
        raise ValueError(f"not a Parquet name: {path}")
    df.write.mode("overwrite").parquet(path)


def interactions(df: DataFrame, path: str) -> None:
    """Interaction edges, partitioned by what readers filter on."""
    columns = ["data_type", "content_type", "year", "month", "source", "target", "total_post", "shared_post", "weighted_post"]
    df.select(*columns).write.mode("overwrite").partitionBy("data_type", "content_type", "year", "month").parquet(path)


def embeddings(df: DataFrame, path: str, key: str = "embedding_key") -> None:
    """Vectors sorted by key inside files that cover disjoint key ranges, zstd compressed."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def with_json_lists(df: DataFrame) -> DataFrame:
    """Array and map columns as JSON text, for readers that know no nested types."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def _nested(df: DataFrame) -> dict[str, str]:
    return {c: kind for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}


def _write_json(spark: SparkSession, body: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def bundle(tables: dict[str, DataFrame], folder: str, run_id: str, created_at: str) -> DataFrame:
    """Publish a run: a manifest that says running, all tables, then the manifest of the completed run with what was written.

    Gives a row for each table: key, path, n_rows, columns, digest.  If a table can't be written the manifest says
    failed, with the error, and the error is raised.
    """
    spark = next(iter(tables.values())).sparkSession
    head = {"run_id": run_id, "created_at": created_at}
    _write_json(spark, head | {"status": "running"}, f"{folder}/manifest")
    rows = []
    try:
        for name, df in tables.items():
            table(df, f"{folder}/{name}.parquet")
            written = spark.read.parquet(f"{folder}/{name}.parquet")
            n, found = digest(written)
            rows.append((name, f"{name}.parquet", n, ",".join(written.columns), found))
    except Exception as error:
        _write_json(spark, head | {"status": "failed", "error": str(error)[:500]}, f"{folder}/manifest")
        raise
    entries = [dict(zip(("key", "path", "rows", "columns", "digest"), r, strict=True)) for r in rows]
    _write_json(spark, head | {"status": "completed", "artifacts": entries}, f"{folder}/manifest")
    return spark.createDataFrame(rows, "key string, path string, n_rows long, columns string, digest string")


def topic_inputs(tables: dict[str, DataFrame], folder: str, metadata: dict) -> None:
    """The tables that topics are fitted on, nested cells as JSON text, and a manifest with ``metadata`` written last."""
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in tables.items():
        table(with_json_lists(df), f"{folder}/{name}.parquet")
        entries[name] = _entry(spark.read.parquet(f"{folder}/{name}.parquet"), df)
    _write_json(spark, {"metadata": metadata, "tables": entries}, f"{folder}/manifest")


def _entry(written: DataFrame, df: DataFrame) -> dict:
    n, found = digest(written)
    return {"rows": n, "digest": found, "lists": _nested(df)}


def theme_inputs(df: DataFrame, folder: str, period: str) -> None:
    """One month's rows, in place of what the folder held for it, and the month's own manifest.

    Months have folders and manifests of their own, so that writers of different months need no lock.
    """
    spark = df.sparkSession
    with_json_lists(df).write.mode("overwrite").parquet(f"{folder}/rows/period={period}")
    _write_json(spark, {"period": period} | _entry(spark.read.parquet(f"{folder}/rows/period={period}"), df), f"{folder}/manifest/{period}")


def cached(spark: SparkSession, folder: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage for ``key`` (its inputs and settings): restored if it is there, else built and stored.

    The first writer wins.  A restored table is held against the digest that was stored with it.
    """
    path = f"{folder}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()}"
    if not exists(spark, f"{path}/digest/_SUCCESS"):
        try:
            build().write.mode("errorifexists").parquet(f"{path}/table")
        except AnalysisException:
            if not exists(spark, f"{path}/table/_SUCCESS"):
                raise
        _write_json(spark, dict(zip(("rows", "digest"), digest(spark.read.parquet(f"{path}/table")), strict=True)), f"{path}/digest")
    stored = spark.read.parquet(f"{path}/table")
    told = json.loads(spark.read.text(f"{path}/digest").first()["value"])
    if list(digest(stored)) != [told["rows"], told["digest"]]:
        raise ValueError(f"{path} has changed since it was stored")
    return stored
