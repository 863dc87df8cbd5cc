"""Readers of the tables and files the platform takes in."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONSHIP = ("source", "target", "relation")
INTERACTION = ("source", "target", "total_post", "shared_post")


def require(df: DataFrame, columns) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def relationships(spark: SparkSession, path: str) -> DataFrame:
    """A relationship export: CSV with a header, quoted node cells that may span lines.

    Such a file is one task, as only its reader knows where a record ends.  ``relationships_once`` turns large exports
    into Parquet, which later scans split.
    """
    return require(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True), RELATIONSHIP)


def relationships_once(spark: SparkSession, path: str, kept: str) -> DataFrame:
    """The Parquet copy of an export at ``kept``, made by the first call (a task for each file of the export)."""
    if not exists(spark, f"{kept}/_SUCCESS"):
        relationships(spark, path).write.mode("overwrite").parquet(kept)
    return require(spark.read.parquet(kept), RELATIONSHIP)


def exists(spark: SparkSession, path: str) -> bool:
    """True if there is such a file or folder, wherever Spark can read."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()).exists(found)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet, as the path ends."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True)
    if end == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"neither CSV nor Parquet: {path}")


def interactions(spark: SparkSession, path: str) -> DataFrame:
    return require(by_suffix(spark, path), INTERACTION)


def projected(spark: SparkSession, path: str, columns=None, filters=()) -> DataFrame:
    """Some columns and rows of a Parquet table; both reach the scan.  Filters are (column, operator, value)."""
    ops = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "in": "isin"}
    df = spark.read.parquet(path)
    for column, op, value in filters:
        df = df.where(getattr(F.col(column), ops[op])(value))
    return df.select(*columns) if columns else df


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def monthly(spark: SparkSession, pattern: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """All monthly tables ``<month>_<year>.parquet`` that a pattern matches, in one scan, with month, year and month_number.

    Files may lack columns that others have; list columns that are absent or null are empty lists.  Names without a
    month are left out.
    """
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    name = lambda n: F.regexp_extract(F.col("_metadata.file_path"), r"([A-Za-z]+)_(\d{4})\.parquet", n)
    df = df.select("*", F.lower(name(1)).alias("month"), name(2).try_cast("int").alias("year"))
    df = df.withColumn("month_number", F.array_position(F.lit(list(MONTHS)), F.col("month")).cast("int")).where("month_number > 0")
    empty = F.array().cast("array<string>")
    return df.withColumns({c: F.coalesce(F.col(c), empty) if c in df.columns else empty for c in lists})


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in a stated order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def file_page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset`` + ``limit`` of a Parquet table in the order of its files and the rows in them.

    The rows of each file are counted from footers, a row for each file comes to the driver, and only files that hold
    part of the page are read; within them row groups before and behind it are read past.  Nothing but the page is
    sorted.  Negative numbers count as 0; beyond the last row there are no rows.
    """
    whole = spark.read.parquet(path)
    start, stop = max(0, offset), max(0, offset) + max(0, limit)
    place, begins = 0, {}
    for r in whole.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect():
        if place < stop and place + r["n"] > start:
            begins[r["file"]] = place
        place += r["n"]
    if not begins:
        return whole.limit(0)
    reader = spark.read.schema(whole.schema)
    if list(begins)[0].rpartition("/")[2] != path.rstrip("/").rpartition("/")[2]:  # a folder, whose partitions are columns
        reader = reader.option("basePath", path)
    few = reader.parquet(*begins)
    first = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])
    at = F.element_at(first, F.col("_metadata.file_path")) + F.col("_metadata.row_index")
    return few.withColumn("__at", at).where((F.col("__at") >= start) & (F.col("__at") < stop)).orderBy("__at").drop("__at")


def pages(tables: list[DataFrame], order: list, offset: int, limit: int) -> DataFrame:
    """A page over several tables, one after the other, each in a stated order, with the total of all rows."""
    numbered = [t.withColumn("table_number", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b), numbered)
    total = every.agg(F.count(F.lit(1)).alias("total"))
    return page(every, ["table_number", *order], offset, limit).crossJoin(F.broadcast(total))  # one row


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: The largest file whose bytes are read whole to be hashed.
HASHED = (1 << 31) - 1


def _below(folder: str):
    """A file's path below a folder."""
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    base = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return F.substr(plain, F.lit(len(base) + 1))


def files(spark: SparkSession, folder: str, hashes: bool = True) -> DataFrame:
    """path (below ``folder``), byte_size and sha256 of all files below a folder but Spark's own marks.

    A file is hashed by one task.  Files over ``HASHED`` bytes have a null hash.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = found.withColumn("path", _below(folder)).where(~F.col("path").rlike("(^|/)[_.][^/]*$"))
    if not hashes:
        return own.select("path", F.col("length").alias("byte_size"), F.lit(None).cast("string").alias("sha256"))
    small = own.where(F.col("length") <= HASHED).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(own.where(F.col("length") > HASHED).select("path", F.col("length").alias("byte_size"), F.lit(None).cast("string").alias("sha256")))


#: Bytes of a range that is hashed at a time, children of a node of the hash tree, and ranges a task.
RANGE, CHILDREN, RANGES_A_TASK = 1 << 26, 1024, 8


def tree_hashes(spark: SparkSession, folder: str, size: int = RANGE, fan: int = CHILDREN) -> DataFrame:
    """path (below ``folder``), byte_size and tree_sha256 of all files below a folder but Spark's own marks, of any size.

    A file is cut into ranges of ``size`` bytes, hashed in tasks of their own by blocks of 1 MB.  The hexadecimal hashes
    of ``fan`` neighbours, joined, are hashed again, level by level, until one is left.  A file of one range has the
    SHA-256 of its bytes.  Spark lists no files of no bytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("byte_size"))
    own = found.select(F.col("path").alias("full"), _below(folder).alias("path"), "byte_size").where(~F.col("path").rlike("(^|/)[_.][^/]*$"))
    last = F.greatest(F.ceil(F.col("byte_size") / size) - 1, F.lit(0)).cast("long")
    ranges = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("place"))
    total, most = own.agg(F.sum(last + 1), F.max(last + 1)).first()
    out = "path string, byte_size long, place long, sha256 string"
    nodes = ranges.repartition(max(1, -(-(total or 0) // RANGES_A_TASK))).mapInArrow(lambda batches: _hashed_ranges(batches, size), out)
    most = most or 1
    while most > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sha256"))), lambda x: x["sha256"]), "")
        nodes = nodes.groupBy("path", "byte_size", F.expr(f"place div {fan}").alias("place")).agg(F.count(F.lit(1)).alias("n"), F.first("sha256").alias("only"), joined.alias("all"))
        nodes = nodes.select("path", "byte_size", "place", F.when((F.col("n") == 1) & (F.col("place") == 0), F.col("only")).otherwise(F.sha2(F.col("all").cast("binary"), 256)).alias("sha256"))
        most = -(-most // fan)
    return nodes.select("path", "byte_size", F.col("sha256").alias("tree_sha256"))


def _hashed_ranges(batches, size: int):
    for batch in batches:
        rows = batch.to_pylist()
        hashes = [_hash_range(r["full"], r["place"] * size, size) for r in rows]
        yield pa.RecordBatch.from_pydict({"path": batch["path"], "byte_size": batch["byte_size"], "place": batch["place"], "sha256": pa.array(hashes, pa.string())})


def _hash_range(path: str, start: int, size: int) -> str:
    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    found = hashlib.sha256()
    with store.open_input_file(name) as file:
        file.seek(start)
        while size > 0 and (block := file.read(min(size, 1 << 20))):
            found.update(block)
            size -= len(block)
    return found.hexdigest()


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files below ``folder`` held against a manifest of (path, byte_size) and tree_sha256 or sha256: path, status of each entry.

    Paths are those below the folder, so that equal names in different folders are told apart.  A manifest with
    tree_sha256 is held against ``tree_hashes``, whatever the files' sizes.  Statuses: ok, changed, missing, and unchecked
    for files of the right size without a hash in the manifest, or, held against sha256, over ``HASHED`` bytes, and for
    entries of no bytes, as Spark lists no such files.
    """
    name = "tree_sha256" if "tree_sha256" in manifest.columns else "sha256"
    found = tree_hashes(spark, folder) if name == "tree_sha256" else files(spark, folder)
    found = found.select("path", F.col(name).alias("found_hash"), F.col("byte_size").alias("found_size"))
    same = F.col("found_size") == F.col("byte_size")
    unknown = F.col(name).isNull() | F.col("found_hash").isNull()
    absent = F.when(F.col("byte_size") == 0, "unchecked").otherwise("missing")
    status = F.when(F.col("found_size").isNull(), absent).when(same & unknown, "unchecked").when(same & (F.col("found_hash") == F.col(name)), "ok").otherwise("changed")
    return manifest.join(found, "path", "left").select("path", status.alias("status"))


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of them that doesn't depend on their order, for tables too large to hash as bytes."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in df.dtypes))
    r = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r["n"], f"{r['x']}:{r['s']}"


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", "true").text(path).first()["value"])


def topic_inputs(spark: SparkSession, folder: str, metadata: dict) -> dict[str, DataFrame]:
    """The tables of a topic-input bundle; an error if it was made for other metadata or a table has changed."""
    manifest = _manifest(spark, f"{folder}/manifest")
    if manifest["metadata"] != metadata:
        raise ValueError("the bundle was made for other settings")
    return {name: _restored(spark, f"{folder}/{name}.parquet", entry) for name, entry in manifest["tables"].items()}


def _restored(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    stored = spark.read.parquet(path)
    if list(digest(stored)) != [entry["rows"], entry["digest"]]:
        raise ValueError(f"{path} is not what the manifest says")
    return stored.withColumns({c: F.from_json(c, kind) for c, kind in entry["lists"].items()})


def theme_inputs(spark: SparkSession, folder: str, lists: dict[str, str] | None = None) -> DataFrame:
    """The months of a theme-input folder, with period.

    Only months with a manifest are read, each held against its digest; a folder without manifests is read as it is,
    with the list columns given.
    """
    if not exists(spark, f"{folder}/manifest"):
        return spark.read.parquet(f"{folder}/rows").withColumns({c: F.from_json(c, kind) for c, kind in (lists or {}).items()})
    months = [json.loads(r["value"]) for r in spark.read.option("wholetext", "true").text(f"{folder}/manifest/*").collect()]  # one for each month
    parts = [_restored(spark, f"{folder}/rows/period={m['period']}", m).withColumn("period", F.lit(m["period"])) for m in sorted(months, key=lambda m: m["period"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


def artifact_index(spark: SparkSession, folder: str, contract: dict[str, tuple[str, ...]]) -> DataFrame:
    """What a contract (artifact and its columns) asks of a folder: artifact, n_files, byte_size, missing and status.

    Statuses: ok, incomplete (columns are missing), missing.  Files are listed, not read.
    """
    rows = []
    for name, columns in contract.items():
        there = exists(spark, f"{folder}/{name}.parquet")
        missing = [c for c in columns if c not in spark.read.parquet(f"{folder}/{name}.parquet").columns] if there else list(columns)
        rows.append((name, ",".join(missing), "missing" if not there else "incomplete" if missing else "ok"))
    asked = spark.createDataFrame(rows, "artifact string, missing string, status string")
    sizes = files(spark, folder, hashes=False).groupBy(F.regexp_extract("path", r"^([^/]+)\.parquet/", 1).alias("artifact")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("byte_size").alias("byte_size"))
    return asked.join(sizes, "artifact", "left").fillna(0, ["n_files", "byte_size"])


def run_catalog(spark: SparkSession, pattern: str) -> DataFrame:
    """Runs of all manifests that match: the newest first; run ids that occur twice and manifests without one are left out."""
    m = spark.read.option("wholetext", "true").text(pattern)
    parsed = m.select(F.from_json("value", "run_id string, status string, created_at string, platform string").alias("r")).select("r.*").where("run_id IS NOT NULL")
    once = parsed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.first("status").alias("status"), F.first("created_at").alias("created_at"), F.first("platform").alias("platform"))
    return once.where("n = 1").drop("n").orderBy(F.desc("created_at"), "run_id")
