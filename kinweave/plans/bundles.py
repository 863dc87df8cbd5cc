"""Queries of readers and writers: tables of the driver go through a sink and come back through a source."""

from __future__ import annotations

import os
import uuid
from functools import partial

from pyspark.sql import functions as F

from kinweave import sinks, sources
from kinweave.functions import text as T
from kinweave.plans.network import KEPT, MESSAGES, RELATIONS, kept, messages, relations
from kinweave.plans.themes import ROWS, themes
from kinweave.registry import query, table
from kinweave.scratch import shared_dir


#: Rows of a file of an export whose cells hold line breaks.
FILE_ROWS = 200_000


def place(spark, name: str) -> str:
    """A new folder among the shared ones."""
    return os.path.join(shared_dir(spark), "kinweave", f"{name}-{uuid.uuid4().hex}")


@query("s01_relationship_csv", f"WITH {RELATIONS} SELECT relation, count(*) AS n, count(DISTINCT message_id) AS messages, count(DISTINCT user_id) AS users FROM r GROUP BY 1")
def relationship_csv(spark, sf_dir):
    """Node cells with quotes, commas and line breaks, through CSV once and Parquet from then on.

    No task can read a part of such a file, so files have at most ``FILE_ROWS`` rows, however large the export is.
    """
    cell = F.concat(F.lit("{'user_id': "), F.col("user_id"), F.lit(',\n "name": "a, b"}'))
    path = place(spark, "export")
    relations(spark, sf_dir).select(F.col("message_id").alias("source"), cell.alias("target"), "relation").write.option("maxRecordsPerFile", FILE_ROWS).csv(f"{path}/export.csv", header=True, quote='"', escape='"')
    r = sources.relationships_once(spark, f"{path}/export.csv", f"{path}/export.parquet")
    user = F.regexp_extract("target", r"(?s)^\{'user_id': (\d+),\n \"name\": \"a, b\"\}$", 1)
    return r.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("messages"), F.count_distinct(F.nullif(user, F.lit(""))).alias("users"))


@query("s02_stage_scan", "SELECT side, s_suppkey::BIGINT AS s_suppkey, s_name FROM supplier, (VALUES ('csv'), ('parquet')) AS t(side)")
def stage_scan(spark, sf_dir):
    s, path = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), place(spark, "stage")
    s.write.csv(f"{path}/s.csv", header=True)
    s.write.parquet(f"{path}/s.parquet")
    read = lambda end: sources.by_suffix(spark, f"{path}/s.{end}").select(F.lit(end).alias("side"), F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name")
    return read("csv").unionByName(read("parquet"))


@query("s03_interaction_scan", f"WITH {KEPT} SELECT source, target, total_post, shared_post FROM k")
def interaction_scan(spark, sf_dir):
    path = place(spark, "edges") + ".parquet"
    sinks.table(kept(spark, sf_dir), path)
    return sources.interactions(spark, path).select("source", "target", "total_post", "shared_post")


@query("s04_monthly_scan", """SELECT lower(monthname(o_orderdate)) AS month, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month_number, count(*) AS n, 0::BIGINT AS keywords
FROM orders GROUP BY ALL""")
def monthly_scan(spark, sf_dir):
    """Monthly files of all years in one scan; a list column that no file has is empty."""
    path = place(spark, "months")
    name = F.concat(F.lower(F.date_format("o_orderdate", "MMMM")), F.lit("_"), F.year("o_orderdate"), F.lit(".parquet"))
    table(spark, sf_dir, "orders").select("o_orderkey", name.alias("file")).repartition("file").write.partitionBy("file").parquet(path)
    m = sources.monthly(spark, f"{path}/*_*.parquet", ("keywords",))
    return m.groupBy("month", "year", "month_number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("keywords")).cast("bigint").alias("keywords"))


@query("s05_topic_inputs", "SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations")
def topic_inputs(spark, sf_dir):
    """A bundle of four tables with list cells, written and read back for the same settings."""
    c, path = table(spark, sf_dir, "conversations"), place(spark, "topics")
    words = c.select("conv_id", "turn", F.split("text", " ").alias("words"))
    users = c.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    found = {"absolute_documents": words, "weighted_documents": words, "matches": c.select("conv_id").distinct(), "users": users}
    settings = {"month": 3, "year": 2017, "platform": "telegram"}
    sinks.topic_inputs(found, path, settings)
    return sources.topic_inputs(spark, path, settings)["absolute_documents"]


@query("s06_theme_inputs", f"WITH {ROWS} SELECT period, pair_key, labels, keywords FROM th")
def theme_inputs(spark, sf_dir):
    """Months that are written one by one; a month that is written again is replaced."""
    t, path = themes(spark, sf_dir).select("period", "pair_key", "labels", "keywords"), place(spark, "themes")
    for period in [f"2017-{m:02d}" for m in (1, 2, 3, 4, 5, 6, 2)]:
        sinks.theme_inputs(t.where(F.col("period") == period).drop("period"), path, period)
    return sources.theme_inputs(spark, path).select("period", "pair_key", "labels", "keywords")


@query("s09_pages", """WITH e AS (SELECT 0 AS table_number, s_name AS name FROM supplier UNION ALL SELECT 1, c_name FROM customer)
SELECT name, (SELECT count(*) FROM e) AS total FROM e ORDER BY table_number, name LIMIT 40 OFFSET 80""")
def pages(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return sources.pages([s, c], ["name"], 80, 40).select("name", "total")


@query("s11_verified_read", "SELECT 'customer' AS artifact, 'ok' AS status, count(*) AS n FROM customer UNION ALL SELECT 'supplier', 'changed', count(*) FROM supplier UNION ALL SELECT 'part', 'missing', 0")
def verified_read(spark, sf_dir):
    """Files held against their hashes: one table untouched, one written again with other rows, one gone."""
    path = place(spark, "artifacts")
    for name in ("customer", "supplier"):
        sinks.table(table(spark, sf_dir, name).coalesce(1), f"{path}/{name}.parquet")
    manifest = sources.files(spark, path).withColumn("artifact", F.split_part("path", F.lit("."), F.lit(1)))
    told = manifest.withColumn("sha256", F.when(F.col("artifact") == "supplier", F.lit("other")).otherwise(F.col("sha256"))).select("path", "sha256", "byte_size")
    gone = spark.createDataFrame([("part.parquet/part-0", "x", 1)], "path string, sha256 string, byte_size long")
    status = sources.verified(spark, path, told.unionByName(gone)).select(F.split_part("path", F.lit("."), F.lit(1)).alias("artifact"), "status").distinct()
    counts = [spark.read.parquet(f"{path}/{name}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n") for name in ("customer", "supplier")]
    return status.join(counts[0].unionByName(counts[1]), "artifact", "left").select("artifact", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("s11_tree_verified_read", "SELECT 'customer' AS artifact, 'ok' AS status UNION ALL SELECT 'supplier', 'changed' UNION ALL SELECT 'part', 'missing'")
def tree_verified_read(spark, sf_dir):
    """As above by hash trees, which hold for files of any size; the manifest names another hash for the supplier's."""
    path = place(spark, "artifacts")
    for name in ("customer", "supplier"):
        sinks.table(table(spark, sf_dir, name).coalesce(1), f"{path}/{name}.parquet")
    told = sources.tree_hashes(spark, path)
    told = told.withColumn("tree_sha256", F.when(F.col("path").startswith("supplier"), F.lit("other")).otherwise(F.col("tree_sha256")))
    gone = spark.createDataFrame([("part.parquet/part-0", 1, "x")], "path string, byte_size long, tree_sha256 string")
    return sources.verified(spark, path, told.unionByName(gone)).select(F.split_part("path", F.lit("."), F.lit(1)).alias("artifact"), "status").distinct()


@query("s13_run_catalog", "SELECT 'run' || n_nationkey % 20 AS run_id, 'completed' AS status, any_value('2017-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0')) AS created_at FROM nation GROUP BY 1, 2 HAVING count(*) = 1")
def run_catalog(spark, sf_dir):
    """A manifest for each nation; run ids that two of them claim are left out."""
    path = place(spark, "runs")
    key = F.col("n_nationkey")
    body = F.to_json(F.struct(F.concat(F.lit("run"), key % 20).alias("run_id"), F.lit("completed").alias("status"), F.concat(F.lit("2017-01-"), F.lpad((key + 1).cast("string"), 2, "0")).alias("created_at")))
    table(spark, sf_dir, "nation").select(body.alias("value"), key.alias("run")).repartition("run").write.partitionBy("run").text(path)
    return sources.run_catalog(spark, f"{path}/*/*").select("run_id", "status", "created_at")


def _branches(spark, sf_dir, author: str, other: str):
    """Two branches on the message's own time, each a filter and projection, united without repeats."""
    start = F.make_date(F.lit(1996), F.lit(2), F.lit(1))
    w = messages(spark, sf_dir).where((F.col("created_at") >= start) & (F.col("created_at") < F.add_months(start, 1)))
    branch = lambda c, r: w.select(F.col("unique_id").alias("message_id"), F.col(c).alias("user_id"), F.lit(r).alias("relation"))
    return branch("from_id", author).union(branch("forwarder_id", other)).distinct()


_EXPORT = f"WITH {MESSAGES}, w AS (SELECT * FROM n WHERE created_at >= TIMESTAMP '1996-02-01' AND created_at < TIMESTAMP '1996-03-01') SELECT unique_id AS message_id, from_id AS user_id, '%s' AS relation FROM w UNION SELECT unique_id, forwarder_id, '%s' FROM w"
query("s15_retweet_export", _EXPORT % ("TWEETED", "RETWEETED_BY"))(partial(_branches, author="TWEETED", other="RETWEETED_BY"))
query("s16_reply_export", _EXPORT % ("REPLIED_TO", "REPLIED_BY"))(partial(_branches, author="REPLIED_TO", other="REPLIED_BY"))


@query("s22_json_lines", "SELECT c_custkey, c_name, c_nationkey::INT AS c_nationkey FROM customer")
def json_lines(spark, sf_dir):
    path = place(spark, "lines")
    rows = table(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("value"))
    rows.withColumn("value", F.explode(F.array("value", F.lit("")))).write.text(path)  # a blank line after each
    return sources.json_lines(spark, path, "c_custkey long, c_name string, c_nationkey int")


@query("k02_interaction_sink", f"WITH {KEPT} SELECT 'twitter' AS data_type, 'reply' AS content_type, 2017 AS year, 1 + source::INT % 3 AS month, source, target, total_post, shared_post, weighted_post FROM k WHERE source % 3 = 1")
def interaction_sink(spark, sf_dir):
    """Edges of three months; the month that is asked for is all that is read back."""
    e = kept(spark, sf_dir).withColumns({"data_type": F.lit("twitter"), "content_type": F.lit("reply"), "year": F.lit(2017), "month": (F.col("source") % 3 + 1).cast("int")})
    path = place(spark, "interactions")
    sinks.interactions(e, path)
    columns = ["data_type", "content_type", "year", "month", "source", "target", "total_post", "shared_post", "weighted_post"]
    return spark.read.parquet(path).where("month = 2").select(*columns)


@query("k05_embedding_sink", "SELECT vec_id, label, len(embedding)::INT AS dimensions FROM embeddings")
def embedding_sink(spark, sf_dir):
    path = place(spark, "vectors")
    sinks.embeddings(table(spark, sf_dir, "embeddings"), path, "vec_id")
    return spark.read.parquet(path).select("vec_id", "label", F.size("embedding").alias("dimensions"))


@query("k09_run_publication", f"WITH {KEPT} SELECT 'edges' AS key, count(*) AS n_rows, 'source,target,total_post,shared_post,weighted_post' AS columns, 'completed' AS status FROM k UNION ALL SELECT 'customers', count(*), 'c_custkey,c_name', 'completed' FROM customer")
def run_publication(spark, sf_dir):
    path = place(spark, "run")
    edges = kept(spark, sf_dir).select("source", "target", "total_post", "shared_post", "weighted_post")
    told = sinks.bundle({"edges": edges, "customers": table(spark, sf_dir, "customer").select("c_custkey", "c_name")}, path, "r1", "2017-03-01")
    status = spark.read.text(f"{path}/manifest").select(F.from_json("value", "status string").alias("m")).select("m.status")
    return told.select("key", "n_rows", "columns").crossJoin(status)


@query("k10_stage_cache", f"WITH {KEPT} SELECT source, target, shared_post FROM k")
def stage_cache(spark, sf_dir):
    """A stage that is built once and restored, with its digest checked, the second time."""
    folder = place(spark, "cache")
    build = lambda: kept(spark, sf_dir).select("source", "target", "shared_post")
    sinks.cached(spark, folder, {"stage": "edges", "least": [5, 2]}, build)
    return sinks.cached(spark, folder, {"stage": "edges", "least": [5, 2]}, lambda: build().where("false"))


@query("k11_artifact_index", "SELECT artifact, missing, status, has_rows FROM (VALUES ('customer', '', 'ok', true), ('orders', 'o_nothing', 'incomplete', true), ('part', 'p_partkey,p_name', 'missing', false)) AS t(artifact, missing, status, has_rows)")
def artifact_index(spark, sf_dir):
    """What a contract asks for against what two written tables hold."""
    path = place(spark, "index")
    for name in ("customer", "orders"):
        sinks.table(table(spark, sf_dir, name), f"{path}/{name}.parquet")
    found = sources.artifact_index(spark, path, {"customer": ("c_custkey",), "orders": ("o_orderkey", "o_nothing"), "part": ("p_partkey", "p_name")})
    return found.select("artifact", "missing", "status", ((F.col("n_files") > 0) & (F.col("byte_size") > 0)).alias("has_rows"))


@query("p17_tree_normalization", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal::DOUBLE END AS balance, CASE WHEN c_custkey % 2 = 0 THEN [c_custkey::VARCHAR, c_name] ELSE [c_name] END AS cells FROM customer")
def tree_normalization(spark, sf_dir):
    """NaN as null, and cells that look like lists as lists."""
    key = F.col("c_custkey")
    cell = F.when(key % 2 == 0, F.concat(F.lit("['"), key, F.lit("', '"), F.col("c_name"), F.lit("']"))).otherwise(F.col("c_name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal").cast("double")).alias("balance"), cell.alias("cell"))
    return c.select("c_custkey", F.nanvl("balance", F.lit(None).cast("double")).alias("balance"), T.parsed_list(F.col("cell")).alias("cells"))
