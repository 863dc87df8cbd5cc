"""Queries of theme generation with mock providers, and of frozen benchmark data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.operators import generation as gen
from kinweave.plans.bench import STRATA, _strata
from kinweave.registry import query, table


def strict(payload: str) -> str:
    """A mock that declines some payloads and is out of reach for others, by their length."""
    if len(payload) % 11 == 0:
        raise gen.Refused
    if len(payload) % 4 == 0:
        raise gen.Unavailable
    return payload.split(" ")[0].upper()


def plain(payload: str) -> str:
    """A mock that answers most of what the other couldn't."""
    if len(payload) % 8 == 0:
        raise gen.Unavailable
    return payload.split(" ")[-1]


PROVIDERS = [("strict", strict), ("plain", plain)]
ASKED = """pl AS (SELECT DISTINCT p_name AS payload FROM part), aw AS (SELECT payload, sha256('v1|' || payload) AS request,
CASE WHEN length(payload) % 11 = 0 THEN NULL WHEN length(payload) % 4 > 0 THEN upper(string_split(payload, ' ')[1]) WHEN length(payload) % 8 > 0 THEN string_split(payload, ' ')[-1] END AS answer,
CASE WHEN length(payload) % 11 = 0 THEN 'refused' WHEN length(payload) % 8 = 0 THEN 'failed' ELSE 'answered' END AS outcome,
CASE WHEN length(payload) % 11 = 0 OR length(payload) % 4 > 0 THEN 'strict' WHEN length(payload) % 8 > 0 THEN 'plain' END AS provider,
CASE WHEN length(payload) % 11 = 0 OR length(payload) % 4 > 0 THEN 1 ELSE 2 END AS attempts FROM pl)"""


def payloads(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("payload"))


@query("x02_fan_out", f"WITH {ASKED} SELECT p_partkey, answer, outcome, provider FROM part JOIN aw ON payload = p_name")
def fan_out(spark, sf_dir):
    """Each different payload is asked once; what comes of it goes to every row that has it."""
    p = payloads(spark, sf_dir)
    return gen.theme_rows(p, "payload", gen.answered(p, PROVIDERS)).select("p_partkey", "answer", "outcome", "provider")


@query("x04_fallback_routing", f"WITH {ASKED} SELECT outcome, provider, attempts, count(*) AS n FROM aw GROUP BY ALL")
def fallback(spark, sf_dir):
    return gen.answered(payloads(spark, sf_dir), PROVIDERS).groupBy("outcome", "provider", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query("b06_run_with_cache", f"WITH {ASKED}, old AS (SELECT DISTINCT p_name AS payload FROM part WHERE p_partkey % 3 = 0) SELECT request, answer, outcome, outcome <> 'failed' AND payload IN (SELECT payload FROM old) AS hit FROM aw")
def run_with_cache(spark, sf_dir):
    """A run after one that recorded a third of the parts: what failed then is asked again."""
    p = payloads(spark, sf_dir)
    cache = gen.answered(p.where("p_partkey % 3 = 0"), PROVIDERS)
    return gen.run_with_cache(p, cache, PROVIDERS).select("request", "answer", "outcome", "hit")


FROZEN = f"""{STRATA}, t AS (SELECT s.doc_id, s.lang, sha256(coalesce(text, '')) AS text_sha256 FROM s JOIN documents USING (doc_id) ORDER BY round, s.lang LIMIT 100),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('split' || doc_id), doc_id) AS n FROM t), fr AS (SELECT doc_id, lang, text_sha256, CASE WHEN n <= 20 THEN 'development' WHEN n <= 50 THEN 'pilot' ELSE 'heldout' END AS split FROM o)"""


def frozen(spark, sf_dir):
    """The examples of a frozen data set: chosen, split and hashed (100 rows)."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    chosen = _strata(spark, sf_dir).orderBy("round", "lang").limit(100).join(text, "doc_id")
    h = F.sha2(F.concat(F.lit("split"), F.col("doc_id")).cast("binary"), 256)
    n = F.row_number().over(Window.orderBy(h, "doc_id"))  # the 100 that were chosen
    return chosen.withColumn("n", n).select("doc_id", "lang", "text_sha256", F.when(F.col("n") <= 20, "development").when(F.col("n") <= 50, "pilot").otherwise("heldout").alias("split"))


@query("b03_frozen_dataset", f"WITH {FROZEN} SELECT split, count(*) AS examples, sha256(string_agg(doc_id || ':' || text_sha256, ',' ORDER BY doc_id)) AS sha256 FROM fr GROUP BY 1")
def frozen_dataset(spark, sf_dir):
    """Each split's examples and the hash that freezes it."""
    cell = F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", cell.alias("c")))), lambda x: x["c"]), ",")
    return frozen(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("examples"), F.sha2(joined.cast("binary"), 256).alias("sha256"))


@query("b04_frozen_integrity", f"""WITH {FROZEN}, g AS (SELECT doc_id, split, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text_sha256 END AS told FROM fr WHERE doc_id % 13 > 0)
SELECT count(*) AS told, count(*) FILTER (told <> text_sha256) AS changed, (SELECT count(*) FROM fr) - count(*) AS missing, count(*) FILTER (g.split NOT IN ('development', 'pilot', 'heldout')) AS unknown_split FROM g JOIN fr USING (doc_id)""")
def frozen_integrity(spark, sf_dir):
    """A manifest that lacks some examples and has the wrong hash for others, held against the data set."""
    f = frozen(spark, sf_dir)
    told = f.where("doc_id % 13 > 0").select("doc_id", F.col("split").alias("told_split"), F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text_sha256")).alias("told"))
    j = f.join(told, "doc_id", "left")
    known = F.col("told_split").isin("development", "pilot", "heldout")
    return j.agg(
        F.count("told").alias("told"), F.count_if(F.col("told") != F.col("text_sha256")).alias("changed"), F.count_if(F.col("told").isNull()).alias("missing"), F.count_if(F.col("told").isNotNull() & ~known).alias("unknown_split")
    )
