"""Queries over texts: documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators.topics import too_frequent
from kinweave.registry import query, table
from kinweave.scratch import materialize

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
#: The steps of ``functions.text.clean`` as SQL writes them.
_STEPS = (("@[^ ]+", " "), ("https?://[A-Za-z0-9./]+", " "), ("https?:\\S+", " "), ("#", " "), ("www\\S+", " "), ("[/(){}\\[\\]|@,;.]", " "), ("[À-ÖØ-öø-ɏ]", "_"), ("\\b(?:(?:ah)+a?|(?:ha)+|(?:ja)+)\\b", " "), ("[^a-z A-Z]", ""))


def _clean_sql(column: str) -> str:
    x = f"lower({column})"
    for pattern, by in _STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split_regex({x}, ' +'), lambda w: w <> '' AND NOT list_contains({STOP}, w))"


@query("f01_clean_text", f"WITH c AS (SELECT doc_id, {_clean_sql('text')} AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x, i: i = 1 OR w[i - 1] <> x), ' ') AS cleaned FROM c")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query("f07_tokenize", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::INT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))::INT AS n_distinct FROM documents")
def tokenize(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.lower("text")))).alias("n_distinct"))


@query("f03_emoji", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN '😀 ' || text || ' ⚽️' ELSE text END, '[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}\\x{20E3}]', ' ', 'g'), ' {2,}', ' ', 'g'), ' ') AS plain FROM conversations")
def emoji(spark, sf_dir):
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("😀 "), F.col("text"), F.lit(" ⚽️"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_emoji(x).alias("plain"))


@query("f09_bigrams", """WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents), t AS (SELECT doc_id, list_filter(w, lambda x: length(x) > 2) AS t FROM w),
u AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM t) GROUP BY 1), v AS (SELECT count(*) AS v FROM u),
b AS (SELECT a, b, count(*) AS n FROM (SELECT t[i] AS a, t[i + 1] AS b FROM t, unnest(generate_series(1, len(t) - 1)) AS g(i) WHERE len(t) > 1) GROUP BY 1, 2)
SELECT b.a, b.b, b.n, round((b.n - 5)::DOUBLE * v / (x.n * y.n), 6) AS score FROM b JOIN u x ON x.word = b.a JOIN u y ON y.word = b.b, v WHERE b.n >= 5 AND (b.n - 5)::DOUBLE * v / (x.n * y.n) > 10""")
def bigrams(spark, sf_dir):
    """Pairs of neighbours that score over 10: (n_ab - 5) * vocabulary / (n_a * n_b)."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 2)
    docs = table(spark, sf_dir, "documents").select(words.alias("t"))
    unigrams = materialize(docs.select(F.explode("t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "unigrams")
    size = unigrams.agg(F.count(F.lit(1)).alias("v"))
    both = F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))
    each, frequent = docs.select(F.explode(both).alias("p")), F.broadcast(materialize(too_frequent(unigrams, "word", "n", 10.0), "frequent"))
    for end in ("p.a", "p.b"):
        each = each.join(frequent, F.col(end) == F.col("word"), "left_anti")
    pairs = each.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    scored = pairs.join(unigrams.toDF("a", "na"), "a").join(unigrams.toDF("b", "nb"), "b").crossJoin(F.broadcast(size))
    score = (F.col("n") - 5) * F.col("v") / (F.col("na") * F.col("nb"))
    return scored.where(score > 10).select("a", "b", "n", F.round(score, 6).alias("score"))


@query("f10_display_text", "SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS shown, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ')) AS label FROM conversations")
def display_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.display(F.col("text")).alias("shown"), T.label_key(F.col("text")).alias("label"))


@query("f12_username_fill", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN c_name END), ''), 'anonymous' || c_custkey) AS username FROM customer")
def username_fill(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", T.filled_name(F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.col("c_name")), k).alias("username"))


@query("f13_datetime_rewrite", "SELECT event_id, regexp_replace('{''at'': neo4j.time.DateTime(' || year(ts) || ', ' || month(ts) || ', ' || day(ts) || ')}', 'neo4j\\.time\\.DateTime\\(([^)]*)\\)', '(\\1)', 'g') AS node FROM events")
def datetime_rewrite(spark, sf_dir):
    raw = F.format_string("{'at': neo4j.time.DateTime(%d, %d, %d)}", F.year("ts"), F.month("ts"), F.dayofmonth("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace(raw, r"neo4j\.time\.DateTime\(([^)]*)\)", "($1)").alias("node"))


@query("f14_legacy_multi_theme", """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Trade News.Local Food' WHEN p_partkey % 3 = 1 THEN 'v1.Two words' ELSE p_name END AS name FROM part)
SELECT p_partkey, len(x) >= 2 AND len(list_filter(x, lambda p: len(string_split_regex(trim(p), '\\s+')) > 1)) >= 2 AS several FROM (SELECT p_partkey, string_split(regexp_replace(name, '\\.([A-Z][A-Za-z])', chr(31) || '\\1', 'g'), chr(31)) AS x FROM n)""")
def legacy_multi_theme(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "Trade News.Local Food").when(k == 1, "v1.Two words").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.legacy_multi_theme(name).alias("several"))


@query("f15_keyword_normalize", """WITH k AS (SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' ' || upper(p_name) || '  ' || p_type, ' '), lambda w: trim(w)), lambda w: w <> '') AS w FROM part)
SELECT p_partkey, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS keywords FROM k""")
def keyword_normalize(spark, sf_dir):
    words = F.split(F.concat("p_name", F.lit(" "), F.upper("p_name"), F.lit("  "), F.col("p_type")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", T.distinct_keywords(words).alias("keywords"))


@query("f16_stable_ids", "SELECT p_partkey, 'mc_' || left(sha256(concat_ws('|', p_brand, p_type)), 16) AS cluster_id FROM part")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_id("mc_", F.col("p_brand"), F.col("p_type")).alias("cluster_id"))


@query("f17_embedding_key", "SELECT doc_id, 'emb_' || sha256('minilm|384|' || sha256(text)) AS embedding_key FROM documents")
def embedding_key(spark, sf_dir):
    inner = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("emb_"), F.sha2(F.concat(F.lit("minilm|384|"), inner).cast("binary"), 256)).alias("embedding_key"))


@query("f19_token_estimate", "SELECT doc_id, greatest(1, (length(text) + 3) // 4)::INT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("f05_strip_html", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '<>', 'g') AS x FROM pages),
b AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(x, '<[^>]*>'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'), ' ')), lambda p: p <> ''), '') AS t FROM a)
SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS plain FROM b""")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("d01_day_of_month", "SELECT event_id, day(ts)::INT AS day_number FROM events")
def day_of_month(spark, sf_dir):
    as_tuple = F.format_string("(%d, %d, %d, 0)", F.year("ts"), F.month("ts"), F.dayofmonth("ts"))
    text = F.when(F.col("event_id") % 2 == 0, as_tuple).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", T.day_of(text).alias("day_number"))


@query("d05_period", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, month(o_orderdate)::INT AS month_number FROM orders")
def period(spark, sf_dir):
    d = F.col("o_orderdate")
    month = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "MMMM")).otherwise(F.month(d).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.period(F.year(d), month).alias("period"), T.month_number(month).alias("month_number"))


@query("d03_period_bounds", "SELECT strftime(o_orderdate, '%Y-%m') AS period, date_trunc('month', min(o_orderdate))::DATE AS first_day, last_day(min(o_orderdate)) AS last_day, (date_trunc('month', min(o_orderdate)) + INTERVAL 1 MONTH)::DATE AS next_month FROM orders GROUP BY 1")
def period_bounds(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.to_date(F.date_trunc("month", F.min("o_orderdate"))).alias("first_day"))
    return p.select("period", "first_day", F.last_day("first_day").alias("last_day"), F.add_months("first_day", 1).alias("next_month"))


@query("d07_year_of_text", "SELECT doc_id, try_cast(nullif(regexp_extract(source || '_2017_' || doc_id, '(19|20)[0-9][0-9]'), '') AS INT) AS year, regexp_full_match('2017-0' || doc_id % 10, '[0-9]{4}-(0[1-9]|1[0-2])') AS valid_period FROM documents")
def year_of_text(spark, sf_dir):
    text = F.concat("source", F.lit("_2017_"), F.col("doc_id"))
    valid = F.concat(F.lit("2017-0"), F.col("doc_id") % 10).rlike("^[0-9]{4}-(0[1-9]|1[0-2])$")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(text, "(19|20)[0-9][0-9]", 0).try_cast("int").alias("year"), valid.alias("valid_period"))


@query("c01_list_parse", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN list_transform(string_split(p_name, ' '), lambda w: w || 'x') ELSE string_split(p_name, ' ') END AS words FROM part""")
def list_parse(spark, sf_dir):
    words, k = F.split("p_name", " "), F.col("p_partkey") % 3
    literal = F.concat(F.lit("['"), F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("x"))), "', '"), F.lit("']"))
    cell = F.when(k == 0, F.to_json(words)).when(k == 1, literal).otherwise(F.array_join(words, ", "))
    return table(spark, sf_dir, "part").select("p_partkey", T.parsed_list(cell).alias("words"))


@query("j17_message_replacement", """WITH d AS (SELECT DISTINCT text, 't:' || text AS translated FROM conversations WHERE role = 'user')
SELECT conv_id, list(coalesce(d.translated, c.text) ORDER BY turn) AS messages FROM conversations c LEFT JOIN d ON d.text = c.text AND c.turn % 2 = 0 GROUP BY 1""")
def message_replacement(spark, sf_dir):
    """Messages replaced through a table of translations, in order; others stay."""
    c = table(spark, sf_dir, "conversations")
    known = c.where("role = 'user'").select(F.col("text").alias("t"), F.concat(F.lit("t:"), F.col("text")).alias("translated")).distinct()
    joined = c.join(known, (c["text"] == known["t"]) & (c["turn"] % 2 == 0), "left")
    return joined.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("translated", "text").alias("m")))), lambda s: s["m"]).alias("messages"))


@query("x08_translation_plan", """WITH m AS (SELECT DISTINCT text FROM conversations WHERE trim(text) <> ''), e AS (SELECT DISTINCT text FROM conversations WHERE role = 'assistant')
SELECT (SELECT count(*) FROM conversations) AS messages, (SELECT count(*) FROM m) AS distinct_texts, (SELECT count(*) FROM m WHERE text IN (SELECT text FROM e)) AS cached, (SELECT count(*) FROM m WHERE text NOT IN (SELECT text FROM e)) AS missing,
 (SELECT coalesce(sum(length(text)), 0)::BIGINT FROM m WHERE text NOT IN (SELECT text FROM e)) AS characters""")
def translation_plan(spark, sf_dir):
    """What a translation run would send: distinct texts that a cache doesn't hold."""
    c = table(spark, sf_dir, "conversations")
    texts = c.where("trim(text) <> ''").select("text").distinct()
    cache = c.where("role = 'assistant'").select("text", F.lit(True).alias("hit")).distinct()
    looked = texts.join(cache, "text", "left")
    plan = looked.agg(F.count(F.lit(1)).alias("distinct_texts"), F.count_if("hit").alias("cached"), F.count_if(F.col("hit").isNull()).alias("missing"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.length("text"))), F.lit(0)).alias("characters"))
    return c.agg(F.count(F.lit(1)).alias("messages")).crossJoin(plan)


@query("u07_unique_texts", "SELECT text, sha256(text) AS hash, row_number() OVER (PARTITION BY left(sha256(text), 1) ORDER BY sha256(text), text) AS place FROM (SELECT DISTINCT text FROM conversations)")
def unique_texts(spark, sf_dir):
    h = F.sha2(F.col("text").cast("binary"), 256)
    d = table(spark, sf_dir, "conversations").select("text").distinct().withColumn("hash", h)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(F.substring("hash", 1, 1)).orderBy("hash", "text")))


@query("j01_reply_edges", "SELECT conv_id, turn, role AS replier, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS replied_to FROM conversations QUALIFY replied_to IS NOT NULL AND replied_to <> replier")
def reply_edges(spark, sf_dir):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("replier"), before.alias("replied_to")).where("replied_to <> replier")
