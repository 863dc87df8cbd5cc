"""Queries of semi-structured cells, provenance and what combines the other operators."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators import network as net
from kinweave.operators import topics
from kinweave.operators import vectors as vec
from kinweave.operators.ordering import numbered
from kinweave.plans.network import KEPT, kept, nodes
from kinweave.plans.themes import ROWS, dominant, observations, themes
from kinweave.plans.vectors import CENTROID, UNIT, _dot, vectors
from kinweave.registry import query, table


def normalized(df, key: str, text: str, form: str = "NFKD"):
    """key and the text in a Unicode normal form, for which Spark has no function; ASCII texts stay as they are."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # a few texts at a time, whatever their length
                batch = whole.slice(at, 64)
                plain = pc.fill_null(pc.string_is_ascii(batch.column(1)), True)
                others = [unicodedata.normalize(form, t) for t in batch.column(1).filter(pc.invert(plain)).to_pylist()]
                done = pc.replace_with_mask(batch.column(1), pc.invert(plain), pa.array(others, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), done], names=[key, "normalized"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, normalized string")


@query("f04_normalize_unicode", "SELECT doc_id, nfc_normalize(text) AS normalized FROM documents")
def normalize_unicode(spark, sf_dir):
    """NFC, which SQL has as well; NFKD and the other forms differ by the parameter."""
    return normalized(table(spark, sf_dir, "documents"), "doc_id", "text", "NFC")


@query("f04_normalize_compatible")
def normalize_compatible(spark, sf_dir):
    return normalized(table(spark, sf_dir, "documents"), "doc_id", "text", "NFKD")


@query("f06_document_build", "SELECT conv_id, array_to_string(list(s ORDER BY turn), '.') AS document FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS s FROM conversations) WHERE s <> '' GROUP BY 1")
def document_build(spark, sf_dir):
    """Each conversation's messages, blank ones dropped, joined with full stops."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.display(F.col("text")).alias("s")).where("s <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"])
    return m.groupBy("conv_id").agg(F.array_join(ordered, ".").alias("document"))


@query("f02_stopwords", f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE list_contains([{', '.join(repr(w) for w in T.STOPWORDS)}], word) GROUP BY 1")
def stopwords(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where(F.col("word").isin(*T.STOPWORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("f18_cache_keys", "SELECT DISTINCT sha256(sha256(text) || '|provider|en|v1') AS translation_key, sha256(sha256(text) || '|v1') AS detection_key FROM conversations")
def cache_keys(spark, sf_dir):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    inner = sha(F.col("text"))
    return table(spark, sf_dir, "conversations").select(sha(F.concat(inner, F.lit("|provider|en|v1"))).alias("translation_key"), sha(F.concat(inner, F.lit("|v1"))).alias("detection_key")).distinct()


@query("c04_theme_map_parse", """SELECT p_partkey, p_brand AS theme, string_split(p_name, ' ') AS keywords FROM part
UNION ALL SELECT p_partkey, p_type, ['second'] FROM part WHERE p_partkey % 2 = 1""")
def theme_map_parse(spark, sf_dir):
    """A map cell as text, parsed; every other cell has its key twice, and the first counts."""
    again = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    cell = F.concat(F.lit('{"'), F.col("p_brand"), F.lit('": '), F.to_json(F.split("p_name", " ")), F.lit(', "'), again, F.lit('": ["second"]}'))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.first_entries(cell)).alias("x")).select("p_partkey", F.col("x.key").alias("theme"), F.col("x.words").alias("keywords"))


@query("c05_general_theme_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type] ELSE [p_brand || ', ' || p_type] END AS names FROM part")
def general_names(spark, sf_dir):
    """A list cell is a list; any other cell is one name, commas included."""
    cell = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.concat_ws(", ", "p_brand", "p_type"))
    names = F.when(cell.startswith("["), F.from_json(cell, "array<string>")).otherwise(F.array(cell))
    return table(spark, sf_dir, "part").select("p_partkey", names.alias("names"))


@query("c06_theme_reconciliation", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ambiguous' ELSE 'mapped' END AS state, CASE WHEN p_partkey % 4 <> 0 THEN len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) END::INT AS n_keywords FROM part")
def reconciliation(spark, sf_dir):
    """The name text must be the map's keys joined by full stops; else the row is ambiguous and left out."""
    m = F.create_map(F.col("p_brand"), F.split("p_name", " "), F.col("p_type"), F.split("p_type", " "))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat_ws(".", "p_type", "p_brand")).otherwise(F.concat_ws(".", "p_brand", "p_type"))
    fits = F.array_join(F.map_keys("m"), ".") == F.col("name")
    t = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), name.alias("name"))
    return t.select("p_partkey", F.when(fits, "mapped").otherwise("ambiguous").alias("state"), F.when(fits, F.size(F.flatten(F.map_values("m")))).alias("n_keywords"))


@query("c07_trend_entries", f"WITH {ROWS} SELECT seq, CASE WHEN len(labels) > 0 THEN labels ELSE list_sort(list_distinct(keywords)) END AS entries FROM th")
def trend_entries(spark, sf_dir):
    return themes(spark, sf_dir).select("seq", F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array_sort(F.array_distinct("keywords"))).alias("entries"))


@query("c09_indexed_payload", "SELECT p_partkey, list_transform(list_filter(list_distinct([1 + p_size % 3, 2, 9, 1 + p_size % 3]), lambda i: i <= len(string_split(p_name, ' '))).list_sort(), lambda i: string_split(p_name, ' ')[i]) AS chosen FROM part")
def indexed_payload(spark, sf_dir):
    """Keyword numbers of a payload: repeats and numbers out of range go."""
    words = F.split("p_name", " ")
    numbers = F.array_sort(F.array_distinct(F.array(F.col("p_size") % 3 + 1, F.lit(2), F.lit(9), F.col("p_size") % 3 + 1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.transform(F.filter(numbers, lambda i: (i >= 1) & (i <= F.size(words))), lambda i: F.get(words, i - 1)).alias("chosen"))


@query("c11_json_structs", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_structs(spark, sf_dir):
    """A struct written as JSON text and read back."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))).alias("j"))
    return s.select("event_type", F.from_json("j", "n bigint, mean double").alias("s")).select("event_type", "s.n", "s.mean")


@query("c13_node_dict_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE 'm' || event_id END AS message_id, user_id::VARCHAR AS from_id FROM events")
def node_dict(spark, sf_dir):
    """Quoted node cells: the message id is the first of several fields that isn't blank."""
    own = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), F.col("event_id")))
    cell = F.concat(F.lit("{'unique_id': '"), own, F.lit("', 'from_id': '"), F.col("user_id"), F.lit("'}"))
    node = table(spark, sf_dir, "events").select("event_id", F.from_json(cell, "unique_id string, id string, from_id string", {"allowSingleQuotes": "true"}).alias("n"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return node.select("event_id", F.coalesce(blank("n.unique_id"), blank("n.id"), blank("n.from_id")).alias("message_id"), "n.from_id")


@query("c14_edge_shapes", "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'PRODUCED' WHEN 'view' THEN 'FORWARDED_BY' WHEN 'purchase' THEN 'REPLIED_TO' END AS relation FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def edge_shapes(spark, sf_dir):
    """Allowed relations through a mapping table of a few rows."""
    allowed = spark.sql("SELECT * FROM VALUES ('click', 'PRODUCED'), ('view', 'FORWARDED_BY'), ('purchase', 'REPLIED_TO') AS t(event_type, relation)")
    return table(spark, sf_dir, "events").join(F.broadcast(allowed), "event_type").select("event_id", "event_type", "relation")


@query("t10_month_order", "SELECT monthname(o_orderdate) AS month_name, month(min(o_orderdate))::INT AS place, count(*) AS n FROM orders GROUP BY 1")
def month_order(spark, sf_dir):
    name = F.date_format("o_orderdate", "MMMM")
    return table(spark, sf_dir, "orders").groupBy(name.alias("month_name")).agg(F.count(F.lit(1)).alias("n")).select("month_name", T.month_number(F.col("month_name")).alias("place"), "n")


@query("t11_final_row", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def final_row(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(last.alias("x")).select("event_type", "x.event_id", "x.value")


@query("a18_dominant_families", f"WITH {ROWS}, c AS (SELECT upper(label) AS label, period, count(DISTINCT pair_key) AS n FROM ob GROUP BY 1, 2) SELECT label, sum(n)::BIGINT AS total, count(*) AS months_present, arg_min(period, (-n, period)) AS peak_period, max(n) AS peak FROM c GROUP BY 1")
def dominant_families(spark, sf_dir):
    return dominant(observations(spark, sf_dir).withColumn("label", F.upper("label")), None)


@query("a33_quality_over_periods", f"WITH {ROWS}, c AS (SELECT period, label, count(*) AS n FROM ob GROUP BY 1, 2), p AS (SELECT period, count(*) AS clusters, max(n)::DOUBLE / sum(n) AS share, avg(n) AS size FROM c GROUP BY 1) SELECT count(*) AS periods, max(clusters) AS most, round(avg(share), 9) AS mean_share, round(max(share), 9) AS max_share, round(avg(size), 9) AS mean_size FROM p")
def quality_over_periods(spark, sf_dir):
    c = observations(spark, sf_dir).groupBy("period", "label").agg(F.count(F.lit(1)).alias("n"))
    p = c.groupBy("period").agg(F.count(F.lit(1)).alias("clusters"), (F.max("n") / F.sum("n")).alias("share"), F.avg("n").alias("size"))
    return p.agg(F.count(F.lit(1)).alias("periods"), F.max("clusters").alias("most"), F.round(F.avg("share"), 9).alias("mean_share"), F.round(F.max("share"), 9).alias("max_share"), F.round(F.avg("size"), 9).alias("mean_size"))


@query("m07_monthly_clusters", f"WITH {CENTROID}, s AS (SELECT u.label, vec_id, round({_dot('u', 'centroid')}, 12) AS score FROM u JOIN ce USING (label)), m AS (SELECT label, vec_id AS medoid FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1), z AS (SELECT label, count(*) AS size, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM embeddings GROUP BY 1) SELECT label, medoid, size, 'mc_' || left(sha256(members), 16) AS cluster_id FROM m JOIN z USING (label)")
def monthly_clusters(spark, sf_dir):
    """Each cluster's medoid, size and an id that its sorted members determine."""
    v = vectors(spark, sf_dir)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",")
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.concat(F.lit("mc_"), F.substring(F.sha2(ids.cast("binary"), 256), 1, 16)).alias("cluster_id"))
    return vec.medoids(v, "label", "vec_id", "embedding").select("label", "medoid").join(sizes, "label").select("label", "medoid", "size", "cluster_id")


@query("m08_representative_vectors", f"WITH {CENTROID}, s AS (SELECT u.label, vec_id, u, round({_dot('u', 'centroid')}, 12) AS score FROM u JOIN ce USING (label)) SELECT label, vec_id AS medoid, round(u[1], 9) AS first FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def representatives(spark, sf_dir):
    from kinweave.functions import vectors as V

    v = vectors(spark, sf_dir)
    unit = v.select(F.col("vec_id").alias("medoid"), V.unit(F.col("embedding")).alias("u"))
    return vec.medoids(v, "label", "vec_id", "embedding").join(unit, "medoid").select("label", "medoid", F.round(F.get("u", F.lit(0)), 9).alias("first"))


@query("j15_representative_required", f"WITH {UNIT} SELECT count(*) AS labels, count(*) FILTER (vec_id IS NULL) AS missing FROM (SELECT label, min(vec_id) AS chosen FROM embeddings GROUP BY 1) l LEFT JOIN (SELECT vec_id FROM u WHERE vec_id % 3 > 0) r ON chosen = vec_id")
def representative_required(spark, sf_dir):
    """Each cluster's representative against the vectors that were recorded: two of three, so that some are missing."""
    v = vectors(spark, sf_dir)
    chosen = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    recorded = v.where("vec_id % 3 > 0").select("vec_id", F.lit(True).alias("there"))
    return chosen.join(recorded, "vec_id", "left").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("j15_recorded_embedding", f"WITH {UNIT} SELECT l.label, vec_id, round(u[1], 9) AS first FROM (SELECT label, min(vec_id) AS vec_id FROM u GROUP BY 1) l JOIN u USING (vec_id)")
def recorded_embedding(spark, sf_dir):
    """Each cluster's representative with its recorded vector, where a missing one is an error."""
    from kinweave.functions import vectors as V
    from kinweave.operators import review

    v = vectors(spark, sf_dir)
    unit = v.select("vec_id", F.round(F.get(V.unit(F.col("embedding")), F.lit(0)), 9).alias("first"))
    return review.recorded(v.groupBy("label").agg(F.min("vec_id").alias("vec_id")), unit, "vec_id").select("label", "vec_id", "first")


@query("m15_deduplicated_inference", "WITH t AS (SELECT text, length(text) AS n, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words FROM (SELECT DISTINCT text FROM conversations)) SELECT conv_id, turn, [n::DOUBLE, words::DOUBLE] AS vector FROM conversations JOIN t USING (text)")
def inference(spark, sf_dir):
    """One call for each distinct text, in Arrow batches; the vectors are joined back to every row that has it."""
    c = table(spark, sf_dir, "conversations")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(vector=[[float(len(t)), float(len([w for w in t.split(" ") if w]))] for t in pdf["text"]])

    found = c.select("text").distinct().mapInPandas(run, "text string, vector array<double>")
    return c.join(found, "text").select("conv_id", "turn", "vector")


@query("m02_bigram_topics")
def bigram_topics(spark, sf_dir):
    """Topics over words and the phrases of two and of three words."""
    words = F.filter(F.split(T.clean(F.col("text")), " "), lambda w: F.length(w) > 2)
    d = topics.with_phrases(table(spark, sf_dir, "documents").select("doc_id", words.alias("words")))
    return topics.dominant(topics.fit(d))


@query("m03_topic_scores")
def topic_scores(spark, sf_dir):
    """The negative log likelihood a word, and the coherence of the topics' first words, one row."""
    words = F.filter(F.split(T.clean(F.col("text")), " "), lambda w: F.length(w) > 2)
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    model = topics.fit(d)
    coherent = topics.coherence(d, topics.keywords(model, 20)).agg(F.avg("coherence").alias("coherence"))
    return coherent.select(F.lit(-model.likelihood[-1]).alias("log_perplexity"), "coherence", F.lit(model.vocabulary).alias("vocabulary"))


@query("g11_circular_layout", f"WITH {KEPT}, v AS (SELECT source AS node FROM k UNION SELECT target FROM k), p AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM v) SELECT node, round(cos(2 * pi() * i / n), 6) + 0.0 AS x, round(sin(2 * pi() * i / n), 6) + 0.0 AS y FROM p")
def layout(spark, sf_dir):
    """All nodes on a circle in order."""
    place = numbered(nodes(spark, sf_dir), "node", name="i")
    n = place.agg(F.count(F.lit(1)).alias("n"))  # one row
    angle = 2 * F.pi() * F.col("i") / F.col("n")
    return place.crossJoin(F.broadcast(n)).select("node", (F.round(F.cos(angle), 6) + 0.0).alias("x"), (F.round(F.sin(angle), 6) + 0.0).alias("y"))


@query("g11_force_layout")
def force_layout(spark, sf_dir):
    return net.force_layout(kept(spark, sf_dir).select("source", "target", F.col("weighted_post").alias("weight")))


@query("v08_rounded_ratios", f"WITH {ROWS} SELECT period, round(count(DISTINCT pair_key)::DOUBLE / count(*), 6) AS ratio, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ob), 6) AS percent FROM ob GROUP BY 1")
def ratios(spark, sf_dir):
    o = observations(spark, sf_dir)
    per = o.groupBy("period").agg(F.count_distinct("pair_key").alias("p"), F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("t")))).select("period", F.round(F.col("p") / F.col("n"), 6).alias("ratio"), F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent"))
