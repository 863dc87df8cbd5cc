import random
import re
import zlib

import numpy as np
import pytest
from kinweave.llm import common, queries, toxicity
from llm_texts import prose
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
BAD = ["grumfel", "snarkt", "blorgh", "pfui", "wretch"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = prose(rng, rng.randrange(10, 60)).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "!", "$$"]))
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), int(toxic)))
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_like_brute_force(spark, frame, corpus):
    """Terms, frequencies, vectors, neighbours and votes against plain Python over all examples."""
    docs = frame([(r[0], r[1]) for r in corpus])
    taught = [r for r in corpus if r[0] % 3]
    model = toxicity.fit(docs, labels(spark, taught))
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    chi = {}
    for w in {w for _, t, _ in taught for w in split(t)}:
        a = sum(w in split(t) for _, t, y in taught if y)
        n, n1 = sum(w in split(t) for _, t, _ in taught), sum(r[2] for r in taught)
        n0 = len(taught) - n1
        if n >= toxicity.LEAST and n < n0 + n1:
            chi[w] = (n0 + n1) * (a * n0 - (n - a) * n1) ** 2 / (n * (n0 + n1 - n) * n1 * n0)
    words = [w for w in chi if chi[w] >= toxicity.CHI_SQUARE]
    assert set(words) >= set(BAD) and sorted(w.encode() for w in words) == sorted(model.terms.words)
    df = {w: sum(w in split(t) for _, t, _ in corpus) for w in words}

    def vector(t):
        n = {w: split(t).count(w) for w in words}
        v = np.array([(1 + np.log(n[w])) * (np.log((len(corpus) + 1) / (df[w] + 1)) + 1) if n[w] else 0.0 for w in words])
        return v / (np.linalg.norm(v) or 1)

    x, y = np.array([vector(t) for _, t, _ in taught]), np.array([r[2] for r in taught])
    bare = ~x.any(axis=1)
    assert model.prior == pytest.approx((y[bare].sum() + (y.sum() + 1) / (len(y) + 2)) / (bare.sum() + 1))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(found) == len(corpus)
    for i, t, _ in corpus[::3]:
        cos = np.round(x @ vector(t), 9)
        groups = {}
        for c, label, r, v in zip(cos, y, taught, x, strict=True):
            if c > 0:
                groups.setdefault((-c, tuple(np.round(v, 9))), []).append((label, r[0]))
        near = found[i]["similarities"]
        assert near == pytest.approx([-k[0] for k in sorted(groups)][: toxicity.EVIDENCE], abs=1e-8)
        assert all(round(float(vector(t) @ x[[r[0] for r in taught].index(n)]), 8) == round(c, 8) for n, c in zip(found[i]["neighbours"], near, strict=True))
        if not groups:
            assert found[i]["score"] == model.prior


def test_block_max_index_equals_all_pairs():
    rng = np.random.default_rng(4)
    x = np.where(rng.random((900, 40)) < 0.03, 1, 0).astype(float)
    own = rng.integers(0, 10, 900)
    for k in range(4):  # ten kinds of vectors with four terms of their own
        x[np.arange(900), own * 4 + k] += rng.integers(0, 4, 900)
    x = x[x.any(axis=1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(x.T)]
    row, term = np.nonzero(x)
    csr = (np.searchsorted(row, np.arange(len(x) + 1)), term, x[row, term])
    index = toxicity.BlockMax(*csr, 40)
    best, cosine, visited = index.nearest(*csr, 9)
    every = np.round(x @ x.T, 12)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), every.shape), -every), axis=1)[:, :9]
    want = np.take_along_axis(every, order, axis=1)
    np.testing.assert_allclose(cosine, want, atol=1e-9)
    clear = (want > 0) & (np.abs(np.diff(want, axis=1, append=-1)) > 1e-9) & (np.abs(np.diff(want, axis=1, prepend=2)) > 1e-9)
    assert (best == order)[clear].all() and (best[want == 0] == -1).all()
    assert visited < 0.6 * len(x) * index.blocks


def test_isotonic_curve():
    x, y = np.array([0.1, 0.4, 0.4, 0.6, 0.9]), np.array([0.0, 1.0, 0.0, 0.25, 1.0])
    knots = toxicity.isotonic(x, y, np.ones(5))
    assert np.interp([0.1, 0.4, 0.6, 0.9, 1.0], *knots) == pytest.approx([0, 1.25 / 3, 1.25 / 3, 1, 1])


def test_query_on_held_out_rows(spark):
    df = queries.QUERIES["op11_toxicity"](spark, SF)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and [t for _, t in df.dtypes[:4]] == ["bigint", "boolean", "double", "int"]
    known = spark.read.parquet(f"{SF}/labels.parquet")
    found = df.toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out].merge(known.toPandas(), on="doc_id")
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.1
    assert held[held.toxic == 1].score.mean() > 0.8 and abs(held.score.mean() - held.toxic.mean()) < 0.05


def test_odd_rows_labels_and_bounds(spark, frame, odd_rows, corpus):
    docs = frame([*odd_rows, *((r[0] + 100, r[1]) for r in corpus), (None, "pfui snarkt"), (None, "pfui snarkt")])
    bad = labels(spark, [(r[0] + 100, None, r[2]) for r in corpus]).unionByName(spark.createDataFrame([(None, 1), (100, 0), (5, 1), (1, None)], "doc_id bigint, toxic int"))
    model = toxicity.fit(docs, bad, sample=200)
    found = toxicity.score_toxicity(docs, model)
    assert found.count() == len(corpus) + len(odd_rows) + 2 and found.where("score BETWEEN 0 AND 1").count() == found.count()
    assert found.where("doc_id IS NULL").agg(F.max("score")).first()[0] > 0.8
    assert [r["score"] for r in found.where("doc_id < 3").collect()] == [model.prior] * 2
    assert sum(model.size) <= 200 and toxicity.fit(docs, bad, weights=50).index.entries <= 50


def test_sample_never_over_its_bound(spark, frame):
    """All labelled ids equal or null: one row or none is learned from."""
    same = frame([(1, f"text {i}") for i in range(300)])
    known = spark.createDataFrame([(1, 1)] * 300 + [(None, 0)] * 300, "doc_id bigint, toxic int")
    assert common.labelled_sample(same, known, "doc_id", "text", "toxic", 50).count() == 1
    nulls = frame([(None, f"text {i}") for i in range(300)])
    assert common.labelled_sample(nulls, known, "doc_id", "text", "toxic", 50).count() == 0


def test_nothing_to_learn(spark, frame, clashing):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(clashing, none)
    assert [r["score"] for r in toxicity.score_toxicity(clashing, model).collect()] == [0.5, 0.5]
    assert toxicity.score_toxicity(frame([]), model).count() == 0 and toxicity.fit(frame([]), none).index is None
