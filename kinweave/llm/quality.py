"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Each word has a sparse random index vector, given by its hash; its context vector is the sum of the index vectors of
its neighbours, gathered over a bounded, hashed sample of labelled documents.  The same is done for the shapes of words
(runs of upper and lower case, digits and each other sign).  A document is pooled into the mean vectors of its words
and shapes, with their lengths and the share of words that repeat the one before.  A two-layer network turns this into
a probability, whose temperature is fitted on a part of the sample that the network was not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, blocks, labelled_sample, map_arrow, materialize, mix, utf8, word_hashes, words_of

#: Bound of the sample: labelled documents that the model is learned from.
SAMPLE = 12_000
#: Rows of the hashed vector tables, components of a vector, nonzero components of an index vector, neighbours each side.
BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4

#: Classes of bytes for word shapes: letters of either case, digits, other signs as they are, bytes of longer characters.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def _buckets(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, word bucket and shape bucket of every word of a block."""
    word = word_hashes(joined, starts, ends)
    kind = _SHAPE[joined]
    kind[IS_SPACE[joined]] = 32
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 32)
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = word_hashes(kind[keep], place[starts], place[ends])
    return word, (word % np.uint64(BUCKETS)).astype(np.int64), (mix(shape) % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors(buckets: int = BUCKETS) -> np.ndarray:
    """The sparse random vectors: NONZERO components of +-1 at hashed places."""
    out = np.zeros((buckets, DIM), dtype=np.float32)
    rows = np.arange(buckets, dtype=np.uint64)
    for i in range(NONZERO):
        h = mix(rows * np.uint64(NONZERO) + np.uint64(i + 1))
        out[rows.astype(np.int64), (h % np.uint64(DIM)).astype(np.int64)] += np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    return out


def _contexts(bucket: np.ndarray, text: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    around = np.zeros((len(bucket), DIM), dtype=np.float32)
    for d in range(1, REACH + 1):
        same = (text[d:] == text[:-d])[:, None]
        around[d:] += index[bucket[:-d]] * same
        around[:-d] += index[bucket[d:]] * same
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    into[bucket[order][cuts]] += np.add.reduceat(around[order], cuts, axis=0)


@dataclass
class Model:
    vectors: tuple[np.ndarray, np.ndarray]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: list[np.ndarray] | None = None
    temperature: float = 1.0
    prior: float = 0.5

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 4), dtype=np.float64)
        for lo, hi in blocks(texts, 1 << 20):
            joined, starts, ends, first = words_of(texts[lo:hi])
            n = np.diff(first)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            word, *buckets = _buckets(joined, starts, ends)
            at = lo + some
            for part, (bucket, vectors) in enumerate(zip(buckets, self.vectors, strict=True)):
                pooled = np.add.reduceat(vectors[bucket], first[some], axis=0) / n[some, None]
                out[at, part * DIM : (part + 1) * DIM] = pooled
                out[at, 2 * DIM + part] = np.linalg.norm(pooled, axis=1)
            same = np.concatenate([[0], word[1:] == word[:-1]]).astype(np.float64)
            out[at, 2 * DIM + 2] = np.add.reduceat(same, first[some]) / n[some]
            out[at, 2 * DIM + 3] = np.log1p(n[some])
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.maximum(0, (x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(self.features(texts)) / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """Adam on the log loss; the last fifth (the rows come in hashed order) only sets the temperature."""
    rng = np.random.default_rng(seed)
    cut = max(1, len(x) * 4 // 5)
    mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-6
    z = (x - mean) / scale
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(cut), max(1, cut // BATCH)):
            a = np.maximum(0, z[at] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -40, 40))) - y[at, None]) / len(at)
            back = (error @ w[2].T) * (a > 0)
            grads = [z[at].T @ back + DECAY * w[0], back.sum(axis=0), a.T @ error + DECAY * w[2], error.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    rest = slice(cut, None) if cut < len(x) else slice(None)
    raw = (np.maximum(0, z[rest] @ w[0] + w[1]) @ w[2] + w[3])[:, 0]
    def loss(t):
        p = np.clip(1 / (1 + np.exp(-np.clip(raw / t, -40, 40))), 1e-9, 1 - 1e-9)
        return -np.mean(y[rest] * np.log(p) + (1 - y[rest]) * np.log(1 - p))
    temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return mean, scale, w, float(temperature)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents, as ``labelled_sample`` draws them."""
    held = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, sample).select("draw", "y", "text").repartition(8, "draw"), "sample")

    index = index_vectors()

    def gather(batches):
        tables = [np.zeros((BUCKETS, DIM), dtype=np.float32) for _ in range(2)]
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in blocks(texts, 1 << 20):
                joined, starts, ends, first = words_of(texts[lo:hi])
                if len(starts):
                    text = np.repeat(np.arange(hi - lo), np.diff(first))
                    for bucket, into in zip(_buckets(joined, starts, ends)[1:], tables, strict=True):
                        _contexts(bucket, text, index, into)
        for k, into in enumerate(tables):
            yield _chunks(k, into)

    parts = held.select("text").mapInArrow(gather, "part int, block int, value binary")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, dtype=np.float32) for v in group["value"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"part": group["part"].iloc[:1].to_numpy(), "block": group["block"].iloc[:1].to_numpy(), "value": [total.tobytes()]})

    tables = np.zeros((2, BUCKETS, DIM), dtype=np.float32)
    for r in parts.groupBy("part", "block").applyInPandas(add, "part int, block int, value binary").toLocalIterator():
        tables[r["part"], r["block"] * _ROWS : (r["block"] + 1) * _ROWS] = np.frombuffer(r["value"], dtype=np.float32).reshape(_ROWS, DIM)
    # a word stands for its contexts and, a little, for itself
    vectors = tuple((t + 0.5 * index) / (np.linalg.norm(t + 0.5 * index, axis=1, keepdims=True) + 1e-6) for t in tables)
    model = Model(tuple(v.astype(np.float32) for v in vectors))
    schema = "draw bigint, y int, x array<double>"
    pooled = map_arrow(held.select("draw", F.col("y").cast("int").alias("y"), "text"), lambda t: {"draw": t.column(0), "y": t.column(1), "x": list(model.features(utf8(t.column(2))))}, schema).toArrow()
    if pooled.num_rows == 0:
        return model
    x = np.array(pooled.column(2).to_pylist())
    y = pooled.column(1).to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[:3], pooled.column(0).to_numpy()))
    x, y = x[order], y[order]
    model.prior = float(y.mean())
    if 0 < model.prior < 1:
        model.mean, model.scale, model.weights, model.temperature = _train(x, y)
    return model


_ROWS = 1024


def _chunks(part: int, table: np.ndarray):
    import pyarrow as pa

    n = len(table) // _ROWS
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([table[i * _ROWS : (i + 1) * _ROWS].tobytes() for i in range(n)], pa.binary())],
        names=["part", "block", "value"],
    )


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher for good text).

    Null and empty texts are scored like any other, from zero features.  Without two different labels to learn from,
    all scores are the share of label 1 (0.5 with no labels at all).  Rows that repeat have equal scores; columns other
    than the two named are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of BUCKETS rows, whatever the corpus
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, lambda t: {"doc_id": t.column(0), "score": shared.value.score(utf8(t.column(1)))}, f"doc_id {kind}, score double")
