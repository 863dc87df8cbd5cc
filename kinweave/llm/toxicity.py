"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Labelled documents, a bounded sample, are the examples.  Terms are their words that go with one label (chi-square); the
document frequencies of terms are counted over all documents.  An example is a unit vector of its terms; equal vectors
are one entry with its votes.  Entries are sorted so that like ones are close, and cut into blocks; for each term the
index holds the weights of each block's entries and their maximum.  A text's terms give an upper bound for each block,
blocks are visited from the highest bound on, and the search ends when no bound reaches the last of the nearest entries
so far: the result is that of comparing all entries.  Nearest examples vote by their similarity, and votes become
probabilities by an isotonic curve, fitted on the examples with each left out of its own vote.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, NOT_ALNUM, blocks, labelled_sample, map_arrow, materialize, utf8, word_hashes, words_of

#: Bounds of what is learned from: examples, terms, and nonzero weights of all examples together.
SAMPLE, TERMS, WEIGHTS = 16_384, 4_096, 1 << 21
#: Examples that a term has to occur in, and its chi-square.
LEAST, CHI_SQUARE = 5, 30.0
#: Examples that vote, entries of a block, nearest entries that a result names.
VOTES, BLOCK, EVIDENCE = 15, 64, 3
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


class Terms:
    """Finds the terms of texts: words by their hash, then compared byte by byte."""

    def __init__(self, words: list[bytes]) -> None:
        joined, starts, ends, _ = words_of(words, NOT_ALNUM)
        hashes = word_hashes(joined, starts, ends)
        order = np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and occurrences of every pair that occurs, sorted by text and term."""
        found = [np.zeros(0, dtype=np.int64)]
        for lo, hi in blocks(texts, 1 << 20):
            joined, starts, ends, first = words_of([t.translate(LOWER_AZ) for t in texts[lo:hi]], NOT_ALNUM)
            if not len(starts) or not self.words:
                continue
            h = word_hashes(joined, starts, ends)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            raw = joined.tobytes()
            hit = hit[np.array([raw[a:b] == self.words[t] for a, b, t in zip(starts[hit].tolist(), ends[hit].tolist(), at[hit].tolist(), strict=True)], dtype=bool)]
            text = np.searchsorted(first, hit, side="right") - 1 + lo
            found.append(text * len(self.words) + at[hit])
        pairs, n = np.unique(np.concatenate(found), return_counts=True)
        size = max(1, len(self.words))
        return pairs // size, pairs % size, n


def unit_rows(row: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF vectors of length one as (pointers, terms, weights); the term frequency counts as 1 + ln n."""
    value = (1 + np.log(n)) * idf[term]
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=rows))
    return np.searchsorted(row, np.arange(rows + 1)), term, value / length[row] if len(row) else value


class BlockMax:
    """Entries in blocks: for each term and block its postings and their largest weight."""

    def __init__(self, pointers: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.entries = len(pointers) - 1
        self.blocks = max(1, -(-self.entries // BLOCK))
        entry = np.repeat(np.arange(self.entries), np.diff(pointers))
        order = np.lexsort((entry, term))
        self.entry, self.weight, key = entry[order], weight[order], (term * self.blocks + entry // BLOCK)[order]
        self.pointers = np.searchsorted(key, np.arange(terms * self.blocks + 1))
        self.highest = np.zeros(terms * self.blocks)
        np.maximum.at(self.highest, key, self.weight)
        self.highest = self.highest.reshape(terms, self.blocks)

    def nearest(self, pointers: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` nearest entries of each vector and their cosines, ties to the smaller entry; -1 where there are no more.

        Also how many blocks were looked into.
        """
        n, size = len(pointers) - 1, np.diff(pointers)
        best, cosine, visited = np.full((n, k), -1), np.zeros((n, k)), 0
        some = np.flatnonzero(size)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[some]) // 4096)) + 1):
            if not len(part):
                continue
            inside = np.concatenate([np.arange(pointers[q], pointers[q + 1]) for q in part])
            local = np.repeat(np.arange(len(part)), size[part])
            t, w = term[inside], weight[inside]
            bound = np.add.reduceat(self.highest[t] * w[:, None], np.concatenate([[0], np.cumsum(size[part])[:-1]]), axis=0) + 1e-9
            order = np.argsort(-bound, axis=1, kind="stable")
            bound = np.take_along_axis(bound, order, axis=1)
            for r in range(self.blocks):
                # bounds fall and the k-th cosine rises: who stops stays stopped
                on = (bound[:, r] > 2e-9) & (bound[:, r] >= cosine[part, k - 1])
                if not on.any():
                    break
                visited += int(on.sum())
                e = np.flatnonzero(on[local])
                key = t[e] * self.blocks + order[local[e], r]
                lo, length = self.pointers[key], self.pointers[key + 1] - self.pointers[key]
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                place = np.cumsum(on) - 1
                slot = np.repeat(place[local[e]], length) * BLOCK + self.entry[at] % BLOCK
                got = np.bincount(slot, weights=np.repeat(w[e], length) * self.weight[at], minlength=int(on.sum()) * BLOCK).reshape(-1, BLOCK)
                ids = np.where(got > 0, order[on, r][:, None] * BLOCK + np.arange(BLOCK), np.iinfo(np.int64).max)
                ids = np.concatenate([np.where(best[part[on]] < 0, np.iinfo(np.int64).max, best[part[on]]), ids], axis=1)
                got = np.concatenate([cosine[part[on]], np.round(got, 12)], axis=1)
                first = np.lexsort((ids, -got), axis=1)[:, :k]
                ids, got = np.take_along_axis(ids, first, axis=1), np.take_along_axis(got, first, axis=1)
                best[part[on]], cosine[part[on]] = np.where(got > 0, ids, -1), got
        return best, cosine, visited


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to the points: neighbours that fall are pooled."""
    at, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weights=weight)
    mean = np.bincount(inverse, weights=weight * y) / w
    pools: list[list[float]] = []
    for v, n, lo in zip(mean.tolist(), w.tolist(), at.tolist(), strict=True):
        pools.append([v, n, lo, lo])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, _, hi = pools.pop()
            v1, n1, lo, _ = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    xs = np.array([e for p in pools for e in (p[2], p[3])])
    return xs, np.repeat([p[0] for p in pools], 2)


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    index: BlockMax | None = None
    #: Of each entry: examples, those with label 1, the smallest id.
    size: np.ndarray | None = None
    positive: np.ndarray | None = None
    ids: np.ndarray | None = None
    #: Share of label 1 among examples without a term (drawn to the share of all by one example): the score of such texts.
    prior: float = 0.5
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def vote(self, best: np.ndarray, cosine: np.ndarray, size: np.ndarray | None = None, positive: np.ndarray | None = None) -> np.ndarray:
        """Share of label 1 among the VOTES nearest examples, weighted by the square of their cosine; nan with none."""
        size = np.where(best < 0, 0, self.size[best]) if size is None else size
        positive = np.where(best < 0, 0, self.positive[best]) if positive is None else positive
        taken = np.diff(np.minimum(np.cumsum(size, axis=1), VOTES), axis=1, prepend=0)
        w = taken * cosine**2
        with np.errstate(invalid="ignore", divide="ignore"):
            return (w * positive / np.maximum(size, 1)).sum(axis=1) / w.sum(axis=1)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list, list]:
        """Of each text: probability of label 1, ids and cosines of the nearest examples."""
        if self.index is None:
            return np.full(len(texts), self.prior), [[]] * len(texts), [[]] * len(texts)
        vectors = unit_rows(*self.terms.counts(texts), self.idf, len(texts))
        best, cosine, _ = self.index.nearest(*vectors, VOTES)
        raw = self.vote(best, cosine)
        score = np.where(np.isnan(raw), self.prior, np.interp(np.nan_to_num(raw), *self.knots))
        near = [[(self.ids[i], float(c)) for i, c in zip(*pair, strict=True) if i >= 0] for pair in zip(best[:, :EVIDENCE], cosine[:, :EVIDENCE], strict=True)]
        return score, [[i for i, _ in row] for row in near], [[c for _, c in row] for row in near]


def choose_terms(held: DataFrame, most: int = TERMS, least: int = LEAST, chi_square: float = CHI_SQUARE) -> list[bytes]:
    """At most ``most`` words by the chi-square of occurring in an example and its label, highest first."""
    totals = held.groupBy("y").count().collect()
    n1 = float(sum(r["count"] for r in totals if r["y"]))
    n0 = float(sum(r["count"] for r in totals)) - n1
    words = map_arrow(held.select("y", "text"), lambda t: {"y": t.column(0), "words": [list(set(_WORD.findall(x.translate(LOWER_AZ)))) for x in utf8(t.column(1))]}, "y int, words array<binary>")
    seen = words.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).alias("p"))
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    both = (n1 + n0) * F.pow(p * n0 - (n - p) * n1, 2) / (n * (n1 + n0 - n) * n1 * n0)
    best = seen.where(F.col("n") >= least).withColumn("chi", both).where(F.col("chi") >= chi_square).orderBy(F.desc("chi"), "word").limit(most)
    return [bytes(r["word"]) for r in best.select("word").collect()]


def document_frequencies(docs: DataFrame, terms: Terms, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all rows each term occurs, and the number of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # TERMS words
    size = len(terms.words)

    def run(batches):
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            total[:size] += np.bincount(shared.value.counts(utf8(batch.column(0)))[1], minlength=size)[:size]
            total[size] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:size], int(out[size])


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, weights: int = WEIGHTS) -> Model:
    """Learn from at most ``sample`` labelled documents with ``weights`` nonzero weights; frequencies are those of ``corpus`` (``docs``).

    The index comes to the driver and is broadcast: the two bounds, and TERMS, hold its size.
    """
    held = materialize(labelled_sample(docs, labels, id_col, text_col, label_col, sample), "examples")
    terms = Terms(choose_terms(held))
    n, rows = document_frequencies(docs if corpus is None else corpus, terms, text_col)
    model = Model(terms, np.log((rows + 1) / (n + 1)) + 1)
    shared = held.sparkSession.sparkContext.broadcast(terms)

    def vectors(batch: pa.RecordBatch) -> dict:
        row, term, count = shared.value.counts(utf8(batch.column(3)))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        pairs = [(term[a:b].tolist(), count[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return {"draw": batch.column(0), "id": batch.column(1), "y": batch.column(2), "terms": [p[0] for p in pairs], "counts": [p[1] for p in pairs]}

    kind = held.schema["id"].dataType.simpleString()
    found = materialize(map_arrow(held.select("draw", "id", "y", "text"), vectors, f"draw bigint, id {kind}, y int, terms array<int>, counts array<int>"), "examples")
    entries: dict[tuple, list] = {}
    used, empty = 0, [0, 0]
    for r in found.orderBy("draw", "id").toLocalIterator():
        if not r["terms"]:
            empty[0], empty[1] = empty[0] + 1, empty[1] + (r["y"] != 0)
            continue
        used += len(r["terms"])
        if used > weights:
            break
        entry = entries.setdefault((tuple(r["terms"]), tuple(r["counts"])), [0, 0, r["id"]])
        entry[0], entry[1], entry[2] = entry[0] + 1, entry[1] + (r["y"] != 0), min(entry[2], r["id"])
    every = sum(e[0] for e in entries.values()) + empty[0]
    share = (sum(e[1] for e in entries.values()) + empty[1] + 1) / (every + 2)
    model.prior = (empty[1] + share) / (empty[0] + 1)
    if not entries:
        return model
    # like entries stand together: by the term that weighs most in them, then the next
    keyed = sorted(entries.items(), key=lambda x: ([int(t) for _, t in sorted(((-(1 + np.log(c)) * model.idf[t], t) for t, c in zip(*x[0], strict=True)))], x[0]))
    row = np.repeat(np.arange(len(keyed)), [len(k[0]) for k, _ in keyed])
    unit = unit_rows(row, np.concatenate([k[0] for k, _ in keyed]), np.concatenate([k[1] for k, _ in keyed]), model.idf, len(keyed))
    model.index = BlockMax(*unit, len(terms.words))
    model.size, model.positive, model.ids = (np.array([e[i] for _, e in keyed], dtype=object if i == 2 else np.int64) for i in range(3))
    _calibrate(model, unit)
    return model


def _calibrate(model: Model, unit: tuple) -> None:
    """Votes for every example without its own, against its label."""
    best, cosine, _ = model.index.nearest(*unit, VOTES + 1)
    own = best == np.arange(len(best))[:, None]
    size, positive = np.where(best < 0, 0, model.size[best]), np.where(best < 0, 0, model.positive[best])
    x, y, w = [], [], []
    for label, n in ((0, model.size - model.positive), (1, model.positive)):
        raw = model.vote(best, cosine, size - own, positive - own * label)
        ok = (n > 0) & ~np.isnan(raw)
        x.append(raw[ok]), y.append(np.full(ok.sum(), float(label))), w.append(n[ok].astype(float))
    x, y, w = (np.concatenate(v) for v in (x, y, w))
    model.knots = isotonic(x, y, w) if len(x) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), and the nearest examples as evidence: their ids and cosines.

    Texts without a term, null and empty ones among them, have the share of label 1 among such examples and no evidence.
    Rows that repeat have equal scores; columns other than the two named are not read; an empty table gives no rows.
    Without labels, or without a word that goes with one, all scores are one share (0.5 with no labels at all).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> dict:
        score, near, cosine = shared.value.score(utf8(batch.column(1)))
        return {"doc_id": batch.column(0), "score": score, "neighbours": near, "similarities": cosine}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, judge, f"doc_id {kind}, score double, neighbours array<{kind}>, similarities array<double>")
