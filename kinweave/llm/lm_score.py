"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

log P(word | before) = log P(class | before) + log P(word | class, before).

The ``CLASSES * SLOTS`` most frequent words, sorted by their ends, are dealt out to ``CLASSES`` classes of ``SLOTS``
words; all other words belong to one of ``ENDS`` classes by a hash of their last two bytes.  Both factors are softmaxes
over weights of hashed features.  The class has the last word, the ends of the last two words, and a skip feature (the
ends of the second and the third word before); the word within its class has the last word and the ends of the last two
words, each together with the class.  Words outside the shortlist have their smoothed relative frequency in their
class, in which an unseen word has an equal part of the smoothing mass; so the probabilities of all words, known and
unseen, sum to one in every context.

Training is distributed: documents take turns in ``ROUNDS`` rounds, by a hash of their text.  In a round tasks of
``TOGETHER`` partitions run mini-batches of AdaGrad over all tokens of their documents, from the same weights and
gradient squares; the moves are averaged by use, in levels of ``FAN`` tasks each, and enlarged as ``_round`` says.  So
every token of every training document is learned from once, and how rows are dealt out matters little.

Counts of all training words are needed exactly.  Words are counted by a 64-bit hash.  The at most ``HEAVY`` most
frequent words are broadcast; the others of a document meet their counts in a shuffle, pre-aggregated per document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, blocks, map_arrow, materialize, mix, utf8, word_hashes, words_of

#: Bound of the broadcast words.
HEAVY = 1 << 19
#: Classes of the shortlist and words in each; classes of all other words, by hashed ends (a power of two).
CLASSES, SLOTS, ENDS = 64, 64, 16
#: Features of either factor, and rows of weights of each feature (a power of two; together at most 2^16).
FEATURES, BUCKETS = (3, 2), (1 << 12, 1 << 13)
ROUNDS, BATCH, RATE = 16, 8192, 0.3
#: Partitions whose documents of a round one task learns from.
TOGETHER = 8
#: Rows of weights that move as one record, and partitions whose moves one group adds up.
BLOCK, FAN = 256, 32
#: The hash of the end token.
END = np.uint64(0x5851F42D4C957F2D)
SMOOTH = 0.1
_NEVER = np.float32(-1e9)


@dataclass
class Tokens:
    """The tokens of a block of texts, an end token after each text."""

    hashes: np.ndarray
    ends: np.ndarray  # a hash of the last two bytes
    tails: np.ndarray  # the last two bytes
    text: np.ndarray
    first: np.ndarray


def tokens_of(texts: list[bytes]) -> Tokens:
    joined, starts, ends, first = words_of([t.translate(LOWER_AZ) for t in texts])
    n = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    hashes = np.full(begin[-1], END, dtype=np.uint64)
    tail = np.zeros(begin[-1], dtype=np.uint64)
    text = np.repeat(np.arange(len(texts)), n)
    at = np.ones(begin[-1], dtype=bool)
    at[begin[1:] - 1] = False
    if len(starts):
        hashes[at] = word_hashes(joined, starts, ends)
        last = joined[ends - 1].astype(np.uint64)
        tail[at] = last * np.uint64(256) + joined[np.maximum(ends - 2, starts)]
    return Tokens(hashes, mix(tail), tail, text, begin)


@dataclass
class Model:
    heavy: np.ndarray  # hashes of broadcast words, sorted
    counts: np.ndarray
    place: np.ndarray  # of each broadcast word, class * SLOTS + slot, or -1 outside the shortlist
    bias: list[np.ndarray]  # log P0 of the classes, and of the slots of each class
    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros((f * b, w), np.float32) for f, b, w in zip(FEATURES, BUCKETS, (CLASSES + ENDS, SLOTS), strict=True)])
    #: Sums of squared gradients of each row of weights so far.
    squares: list[np.ndarray] = field(default_factory=lambda: [np.zeros(f * b, np.float32) for f, b in zip(FEATURES, BUCKETS, strict=True)])
    tokens: int = 0
    distinct: int = 0
    least: int = 1  # the count of a word from which on it is broadcast

    @property
    def total(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the broadcast ones, or -1."""
        if not len(self.heavy):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
        return np.where(self.heavy[at] == hashes, at, -1)

    def labels(self, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each token (slot -1 outside the shortlist); ``at`` is what ``find`` gave."""
        place = np.where(at >= 0, self.place[at], -1) if len(self.place) else np.full(len(at), -1)
        short = place >= 0
        return np.where(short, place // SLOTS, CLASSES + (t.ends % np.uint64(ENDS)).astype(np.int64)), np.where(short, place % SLOTS, -1)


def contexts_of(t: Tokens) -> np.ndarray:
    """For each token hashes of the last word, of the ends of the last two words, and of the second and third before."""
    n = len(t.hashes)

    def before(x: np.ndarray, d: int) -> np.ndarray:
        h = np.full(n, np.uint64(d), dtype=np.uint64)
        if n > d:
            same = t.text[d:] == t.text[:-d]
            h[d:][same] = x[:-d][same]
        return h

    second = before(t.ends, 2)
    first, golden = np.uint64(3), np.uint64(0x9E3779B97F4A7C15)
    return np.stack([before(t.hashes, 1), before(t.ends, 1) * first + second * golden, second * first + before(t.ends, 3) * golden])


def class_rows(contexts: np.ndarray) -> np.ndarray:
    return np.stack([_row(h, 0, i) for i, h in enumerate(contexts)])


def slot_rows(contexts: np.ndarray, label: np.ndarray) -> np.ndarray:
    own = label.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return np.stack([_row(contexts[i] + own, 1, i) for i in range(FEATURES[1])])


def _row(h: np.ndarray, factor: int, feature: int) -> np.ndarray:
    salt = np.uint64((2 * feature + factor) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    return (mix(h + salt) % np.uint64(BUCKETS[factor])).astype(np.int64) + feature * BUCKETS[factor]


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, label: np.ndarray | None = None, axis: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For tokens with the given weight rows: exponentials of shifted logits, their sums, and the shifted logit of the label.

    The largest logit of all is the shift of every token, unless that leaves a sum too small to be exact.
    """
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    z -= z.max(axis=axis, keepdims=True, initial=_NEVER)
    own = None if label is None else z[np.arange(len(label)), label]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if axis is None and len(total) and total.min() < 1e-12:
        return _softmax(weights, bias, rows, label, 1)
    return z, total, own


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax for tokens with the given weight rows; ``bias`` is one row, or a row for each token."""
    z, total, _ = _softmax(weights, bias, rows)
    z *= (1 / total)[:, None]
    return z


def log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each token's label."""
    _, total, own = _softmax(weights, bias, rows, label)
    return own - np.log(total)


def update(weights: np.ndarray, bias: np.ndarray, used: np.ndarray, squares: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """One mini-batch of AdaGrad on the log loss, with one rate for each row of weights."""
    error = probabilities(weights, bias, rows)
    np.negative(error, out=error)
    error[np.arange(len(label)), label] += 1
    for r in rows:
        row, times, sums = _sums(r, error)
        squares[row] += np.einsum("ij,ij->i", sums, sums) / np.float32(sums.shape[1])
        sums *= (np.float32(RATE) / np.sqrt(squares[row] + 1))[:, None]
        weights[row] += sums
        used[row] += times


def _sums(r: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, how often each occurs, and the sum of its errors.

    Most rows of a batch occur a few times: those are added up one occurrence after the other, and only what is left of
    the frequent ones by reduceat, which takes long over many short segments.
    """
    order = np.argsort(r.astype(np.uint16), kind="stable")
    s = r[order]
    cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    times = np.diff(np.append(cuts, len(s)))
    sums = error.take(order[cuts], axis=0)
    more, k = np.flatnonzero(times > 1), 1
    while k < 4 and len(more):
        sums[more] += error.take(order[cuts[more] + k], axis=0)
        k += 1
        more = more[times[more] > k]
    if len(more):
        left = np.flatnonzero(np.arange(len(s)) - np.repeat(cuts, times) >= k)
        begin = np.concatenate([[0], np.cumsum(times[more] - k)[:-1]])
        sums[more] += np.add.reduceat(error.take(order[left], axis=0), begin, axis=0)
    return s[cuts], times, sums


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, last two bytes (tail) and count of every word of all texts, and of the end token."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, t[at], np.bincount(back, weights=c).astype(np.int64)

        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in blocks(texts):
                t = tokens_of(texts[lo:hi])
                u, at, c = np.unique(t.hashes, return_index=True, return_counts=True)
                held.append((u, t.tails[at], c))
                size += len(u)
            if size > 1_500_000:
                held = [flush()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield _record(held.pop())
                    size = 0
        if held:
            yield _record(flush())

    return docs.select("text").mapInArrow(run, "h bigint, tail bigint, c bigint").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def _record(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["h", "tail", "c"])


def shortlist(h: np.ndarray, c: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For each word its class * SLOTS + slot, or -1: the most frequent words, in the order of their ends."""
    top = np.lexsort((h, -c))[: CLASSES * SLOTS]
    place = np.full(len(h), -1, dtype=np.int64)
    place[top[np.lexsort((h[top], -c[top], tail[top]))]] = np.arange(len(top))
    return place


def _least(counts: DataFrame, tokens: int) -> int:
    """The smallest count that at most ``HEAVY`` words reach.

    Words of each count are counted for the counts up to tokens / HEAVY, which at most HEAVY words exceed, in 4,096 ranges
    at a time, until a range is a single count.
    """
    low, high = 1, tokens // HEAVY + 1  # low - 1 is reached by too many words, high is not
    while low < high:
        step = -(-(high - low) // 4096)
        above = counts.where(F.col("c") >= high).count()
        found = counts.where((F.col("c") >= low) & (F.col("c") < high)).groupBy(F.floor((F.col("c") - low) / step).alias("k")).count().collect()
        for k, n in sorted(((r["k"], r["count"]) for r in found), reverse=True):
            if above + n > HEAVY:
                low, high = (low + k * step + 1, min(high, low + (k + 1) * step))
                break
            above += n
        else:
            return low
    return high


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs`` (column text, no nulls) and the table of word counts (h, c)."""
    counts = materialize(word_counts(docs), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = _least(counts, n)
    heavy = counts.where(F.col("c") >= least).select("h", "c", "tail").toArrow()
    h, c, tail = heavy.column(0).to_numpy().view(np.uint64), heavy.column(1).to_numpy(), mix(heavy.column(2).to_numpy().view(np.uint64))
    order = np.argsort(h)
    h, c, tail = h[order], c[order], tail[order]
    place = shortlist(h, c, tail)
    short = place >= 0
    # mass of each class: its words, smoothed; unseen words share one word's smoothing among the classes by ends
    words = np.full((CLASSES, SLOTS), 0.0)
    words.reshape(-1)[place[short]] = c[short] + SMOOTH
    others = np.full(ENDS, SMOOTH / ENDS)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # at most 2^16 tails
        others[int(mix(np.array([r["tail"]], np.uint64))[0]) % ENDS] += r["c"] + SMOOTH * r["v"]
    others -= np.bincount((tail[short] % np.uint64(ENDS)).astype(np.int64), weights=c[short] + SMOOTH, minlength=ENDS)
    mass = np.concatenate([words.sum(axis=1), np.maximum(others, SMOOTH / ENDS)])
    with np.errstate(divide="ignore", invalid="ignore"):
        bias = [np.log(mass / mass.sum()), np.log(words / words.sum(axis=1, keepdims=True))]
    # rounds only ask for words of the shortlist, so no others travel with them
    model = Model(h[short], c[short], place[short], [np.where(np.isfinite(b), b, _NEVER).astype(np.float32) for b in bias], tokens=int(n), distinct=int(v), least=least)
    for r in range(ROUNDS):
        _round(docs, model, r)
    model.heavy, model.counts, model.place = h, c, place
    return model, counts.select("h", "c")


class _Learner:
    """What one partition moves in a round."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = [w.copy() for w in model.weights]
        self.used = [np.zeros(len(w), np.float32) for w in self.weights]
        self.squares = [q.copy() for q in model.squares]
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, t: Tokens, at: np.ndarray) -> None:
        label, slot = self.model.labels(t, self.model.find(t.hashes))
        self.held.append((contexts_of(t)[:, at], label[at], slot[at]))
        self.size += len(at)
        if self.size >= 8 * BATCH:
            self.learn()

    def learn(self) -> None:
        if not self.size:
            return
        contexts, label, slot = (np.concatenate(x, axis=-1) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.random.default_rng(len(label)).permutation(len(label))
        rows = class_rows(contexts)
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            update(self.weights[0], self.model.bias[0], self.used[0], self.squares[0], rows[:, at], label[at])
        order = order[slot[order] >= 0]
        rows = slot_rows(contexts, label)
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            update(self.weights[1], self.model.bias[1][label[at]], self.used[1], self.squares[1], rows[:, at], slot[at])

    def moves(self, partition: int) -> pa.RecordBatch:
        """The blocks of weights that were used, with the mean move of each row and its use."""
        out: list[tuple] = []
        for factor, (new, old, used) in enumerate(zip(self.weights, self.model.weights, self.used, strict=True)):
            for b in range(0, len(new), BLOCK):
                if used[b : b + BLOCK].any():
                    out.append((factor, b // BLOCK, partition, (new[b : b + BLOCK] - old[b : b + BLOCK]).astype(np.float16).tobytes(), used[b : b + BLOCK].tobytes(), (used[b : b + BLOCK] ** 2).tobytes(), (self.squares[factor][b : b + BLOCK] - self.model.squares[factor][b : b + BLOCK]).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["factor", "block", "salt", "moved", "used", "squares", "steep"])


_MOVES = "factor int, block int, salt int, moved binary, used binary, squares binary, steep binary"


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    """The moves of a block, averaged by use, with the sums of the uses, of their squares, and of squared gradients."""
    used, squares, steep = np.zeros((3, BLOCK), np.float32)
    moved = 0.0
    for m, u, q, s in zip(group["moved"], group["used"], group["squares"], group["steep"], strict=True):
        steep += np.frombuffer(s, np.float32)
        u = np.frombuffer(u, np.float32)
        squares += np.frombuffer(q, np.float32)
        moved = moved + np.frombuffer(m, np.float16).astype(np.float32).reshape(BLOCK, -1) * u[:, None]
        used += u
    moved = (moved / np.maximum(used, 1)[:, None]).astype(np.float16)
    return group.iloc[:1].assign(moved=[moved.tobytes()], used=[used.tobytes()], squares=[squares.tobytes()], steep=[steep.tobytes()])


def _round(docs: DataFrame, model: Model, number: int) -> None:
    """Every partition moves the weights by its mini-batches; the moves are averaged, each row by its use, and enlarged.

    After m steps of AdaGrad a weight has moved in proportion to the square root of m.  A row that k partitions used
    alike would, in one partition, have had k times as many steps; so its mean move is multiplied by the square root of
    k, here the square of the sum of uses by the sum of their squares.  What is learned then hardly depends on how the
    rows are dealt out.

    A partition gives at most the whole tables, and a group adds up the blocks of at most FAN partitions; the levels
    grow with the logarithm of the partitions.  The averaged tables, of fixed size, come to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its tables don't grow with the corpus

    def run(batches):
        learner = _Learner(shared.value)
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in blocks(texts):
                t = tokens_of(texts[lo:hi])
                learner.add(t, np.arange(len(t.hashes)))
        learner.learn()
        yield learner.moves(TaskContext.get().partitionId())

    left = max(1, -(-docs.rdd.getNumPartitions() // TOGETHER))
    rows = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number).coalesce(left)
    moves = rows.mapInArrow(run, _MOVES)
    while True:
        moves = moves.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("factor", "block", "salt").applyInPandas(_mean, _MOVES)
        left = -(-left // FAN)
        if left <= 1:
            break
    for r in moves.toLocalIterator():
        table = model.weights[r["factor"]]
        used, squares = np.frombuffer(r["used"], np.float32), np.frombuffer(r["squares"], np.float32)
        model.squares[r["factor"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["steep"], np.float32)
        alike = np.sqrt(used * used / np.maximum(squares, 1e-9))[:, None]
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += alike * np.frombuffer(r["moved"], np.float16).astype(np.float32).reshape(BLOCK, -1)
    shared.unpersist()


def gains(m: Model, t: Tokens, at: np.ndarray) -> np.ndarray:
    """For each token, log10 of the model's probability over that of its frequency (over its class's, if not broadcast).

    ``at`` is what ``find`` gave for the tokens.
    """
    label, slot = m.labels(t, at)
    contexts, out = contexts_of(t), np.empty(len(label))
    for i in range(0, len(out), 1 << 13):
        part = slice(i, i + (1 << 13))
        mine, own = label[part], slot[part]
        gain = log_probabilities(m.weights[0], m.bias[0], class_rows(contexts[:, part]), mine) - m.bias[0][mine]
        short = np.flatnonzero(own >= 0)
        if len(short):
            c, k = mine[short], own[short]
            gain[short] += log_probabilities(m.weights[1], m.bias[1][c], slot_rows(contexts[:, part][:, short], c), k) - m.bias[1][c, k]
        out[part] = gain / np.log(10)
    return out


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the texts of ``train``.  Null texts count as empty: an end token only.  A word that training has not
    seen has count 0.  With an empty ``train`` all counts are 0 and every token has the probability of an unseen word.
    Rows that repeat are scored each; columns other than the two named are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    model, counts = fit(train.select(text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), text)

    def run(batch):
        m = shared.value
        out: dict = {k: [] for k in ("n_tokens", "n_known", "base", "gain", "rare", "times")}
        texts = utf8(batch.column(1))
        for lo, hi in blocks(texts, 1 << 20):
            t = tokens_of(texts[lo:hi])
            at = m.find(t.hashes)
            common = at >= 0
            known = np.where(common, np.log10((m.counts[at] if len(m.counts) else 0) + SMOOTH), 0.0)
            gain = gains(m, t, at)
            cuts = t.first[:-1]
            out["n_tokens"].append(np.diff(t.first))
            out["n_known"].append(np.add.reduceat(common.astype(np.int64), cuts))
            out["base"].append(np.add.reduceat(known, cuts))
            out["gain"].append(np.add.reduceat(gain, cuts))
            # the other words, each once for a text
            other = np.flatnonzero(~common)
            order = other[np.lexsort((t.hashes[other], t.text[other]))]
            h, d = t.hashes[order], t.text[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
            per = np.searchsorted(d[new], np.arange(hi - lo + 1))
            out["rare"].append((h[new].view(np.int64), per))
            out["times"].append(np.diff(np.append(new, len(h))))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p) for _, p in out["rare"]]))]).astype(np.int32)
        lists = {"rare": pa.ListArray.from_arrays(offsets, np.concatenate([h for h, _ in out["rare"]])), "times": pa.ListArray.from_arrays(offsets, np.concatenate(out["times"]).astype(np.int32))}
        return {"doc_id": batch.column(0)} | {k: np.concatenate(out[k]) for k in ("n_tokens", "n_known", "base", "gain")} | lists

    schema = f"doc_id {kind}, n_tokens bigint, n_known bigint, base double, gain double, rare array<bigint>, times array<int>"
    scored = materialize(map_arrow(rows, run, schema).withColumn("tag", F.monotonically_increasing_id()), "scored")
    rare = scored.select("tag", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("tag", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    found = rare.join(counts.where(F.col("c") < model.least), "h", "left")
    sums = found.groupBy("tag").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"),
    )
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(model.total)))
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    # an unseen word has one of ENDS parts of the smoothing mass
    unseen = (F.col("n_tokens") - known) * F.lit(float(np.log10(ENDS)))
    return scored.join(sums, "tag", "left").select(
        "doc_id",
        "n_tokens",
        known.alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") - unseen).alias("score"),
    )
