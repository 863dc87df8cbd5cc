"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are taken in blocks of ``BLOCK``.  For a block, the terms of its items that are not too common get TF-IDF
weights, with frequencies over the passages of all documents.  A randomised SVD of the TF-IDF passages (items and all
passages of all documents) is found by subspace iteration, each step one distributed product.  One pass writes the
passages of all documents as (passage, term) pairs, and ``FULL`` steps go over all of them, so that the space is that of
all documents.  Steps over a bounded, hashed sample before them give a start and save some of them; what space comes out
hardly depends on the sample, which may as well be two rows.
Every passage of every document (windows of ``WINDOW`` words, half overlapping) that holds ``LEAST_TERMS`` different
terms is projected, and its cosine with all items of the block taken at once; pairs over ``COSINE`` are candidates.
They are verified on the words themselves: the longest common subsequence of the item and the passage with its
surroundings, and whether the words of the item's answer (its last part) are there.  Items of fewer than ``LEAST_TERMS``
different words, which have no passage vector, are found where all their words stand in a row.

Items are fitted and searched for in groups of ``BLOCK * AT_ONCE``; one group is held and broadcast at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, blocks, discard, drawn, map_arrow, materialize, utf8, word_hashes, words_of

#: Items of a block; blocks that are searched in one pass over the documents.
BLOCK, AT_ONCE = 256, 16
#: Bound of the sample: documents that give the steps over all documents their start.
SAMPLE = 3000
WINDOW, STRIDE = 48, 24
#: Columns of the latent space and more while it is fitted; steps over the sample, and after them over all documents.
RANK, OVER, STEPS, FULL = 160, 16, 2, 3
#: Passages that are projected at a time, terms whose sums move as one record, tasks whose sums one group adds up.
ROWS, RANGE, FAN = 4096, 256, 32
#: Terms of the blocks that are fitted in one pass, unless one block has more.
TERMS = 1 << 16
#: A term is left out if more than this share of passages has it, unless its item has hardly any other.
COMMON, LEAST_TERMS = 0.003, 3
COSINE = 0.4
#: An item is found if so much of it is a common subsequence, alone or with so much of its answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.75, 0.55, 0.5
#: Bits of the table that finds a word's term.
TABLE_BITS = 20

#: A-Z lower-cased, ASCII signs blank.
_PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in LOWER_AZ)
#: Signs of Latin-1, general punctuation (quotes, dashes, ellipses, spaces) and CJK punctuation, in UTF-8.
_SIGNS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x80-\x8f\x9a-\xa0]")


def _plain(text: bytes) -> bytes:
    text = text.translate(_PLAIN)
    return text if text.isascii() else _SIGNS.sub(b" ", text.decode("utf-8", "replace").lower().encode())


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block of texts, lower-cased and without signs, and where each text's begin (one more)."""
    joined, starts, ends, first = words_of(list(map(_plain, texts)))
    return (word_hashes(joined, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def places_of(a: np.ndarray) -> dict[int, int]:
    """The places of each word, as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    return places


def lcs(a: np.ndarray, b: np.ndarray, places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, in bit-parallel form; ``places`` are those of ``a``."""
    places = places_of(a) if places is None else places
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := places.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Block:
    """The items of a block with its terms, weights and latent vectors."""

    ids: list
    words: list[np.ndarray]
    terms: np.ndarray  # sorted hashes
    table: np.ndarray  # term number by the low bits of a hash, -1 for none
    more: bool  # True if some terms share their low bits
    idf: np.ndarray | None = None
    base: np.ndarray | None = None  # the latent space, times the weight of each term
    latent: np.ndarray | None = None

    sets: dict[int, np.ndarray] = field(default_factory=dict, repr=False)
    places: dict[int, dict[int, int]] = field(default_factory=dict, repr=False)

    def held(self, item: int, region: np.ndarray) -> np.ndarray:
        """Those words of a region that are words of an item, in their order."""
        if (own := self.sets.get(item)) is None:
            own = self.sets[item] = np.unique(self.words[item])
        return region[own[np.minimum(own.searchsorted(region), len(own) - 1)] == region]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 if it is none."""
        if self.more:
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        else:
            at = self.table[(hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
        return np.where(self.terms[at] == hashes, at, -1)


def _block(items: list[tuple], terms: np.ndarray) -> Block:
    low = (terms & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    table = np.full(1 << TABLE_BITS, 0, dtype=np.int32)
    table[low] = np.arange(len(terms))
    return Block([i for i, _ in items], [w for _, w in items], terms, table, len(np.unique(low)) < len(low))


def passages(block: Block, hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows with at least ``least`` different terms: text, window number; and their (row, term) pairs."""
    number = block.number(hashes)
    at = np.flatnonzero(number >= 0)
    text = np.searchsorted(first, at, side="right") - 1
    base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // STRIDE))])  # windows of the texts before
    place = (at - first[text]) // STRIDE
    window, bits = base[text] + place, np.int64(len(block.terms)).item().bit_length()
    # a word stands in the window that begins with its stride and in the one before
    pair = (window << bits) + number[at]
    pair = np.sort(np.concatenate([pair, pair[place > 0] - (1 << bits)]))
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    key = pair >> bits
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(cuts, len(key)))
    good = count >= least
    head, count = key[cuts[good]], count[good]
    text = np.searchsorted(base, head, side="right") - 1
    return text, head - base[text], np.repeat(np.arange(len(head)), count), (pair & ((1 << bits) - 1))[np.repeat(good, np.diff(np.append(cuts, len(key))))]


def _project(row: np.ndarray, term: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """Passages times a matrix with a weighed row for each term; ``row`` is in order."""
    out = np.zeros((n, matrix.shape[1]), dtype=np.float32)
    if n:
        cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[cuts]] = np.add.reduceat(matrix[term], cuts, axis=0)
    return out


def _back(out: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray) -> None:
    """Add to each term's row of ``out`` those of its passages in ``y``."""
    order = np.argsort(term, kind="stable")
    term = term[order]
    cuts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    out[term[cuts]] += np.add.reduceat(y[row[order]], cuts, axis=0)


def _frequencies(docs: DataFrame, every: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The words of the items, passages of ``docs`` (column text, no nulls) that hold each, and the number of passages.

    Partitions give the words that they have with partial counts, which Spark adds up; a row for each word comes back.
    """
    words = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
    probe = _block([], words)

    def run(batches):
        count = np.zeros(len(words) + 1, np.int64)  # passages last
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in blocks(texts):
                hashes, first = hashed_words(texts[lo:hi])
                count[-1] += np.sum(-(-np.diff(first) // STRIDE))
                if len(words):
                    _, _, _, term = passages(probe, hashes, first, 1)
                    count[:-1] += np.bincount(term, minlength=len(words))
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(count[has])], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(words) + 1, np.int64)
    count[found.column("word").to_numpy()] = found.column("n").to_numpy()
    return words, count[:-1], int(count[-1])


_SUMS = "block int, part int, salt int, value binary"


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["value"].iloc[0]) // 4)
    for v in group["value"]:
        total += np.frombuffer(v, np.float32)
    return group.iloc[:1].assign(value=[total.astype(np.float32).tobytes()])


def _passages(docs: DataFrame, fitted: list[Block]) -> DataFrame:
    """The passages of ``docs`` (column text, no nulls) with ``LEAST_TERMS`` terms of a block, written once for all steps.

    A row has passages of one block: the number of terms of each, and the terms.  A row is bounded as blocks of texts are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for batch in batches:
            texts, found = utf8(batch.column(0)), []
            for lo, hi in blocks(texts, 1 << 19):
                hashes, first = hashed_words(texts[lo:hi])
                for k, block in enumerate(shared.value):
                    text, _, row, term = passages(block, hashes, first, LEAST_TERMS)
                    if len(text):
                        found.append((k, np.bincount(row, minlength=len(text)).astype(np.uint16).tobytes(), term.astype(np.int32).tobytes()))
            if found:
                kinds = (pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=["block", "count", "term"])

    out = materialize(docs.select("text").mapInArrow(run, "block int, count binary, term binary"), "passages")
    shared.unpersist()
    return out


def _products(rows: DataFrame, fitted: list[Block], bases: list[np.ndarray]) -> list[np.ndarray]:
    """A^T A q of each block, with its q in ``bases``, over all passages that ``_passages`` gave.

    Tasks give their sums, of the shape of q, in ranges of ``RANGE`` terms; groups of at most ``FAN`` tasks add up a
    range each, in levels that grow with the logarithm of the tasks.  Sums of fixed size come to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast([q * b.idf[:, None] for b, q in zip(fitted, bases, strict=True)])

    def run(batches):
        sums = [np.zeros_like(q) for q in shared.value]
        for batch in batches:
            for k, count, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count, term = np.frombuffer(count, np.uint16), np.frombuffer(terms, np.int32)
                row = np.repeat(np.arange(len(count)), count)
                for begin in range(0, len(count), ROWS):
                    part = slice(*np.searchsorted(row, (begin, begin + ROWS)))
                    y = _project(row[part] - begin, term[part], min(ROWS, len(count) - begin), shared.value[k])
                    _back(sums[k], row[part] - begin, term[part], y)
        salt = TaskContext.get().partitionId()
        for k, out in enumerate(sums):
            found = [(k, i // RANGE, salt, out[i : i + RANGE].tobytes()) for i in range(0, len(out), RANGE) if out[i : i + RANGE].any()]
            if found:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=["block", "part", "salt", "value"])

    left, sums = rows.rdd.getNumPartitions(), rows.mapInArrow(run, _SUMS)
    while True:
        sums = sums.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("block", "part", "salt").applyInPandas(_sum, _SUMS)
        left = -(-left // FAN)
        if left <= 1:
            break
    out = [np.zeros_like(q) for q in bases]
    for r in sums.toLocalIterator():
        value = np.frombuffer(r["value"], np.float32).reshape(-1, out[r["block"]].shape[1])
        out[r["block"]][r["part"] * RANGE : r["part"] * RANGE + len(value)] = value
    shared.unpersist()
    return [x * b.idf[:, None] for x, b in zip(out, fitted, strict=True)]


def _weigh(items: list[tuple], words: np.ndarray, count: np.ndarray, total: int) -> Block | None:
    """Terms and weights of one block of items (id, word hashes)."""
    chosen = []
    for _, own in items:
        mine = np.unique(own)
        share = count[np.searchsorted(words, mine)] / max(1, total)
        order = np.argsort(share, kind="stable")
        chosen.append(mine[order[: max(2 * LEAST_TERMS, int((share <= COMMON).sum()))]])
    terms = np.unique(np.concatenate(chosen))
    if len(terms) < LEAST_TERMS:
        return None
    block = _block(items, terms)
    block.idf = np.log((1 + total) / (1 + count[np.searchsorted(words, terms)])).astype(np.float32) + 0.1
    return block


def _items(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The items of a block as (row, term) pairs."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in block.words])])
    number = block.number(np.concatenate(block.words))
    at = np.flatnonzero(number >= 0)
    pair = np.unique((np.searchsorted(first, at, side="right") - 1) * np.int64(len(block.terms)) + number[at])
    return pair // len(block.terms), pair % len(block.terms)


def _latent(fitted: list[Block], docs: DataFrame, total: int, sample: DataFrame, drawn: int) -> None:
    """Find the latent spaces of blocks; ``total`` passages are in ``docs`` and ``drawn`` in the sample."""
    own = [_items(b) for b in fitted]
    bases = [np.random.default_rng(11).standard_normal((len(b.terms), min(len(b.terms), RANK + OVER))).astype(np.float32) for b in fitted]
    start, every = _passages(sample, fitted), _passages(docs, fitted)
    for rows, n in [(start, drawn)] * STEPS + [(every, total)] * FULL:
        found = _products(rows, fitted, bases)
        for k, (block, (row, term), q) in enumerate(zip(fitted, own, bases, strict=True)):
            mine = np.zeros_like(q)
            _back(mine, row, term, _project(row, term, len(block.ids), q * block.idf[:, None]))
            # items are weighed to have as much say as the passages
            weight = 4 * max(1, n) / len(block.ids)
            bases[k] = np.linalg.qr(found[k] + weight * block.idf[:, None] * mine)[0].astype(np.float32)
    discard(start, every)
    for block, (row, term), q in zip(fitted, own, bases, strict=True):
        block.base = np.ascontiguousarray(q[:, :RANK] * block.idf[:, None])
        z = _project(row, term, len(block.ids), block.base)
        block.latent = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)


def fit_blocks(items: list[tuple], words: np.ndarray, count: np.ndarray, docs: DataFrame, total: int, sample: DataFrame, drawn: int) -> list[Block]:
    """Blocks of the items (id, word hashes) with terms, weights and latent spaces; several blocks share a pass."""
    found = [b for i in range(0, len(items), BLOCK) if (b := _weigh(items[i : i + BLOCK], words, count, total))]
    held: list[Block] = []
    for block in [*found, None]:
        if held and (block is None or sum(len(b.terms) for b in held) + len(block.terms) > TERMS):
            _latent(held, docs, total, sample, drawn)
            held = []
        held.append(block)
    return found


def _verify(item: np.ndarray, region: np.ndarray, places: dict[int, int]) -> tuple[float, float]:
    """Shares of the item in the common subsequence, and of its answer's words in the region."""
    common = lcs(item, region, places) / len(item)
    if common < LCS_WITH_ANSWER:
        return common, 0.0
    answer = set(item[-max(3, len(item) // 4) :].tolist())
    return common, len(answer & set(region.tolist())) / len(answer)


def search(texts: list[bytes], block: Block) -> list[tuple[int, int, float, float, float, int]]:
    """Confirmed (text, item, cosine, lcs, answer, first word) of a block of texts, the best place of each pair."""
    hashes, first = hashed_words(texts)
    if not len(hashes):
        return []
    text, place, row, term = passages(block, hashes, first, LEAST_TERMS)
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(text), ROWS):
        part = slice(*np.searchsorted(row, (lo, lo + ROWS)))
        z = _project(row[part] - lo, term[part], min(ROWS, len(text) - lo), block.base)
        z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-9
        cosine = z @ block.latent.T
        for w, k in zip(*np.nonzero(cosine >= COSINE), strict=True):
            t, item = int(text[lo + w]), block.words[k]
            begin = int(first[t] + place[lo + w] * STRIDE)
            a, b = max(int(first[t]), begin - len(item)), min(int(first[t + 1]), begin + WINDOW + len(item))
            # other words of the region change neither the common subsequence, which can't be longer, nor the answer's share
            region = block.held(k, hashes[a:b])
            if len(region) < LCS_WITH_ANSWER * len(item):
                continue
            if k not in block.places:
                block.places[k] = places_of(item)
            common, answer = _verify(item, region, block.places[k])
            if common >= LCS or common >= LCS_WITH_ANSWER and answer >= ANSWER:
                found = (t, int(k), float(cosine[w, k]), common, answer, a - int(first[t]))
                if (t, k) not in best or best[t, k][3:5] < found[3:5]:
                    best[t, int(k)] = found
    return list(best.values())


@dataclass
class Short:
    """Items of few different words, found where all their words stand in a row."""

    ids: list
    words: list[np.ndarray]
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    of: dict = field(default_factory=dict)

    def __post_init__(self):
        for k, w in enumerate(self.words):
            self.of.setdefault(int(w[0]), []).append(k)
        self.heads = np.array(sorted(self.of), dtype=np.uint64)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float, int]]:
        """As ``search``, the first place of each pair."""
        hashes, first = hashed_words(texts)
        found: dict[tuple[int, int], tuple] = {}
        for at in np.flatnonzero(np.isin(hashes, self.heads)).tolist():
            t = int(np.searchsorted(first, at, side="right")) - 1
            for k in self.of[int(hashes[at])]:
                n = len(self.words[k])
                if (t, k) not in found and at + n <= first[t + 1] and (hashes[at : at + n] == self.words[k]).all():
                    found[t, k] = (t, k, 1.0, 1.0, 1.0, at - int(first[t]))
        return list(found.values())


@dataclass
class Fitted:
    """The items, fitted a group at a time as they are asked for; a single group is kept."""

    docs: DataFrame
    items: DataFrame
    sample: DataFrame
    drawn: int
    only: list | None = None

    def __iter__(self) -> Iterator[list]:
        if self.only is not None:
            yield self.only
            return
        count, held, group = 0, [], None
        for r in chain(self.items.orderBy("item").toLocalIterator(), [None]):
            if r is not None and len(hashes := hashed_words([r["text"].encode()])[0]):
                held.append((r["item"], hashes))
            if held and (r is None or len(held) == BLOCK * AT_ONCE):
                group, held, count = self._group(held), [], count + 1
                yield group
        if count == 1:
            self.only = group

    def _group(self, held: list[tuple]) -> list:
        long = [x for x in held if len(np.unique(x[1])) >= LEAST_TERMS]
        short = [x for x in held if len(np.unique(x[1])) < LEAST_TERMS]
        found: list = [Short([i for i, _ in short], [w for _, w in short])] if short else []
        if long:
            words, count, n = _frequencies(self.docs, [w for _, w in long])
            found += fit_blocks(long, words, count, self.docs, n, self.sample, self.drawn)
        return found


def fit(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Fitted:
    """The items, ready to be fitted in groups that one pass searches.

    Benchmark rows come to the driver a group at a time; what is held is bounded by BLOCK * AT_ONCE items.  Term
    frequencies and the passages of all documents each take a pass over them for each group (passages more than one if
    its items have over ``TERMS`` terms).  Null items and items without a word are none.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    sample = materialize(drawn(docs.select(F.col(id_col).alias("id"), text), SAMPLE).select("text").repartition(8, F.xxhash64("text")), "sample")
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    return Fitted(docs.select(text), rows, sample, _frequencies(sample, [])[2])


def _each(groups: Fitted) -> Iterator[tuple[list, bool]]:
    """Each group, and whether it is the last."""
    held = None
    for group in groups:
        if held is not None:
            yield held, False
        held = group
    if held is not None:
        yield held, True


def find_leaks(docs: DataFrame, groups: Fitted, id_col: str = "doc_id", text_col: str = "text", item_kind: str = "bigint") -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, cosine, lcs_share, answer_share, first_word.

    An item is found once in a row of ``docs``, at the place with the largest common subsequence share, then answer
    share; the first of equal places.  Items of fewer than ``LEAST_TERMS`` different words are found word for
    word, with shares of 1.  Null and empty texts hold nothing.  Rows that repeat are searched each; columns other than
    the two named are not read; with no documents or items there are no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double, first_word int"
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], schema)
    for n, (group, last) in enumerate(_each(groups)):
        shared = spark.sparkContext.broadcast(group)
        part = map_arrow(rows, _searcher(shared), schema)
        if not last:  # its results are written, and it is let go before the next group is searched for
            part = materialize(part, "leaks")
            shared.unpersist()
        found = part if n == 0 else found.unionByName(part)
    return found


def _matches(texts: list[bytes], group: list) -> list[tuple]:
    """(text, item id, cosine, lcs, answer, first word) over all blocks of a group."""
    out = []
    for lo, hi in blocks(texts, 1 << 20):
        for block in group:
            found = block.search(texts[lo:hi]) if isinstance(block, Short) else search(texts[lo:hi], block)
            out += [(lo + t, block.ids[k], *rest) for t, k, *rest in found]
    return out


def _searcher(shared):
    def run(batch):
        found = _matches(utf8(batch.column(1)), shared.value)
        column = lambda i: [m[i] for m in found]
        return {"doc_id": batch.column(0).take(pa.array(column(0), pa.int64())), "item_id": column(1), "cosine": column(2), "lcs_share": column(3), "answer_share": column(4), "first_word": column(5)}

    return run


def drop_leaks(docs: DataFrame, groups: Fitted, text_col: str = "text") -> DataFrame:
    """The rows in which no item is found, with all their columns.

    Null and empty texts hold no item and stay; rows that repeat and rows with a null id are judged each; with no items
    all rows stay; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)
    for group, last in _each(groups):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[m[0] for m in _matches(utf8(batch.column(at)), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = materialize(docs, "unleaked")
            shared.unpersist()
    return docs
