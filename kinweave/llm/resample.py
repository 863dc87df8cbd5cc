"""Importance resampling towards a target's n-gram distribution, with texts cut into lines.

Features are runs of one to three words, hashed into ``BUCKETS``; a bucket's gain says how much more frequent it is in
the target than in the documents, and a document's weight is the sum over its features.  Newlines separate words, so a
text is a list of lines: the features inside a line depend on the line alone, and are computed once for each distinct
line and multiplied by its occurrences; the few n-grams that cross from a line into later ones are computed from the
documents and added.  A document's weight is likewise put together from the weights of its lines, looked up by a 128-bit
hash, and of its crossing n-grams.  Gumbel noise, given by a hash of the id, turns the highest scores into a draw
without replacement in proportion to the exponential of the weights.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from kinweave.operators.ordering import numbered
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, NOT_ALNUM, blocks, discard, map_arrow, materialize, utf8, words_of

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Words that a document needs to be drawn; the share that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 5
#: Lines with more than this share of all occurrences are broadcast: there are fewer than its inverse, whatever the corpus.
HOT_SHARE = 1 / 4096

_CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], dtype=np.uint32)
_TABLED = 64


def _step() -> np.ndarray:
    """Effect of one more zero byte on each bit of a CRC, as 32 columns."""
    plain = np.array([1 << i for i in range(32)], dtype=np.uint32)
    return _CRC[plain & np.uint32(255)] ^ (plain >> np.uint32(8))


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & np.uint32(1), columns[i], np.uint32(0))
    return out


def _by_bytes(columns: np.ndarray) -> np.ndarray:
    """The same map as four tables of 256, one for each byte."""
    b = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(columns, b << np.uint32(8 * k)) for k in range(4)])


class _Shifts:
    """CRCs moved on by a number of bytes: tables for short lengths, powers of two for others."""

    def __init__(self) -> None:
        one = _step()
        columns, tables = np.array([1 << i for i in range(32)], dtype=np.uint32), []
        for _ in range(_TABLED + 1):
            tables.append(_by_bytes(columns))
            columns = _apply(one, columns)
        self.tables = np.stack(tables)
        power, self.powers = one, []
        for _ in range(48):
            self.powers.append(_by_bytes(power))
            power = _apply(power, power)

    def __call__(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        short = np.minimum(by, _TABLED)
        byte = [((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.intp) for k in range(4)]
        out = self.tables[short, 0, byte[0]] ^ self.tables[short, 1, byte[1]] ^ self.tables[short, 2, byte[2]] ^ self.tables[short, 3, byte[3]]
        rest = np.flatnonzero(by > _TABLED)
        if len(rest):
            x, left = out[rest], by[rest] - _TABLED
            for k in range(int(left.max()).bit_length()):
                t, on = self.powers[k], (left >> k) & 1 == 1
                y = x[on]
                x[on] = t[0][y & np.uint32(255)] ^ t[1][(y >> np.uint32(8)) & np.uint32(255)] ^ t[2][(y >> np.uint32(16)) & np.uint32(255)] ^ t[3][y >> np.uint32(24)]
            out[rest] = x
        return out


_SHIFT = _Shifts()


def word_crcs(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, tabled: int = 32) -> np.ndarray:
    """crc32 of each word: byte by byte for all words at once, those over ``tabled`` bytes one by one."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, tabled + 1), kind="stable")
    long = int((size > tabled).sum())
    out = np.empty(len(starts), dtype=np.uint32)
    raw = joined.tobytes() if long else b""
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    order = order[long:]
    first, n = starts[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    active = len(order)
    for p in range(int(n[0]) if active else 0):
        active = int(np.searchsorted(-n[:active], -p, side="left"))
        c = crc[:active]
        crc[:active] = _CRC[(c ^ joined[first[:active] + p]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def ngram_buckets(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray | None = None) -> list[np.ndarray]:
    """Buckets of the runs of one, two and three words that begin at each word (or at the words ``at``), whatever lies between.

    The CRC of a run is put together from those of its words, moved on by the bytes that follow.  Runs that would end
    beyond the last word have the bucket 0; callers leave them out.
    """
    crc, size = word_crcs(joined, starts, ends), ends - starts
    spaced = _SHIFT(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), size) ^ crc
    at = np.arange(len(crc)) if at is None else at
    found, run = [crc[at]], crc[at]
    for k in range(1, LONGEST):
        inside = at + k < len(crc)
        follow = np.where(inside, at + k, 0)
        run = np.where(inside, _SHIFT(run, size[follow] + 1) ^ spaced[follow], 0).astype(np.uint32)
        found.append(run)
    return [x % np.uint32(BUCKETS) for x in found]


class Block:
    """The words of some texts, and which n-grams lie inside a line and which cross from one into another."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined, self.starts, self.ends, first = words_of([t.translate(LOWER_AZ) for t in texts], NOT_ALNUM)
        self.words = np.diff(first)
        self.text = np.repeat(np.arange(len(texts)), self.words)
        self.line = np.cumsum(self.joined == 10)[self.starts] if len(self.starts) else np.zeros(0, dtype=np.int64)

    def _same(self, what: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(what), dtype=bool)
        if k < len(what):
            out[: len(what) - k] = what[k:] == what[: len(what) - k]
        return out

    def inside(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2, 3 words within a line: the text of each, and its bucket."""
        found = ngram_buckets(self.joined, self.starts, self.ends)
        masks = [self._same(self.line, k) if k else np.ones(len(self.starts), dtype=bool) for k in range(LONGEST)]
        return [(self.text[m], b[m]) for m, b in zip(masks, found, strict=True)]

    def crossing(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for runs that lie within a text but not within one line; only words near such places are hashed."""
        masks = [self._same(self.text, k) & ~self._same(self.line, k) for k in range(1, LONGEST)]
        begins = np.flatnonzero(masks[-1] | masks[0]) if len(self.starts) else np.zeros(0, dtype=np.int64)
        near = np.unique((begins[:, None] + np.arange(LONGEST)).ravel())
        near = near[near < len(self.starts)]
        found = ngram_buckets(self.joined, self.starts[near], self.ends[near], np.searchsorted(near, begins))
        return [(self.text[begins][m[begins]], b[m[begins]]) for m, b in zip(masks, found[1:], strict=True)]


def distinct_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """line and n, its occurrences in all texts; empty lines are left out.  Counted before and after the shuffle."""
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(df: DataFrame, crossing: bool) -> DataFrame:
    """bucket and n for every task over its texts (the first column), each counted as often as the second column says."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts, times = utf8(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for lo, hi in blocks(texts, 1 << 20):
                block = Block(texts[lo:hi])
                for text, bucket in block.crossing() if crossing else block.inside():
                    total += np.bincount(bucket, weights=times[lo:hi][text], minlength=BUCKETS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return df.mapInArrow(run, "bucket int, n bigint")


def feature_counts(docs: DataFrame, lines: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket's features occur in all texts: those inside ``lines`` times n, and those between lines.

    ``lines`` is what ``distinct_lines`` found in ``docs``.  BUCKETS rows come to the driver.
    """
    crossing = _counted(docs.select(F.col(text_col).alias("text"), F.lit(1).cast("long")), True)
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in _sums(_counted(lines.select("line", "n"), False).unionByName(crossing)).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, in doubles."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1.0) * (s.sum() + BUCKETS)) / ((s + 1.0) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def _summed(found: list[tuple[np.ndarray, np.ndarray]], n: int, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and sum of gains of each of ``n`` texts."""
    features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.float64)
    for text, bucket in found:
        features += np.bincount(text, minlength=n)
        weight += np.bincount(text, weights=gains[bucket], minlength=n)
    return features, weight.astype(np.int64)


def line_weights(lines: DataFrame, gains: np.ndarray) -> DataFrame:
    """key (128 bits), n, features and weight of each distinct line."""
    from xxhash import xxh3_128_digest

    shared = lines.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def judge(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column(0))
        parts = [_summed(Block(texts[lo:hi]).inside(), hi - lo, shared.value) for lo, hi in blocks(texts, 1 << 20)]
        return {"key": [xxh3_128_digest(t) for t in texts], "n": batch.column(1), "features": np.concatenate([p[0] for p in parts]), "weight": np.concatenate([p[1] for p in parts])}

    return map_arrow(lines.select("line", "n"), judge, "key binary, n bigint, features bigint, weight bigint")


def document_parts(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words, features and weight of the crossing n-grams, and the text's lines (key and occurrences), a row per row."""
    from xxhash import xxh3_128_digest

    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def judge(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column(1))
        words, features, weight, lines = [], [], [], []
        for lo, hi in blocks(texts, 1 << 20):
            block = Block(texts[lo:hi])
            f, w = _summed(block.crossing(), hi - lo, shared.value)
            words.append(block.words), features.append(f), weight.append(w)
            for t in texts[lo:hi]:
                own: dict[bytes, int] = {}
                for line in t.split(b"\n"):
                    if line:
                        key = xxh3_128_digest(line)
                        own[key] = own.get(key, 0) + 1
                lines.append([{"key": k, "times": n} for k, n in own.items()])
        return {"doc_id": batch.column(0), "words": np.concatenate(words), "features": np.concatenate(features), "weight": np.concatenate(weight), "lines": lines}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, judge, f"doc_id {kind}, words bigint, features bigint, weight bigint, lines array<struct<key: binary, times: bigint>>")


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A written table with a row per row of ``docs``: doc_id, words, n_features and weight, and ``row``, a number of its own.

    Null texts have no words.  Rows that repeat have equal weights; columns other than the two named are not read.
    """
    lines = materialize(distinct_lines(docs, text_col), "lines")
    aims = materialize(distinct_lines(target, target_col), "lines")
    gains = bucket_gains(feature_counts(docs, lines, text_col), feature_counts(target, aims, target_col))
    known = materialize(line_weights(lines, gains), "line-weights")
    parts = materialize(document_parts(docs, gains, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "parts")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total * HOT_SHARE  # so fewer than 1 / HOT_SHARE
    each = parts.select("row", F.explode("lines").alias("x")).select("row", "x.key", "x.times")
    values = known.select("key", F.col("features").alias("lf"), F.col("weight").alias("lw"), "n")
    few = F.broadcast(values.where(hot).drop("n"))
    met = each.join(few, "key").unionByName(each.join(few, "key", "left_anti").join(values.where(~hot).drop("n"), "key"))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("lf")).alias("lf"), F.sum(F.col("times") * F.col("lw")).alias("lw"))
    zero = F.lit(0).cast("long")
    out = parts.drop("lines").join(sums, "row", "left").select(
        "doc_id", "words", (F.col("features") + F.coalesce("lf", zero)).alias("n_features"), (F.col("weight") + F.coalesce("lw", zero)).alias("weight"), "row"
    )
    out = materialize(out, "weights")
    discard(lines, aims, known, parts)
    return out


def gumbel(id_text, seed: int = SEED):
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256 of seed and id: noise that is the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, and rank (from 1) of those drawn.

    Drawn are ``percent`` of the rows with ``least_words`` words or more (rounded down), by score, then id, a null id
    last; rows that repeat are drawn each on its own.  Null and empty texts have weight 0 and are never drawn; a null
    id gives the noise of the empty text.  An empty target gives gains of the documents alone, an empty table no rows.
    """
    found = weigh(docs, target, id_col, text_col, target_col)
    scored = found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id").cast("string"), seed))
    fit = scored.where(F.col("words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = numbered(fit, F.desc("score"), F.col("doc_id").asc_nulls_last(), "row", name="rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long"))
    rest = scored.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
