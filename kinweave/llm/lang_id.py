"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language's common n-grams (by document frequency in a bounded, hashed sample of labelled documents) are put into
one table whose entries are bit masks of languages: at each of the positions that hash functions give an n-gram, the
language's bit is set.  The AND of an n-gram's entries is the set of all languages that hold it, in one lookup for all
of them.  A text's count for a language, over all its n-grams, is corrected for the share of n-grams that a filter of
that fill lets through by chance; the largest corrected count decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drawn, map_arrow, materialize, mix

N = 4
#: Share of what a language explains of its own documents that it has to explain of a text.
LEAST_EXPLAINED = 0.2
#: Bound of the sample: documents of each language that the filters are learned from.
SAMPLE = 1500
#: Positions of the table (a power of two) and hash functions.
POSITIONS, HASHES = 1 << 21, 3
#: An n-gram belongs to a language if this share of its sampled documents, and two at least, hold it.
LEAST_SHARE = 0.004
UND = "und"
#: Characters that are looked up at once, and the most languages that a table may hold.
CHARS, LANGUAGES = 400_000, 1024
_LETTER = re.compile(r"[^\W\d_]")


def _letters() -> np.ndarray:
    """For code points below 65536, the code of a letter or a blank; all others count as letters of their own."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], dtype=np.uint32)


_CODES = _letters()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of a block of texts, and where each text's begin (one more than texts).

    Texts are lower-cased; every run of other characters than letters is one blank, which also stands at both ends.
    """
    raw = [(" " + t.lower() + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    x = np.frombuffer(b"".join(raw), dtype=np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
    code = np.where(x < 0x10000, _CODES[np.minimum(x, 0xFFFF)], x)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    keep[begin[:-1]] = True
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def _windows(code: np.ndarray, begin: np.ndarray, n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that start at places lo to hi, and their numbers of texts; none reaches into a next text."""
    hi = max(lo, min(hi, len(code) - n + 1))
    value = np.zeros(hi - lo, dtype=np.uint64)
    for i in range(n):
        value = value * np.uint64(0x100000001B3) + code[lo + i : hi + i]
    text = np.repeat(np.arange(len(begin) - 1), np.diff(np.clip(begin, lo, hi)))
    inside = np.ones(hi - lo, dtype=bool)
    for i in range(1, n):
        cut = begin[1:] - i - lo
        inside[cut[(cut >= 0) & (cut < hi - lo)]] = False
    return mix(value[inside]), text[inside]


def ngrams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a block of texts, and where those of each text begin (one more than texts)."""
    code, begin = _codes(texts)
    hashes, text = _windows(code, begin, n, 0, len(code))
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def positions(hashes: np.ndarray, size: int, k: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(k)]


@dataclass
class Filters:
    """The table of masks; languages beyond 64 go to further planes."""

    languages: list[str]
    planes: list[np.ndarray]
    rates: np.ndarray
    hashes: int = HASHES
    fallback: int = 0
    #: Mean share of n-grams that each filter holds of the documents it was learned from.
    typical: np.ndarray | None = None
    _width: int = field(default=64, repr=False)

    def __post_init__(self) -> None:
        if self.typical is None:
            self.typical = np.ones(len(self.languages))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language's filter holds."""
        code, begin = _codes(texts)
        total = np.zeros(len(texts), dtype=np.int64)
        held = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(code), CHARS):  # a very long text in parts
            grams, text = _windows(code, begin, N, lo, lo + CHARS)
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            total += np.diff(at)
            where = positions(grams, len(self.planes[0]), self.hashes)
            for p, plane in enumerate(self.planes):
                mask = plane[where[0]]
                for w in where[1:]:
                    mask &= plane[w]
                for bit in range(min(self._width, len(self.languages) - p * self._width)):
                    sums = np.concatenate([[0], np.cumsum((mask >> plane.dtype.type(bit)) & plane.dtype.type(1), dtype=np.int64)])
                    held[:, p * self._width + bit] += sums[at[1:]] - sums[at[:-1]]
        return total, held

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and how much of the text the language explains, by what it explains of its own documents.

        That is the share of n-grams that its filter holds, over the mean share of the documents it was learned from; 1
        for a text without an n-gram, and where filters hold nothing of their own documents.
        """
        total, held = self.counts(texts)
        corrected = np.maximum(0.0, (held - total[:, None] * self.rates) / (1 - self.rates))
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = corrected.argmax(axis=1)
        top = corrected[np.arange(len(texts)), best]
        best = np.where(top > 0, best, self.fallback)
        # how much of what any language explains the best one explains, weighed by how much it leaves to the second
        second = np.partition(corrected, -2, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(texts))
        score = np.where(top > 0, top / np.maximum(top + second, 1e-9), 0.0)
        names = [self.languages[i] if _LETTER.search(t) else UND for i, t in zip(best, texts, strict=True)]
        usual = self.typical[best]
        explained = np.where((total > 0) & (usual > 0), top / np.maximum(1, total) / np.maximum(usual, 1e-9), 1.0)
        return names, np.where([n == UND for n in names], 0.0, score), explained


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Filters:
    """Learn filters from labelled documents: at most ``sample`` of each language, picked by a hash of the row.

    Null languages and null texts are not learned from, rows that repeat count once, and an n-gram needs two documents
    at least, so a language with one document is never given.  More than ``LANGUAGES`` different values are an error.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(LANGUAGES + 1).collect()}
    if len(per) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} different values of {lang_col}: not a column of languages")
    languages = sorted(per)
    if not languages:
        return Filters([], [np.zeros(2, dtype=np.uint8)], np.zeros(0))
    rows = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    picked = materialize(drawn(rows, sample, "lang", per).drop("id"), "sample")
    number = {x: i for i, x in enumerate(languages)}

    def grams(batch):
        texts = batch.column(1).to_pylist()
        lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
        out_l, out_h, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        begin, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size <= CHARS and k + 1 < len(texts):
                continue
            hashes, at = ngrams(texts[begin : k + 1])
            doc = np.repeat(np.arange(begin, k + 1), np.diff(at))
            order = np.lexsort((hashes, doc))
            h, d = hashes[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
            h, of = h[new], lang[d[new]]
            for i in np.unique(of):
                u, c = np.unique(h[of == i], return_counts=True)
                out_l.append(np.full(len(u), i)), out_h.append(u), out_n.append(c)
            begin, size = k + 1, 0
        return {"lang": np.concatenate(out_l), "gram": np.concatenate(out_h).view(np.int64), "n": np.concatenate(out_n)}

    counted = map_arrow(picked, grams, "lang bigint, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.coalesce(*(F.when(F.col("lang") == i, F.lit(max(2.0, LEAST_SHARE * min(sample, per[x])))) for x, i in number.items()))
    common = counted.where(F.col("n") >= least)

    def place(batch):
        where = positions(batch.column(1).to_numpy().view(np.uint64), POSITIONS, HASHES)
        lang = batch.column(0).to_numpy()
        return {"position": np.concatenate(where), "plane": np.tile(lang // 64, HASHES), "mask": np.tile(np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64)).view(np.int64), HASHES)}

    masks = map_arrow(common.select("lang", "gram"), place, "position bigint, plane bigint, mask bigint").groupBy("position", "plane").agg(F.bit_or("mask").alias("mask"))
    table = masks.toArrow()  # at most POSITIONS rows for 64 languages
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    planes = [np.zeros(POSITIONS, dtype=kind) for _ in range(-(-len(languages) // 64))]
    position, plane, mask = (table.column(i).to_numpy() for i in range(3))
    for p, entries in enumerate(planes):
        mine = plane == p
        entries[position[mine]] = mask[mine].view(np.uint64).astype(kind)
    fill = np.array([((planes[i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))])
    filters = Filters(languages, planes, np.minimum(fill**HASHES, 0.99), fallback=int(np.argmax([per[x] for x in languages])))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def shares(batch):
        lang, share = batch.column(0).to_pylist(), [np.zeros(0)]
        for lo, hi in _parts(texts := batch.column(1).to_pylist()):
            total, held = shared.value.counts(texts[lo:hi])
            own = np.array([number[x] for x in lang[lo:hi]])
            share.append(np.where(total > 0, (held[np.arange(hi - lo), own] - total * shared.value.rates[own]) / (1 - shared.value.rates[own]) / np.maximum(1, total), np.nan))
        return {"lang": [number[x] for x in lang], "share": np.concatenate(share)}

    means = map_arrow(picked, shares, "lang int, share double").where("NOT isnan(share)").groupBy("lang").agg(F.avg("share").alias("share"))
    for r in means.collect():
        filters.typical[r["lang"]] = max(0.0, r["share"])
    discard(picked)
    return filters


def _parts(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts of about ``CHARS`` together."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHARS or i + 1 == len(texts):
            out.append((begin, i + 1))
            begin, size = i + 1, 0
    return out


def _judged(filters: Filters, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What ``judge`` says of each text, some texts at a time."""
    found = [filters.judge(texts[lo:hi]) for lo, hi in _parts(texts)]
    return [n for f in found for n in f[0]], *(np.concatenate([np.zeros(0), *(f[i] for f in found)]) for i in (1, 2))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    A null text and one without a letter are ``und`` with score 0; a text whose n-grams no filter holds is given the
    most frequent language with score 0, as are texts too short for an n-gram; of languages with equal counts the first in
    order of their names is given.  With no labelled document all are
    ``und``.  Rows that repeat have equal results; columns other than the two named are not read; an empty table gives
    no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS entries a plane, whatever the corpus

    def run(batch):
        names, scores, _ = _judged(shared.value, batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

    return map_arrow(rows, run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """The documents in a language that the filters know, with all columns.

    ``und`` goes, and so does a text of which the best language explains less than ``LEAST_EXPLAINED`` of what it
    explains of its own documents on average: another language, or none.  Texts too short for an n-gram stay if they have
    a letter.  Null and empty texts go; rows that repeat and rows with a null id are judged each; with no labelled
    document to learn from all go; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names, _, explained = _judged(shared.value, [t or "" for t in batch.column(at).to_pylist()])
            keep = np.array([n != UND for n in names], dtype=bool) & (explained >= LEAST_EXPLAINED)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
