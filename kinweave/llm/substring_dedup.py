"""Substring dedup over sliding spans of sentences.

A sentence ends at a line break or after a word that ends in a full stop, exclamation or question mark of any common
script or an ellipsis, with or without closing quotes and brackets.  A sentence of more than ``LONG`` words is also cut
after the word with the smallest hash in each ``CUT`` consecutive words of it: so no piece is longer than ``CUT`` words,
unless it repeats one word, and the cuts fall alike wherever the text stands, but for ``CUT`` words at either end of what is repeated.

Every run of ``sentences`` consecutive sentences is hashed (XXH3, 128 bits of its words, joined by one space), and every
shorter run of two pieces or more with at least ``words`` words.  So a longer repeat is a chain of hashed runs, and is covered
from its first sentence to its last.

The first pass over the corpus counts the first 64 bits of run hashes, pre-aggregated.  Those that occur in several rows
fill a Bloom filter of at most ``BITS`` bits, which is broadcast; the second pass sends on the runs that it lets through,
with all 128 bits, and finds their first occurrence by an ordinary aggregation and join.  A full filter lets more runs
through and changes no result.  Every sentence that a non-first occurrence covers is removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, blocks, map_arrow, materialize, mix, tagged, utf8, word_hashes, words_of

#: Sentences of a run; a shorter run of two pieces or more counts as well if it has so many words.
SENTENCES, WORDS = 3, 20
#: Words of a sentence beyond which it is cut, and the words of which the one with the smallest hash is cut after.
LONG, CUT = 24, 8
#: The most bits of the filter, and its hash functions.
BITS, PROBES = 1 << 28, 2
#: Words of 64 bits that come to the driver as one record.
_PACKED = 4096


def _codes(signs: str) -> np.ndarray:
    return np.array(sorted(int.from_bytes(c.encode()) for c in signs), dtype=np.int64)


_STOPS = _codes(".!?\u2026\u203c\u2047\u2048\u2049\u3002\uff0e\uff61\uff01\uff1f\u0964\u0965\u06d4\u061f\u0589\u1362\u1367\u104b\u17d4\u0f0d")
_CLOSERS = _codes(")]}\"'\u00bb\u00ab\u2019\u2018\u201d\u201c\u203a\u2039\uff09\uff3d\uff63\u300d\u300f\u3011\u300b\u3009")
_LAST = np.isin(np.arange(256), np.concatenate([_STOPS, _CLOSERS]) & 255)


def _stops(joined, starts, ends) -> np.ndarray:
    """For each word, True if it ends in a stop, before any closing quotes and brackets."""
    out = np.zeros(len(ends), dtype=bool)
    at = np.flatnonzero(_LAST[joined[ends - 1]])
    end = ends[at]
    while len(at):
        one, two, three = (joined[np.maximum(end - k, 0)].astype(np.int64) for k in (1, 2, 3))
        two = two << 8 | one
        three = three << 16 | two
        out[at] = np.isin(one, _STOPS) | np.isin(two, _STOPS) | np.isin(three, _STOPS)
        size = np.where(np.isin(one, _CLOSERS), 1, np.where(np.isin(two, _CLOSERS), 2, np.where(np.isin(three, _CLOSERS), 3, 0)))
        more = (size > 0) & (end - size > starts[at])
        at, end = at[more], (end - size)[more]
    return out


def _sentences(joined, starts, ends, hashes, first) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a block, True if it ends a piece, and True if it ends a sentence, which ends a piece as well."""
    newlines = np.concatenate([[0], np.cumsum(joined == 10)])
    close = _stops(joined, starts, ends)
    nxt = np.append(starts[1:], len(joined))
    close |= newlines[nxt] > newlines[ends]
    close[first[1:][first[1:] > first[:-1]] - 1] = True
    whole = close.copy()
    stop = np.flatnonzero(close)
    size = np.diff(stop, prepend=-1)
    long = np.repeat(size > LONG, size)
    at = np.flatnonzero(long)  # words of long sentences, one sentence after the other
    if len(at):
        h, of = hashes[at], np.repeat(np.arange(len(stop)), size)[at]
        n = len(at) - CUT + 1
        least, place = h[:n].copy(), np.arange(n)
        for k in range(1, CUT):
            lower = h[k : k + n] <= least
            least[lower] = h[k : k + n][lower]
            place[lower] = np.flatnonzero(lower) + k
        cut = place[of[:n] == of[CUT - 1 :]]
        # not between equal words, or what repeats one word would fall into pieces of one word
        cut = cut[(cut + 1 == len(h)) | (h[cut] != h[np.minimum(cut + 1, len(h) - 1)])]
        close[at[cut]] = True
    return close, whole


def runs_of(texts: list[bytes], sentences: int = SENTENCES, words: int = WORDS):
    """For each text: byte range of each sentence, and of each run its 16-byte hash, first sentence and one beyond its last."""
    from xxhash import xxh3_128_digest

    for begin, end in blocks(texts):
        part = texts[begin:end]
        joined, starts, ends, first = words_of(part)
        if not len(starts):
            yield from ((np.zeros((0, 2), np.int64), [], np.zeros((0, 2), np.int64)) for _ in part)
            continue
        close, whole = _sentences(joined, starts, ends, word_hashes(joined, starts, ends), first)
        stop = np.flatnonzero(close) + 1  # words up to the end of each sentence
        head = np.concatenate([[0], stop[:-1]])
        number = np.arange(len(head))
        edge = np.searchsorted(head, first)  # the first sentence of each text
        of = np.searchsorted(edge, number, side="right") - 1
        upto = np.cumsum(whole[stop - 1])  # sentences that have ended with each piece
        # the last piece of the shortest run that starts at each piece
        last = np.minimum(np.searchsorted(upto, np.concatenate([[0], upto[:-1]]) + sentences), np.maximum(np.searchsorted(stop, head + words), number + 1))
        ok = last < edge[of + 1]
        # and the first piece of the shortest run that ends at each piece, unless that run starts there anyway
        back = np.maximum(np.searchsorted(np.concatenate([[0], upto[:-1]]), upto - sentences, side="right") - 1, np.minimum(np.searchsorted(head, stop - words, side="right") - 1, number - 1))
        more = back >= edge[of]
        more[more] = last[back[more]] != number[more]
        begins, lasts = np.concatenate([number[ok], back[more]]), np.concatenate([last[ok], number[more]])
        order = np.lexsort((lasts, begins))
        at, until = begins[order], lasts[order]
        offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        lo, hi = starts[head] - offset[of], ends[stop - 1] - offset[of]
        # all words of the block, joined by one space, and where each begins
        plain = b" ".join(joined.tobytes().split())
        place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        run = [xxh3_128_digest(plain[a:b]) for a, b in zip(place[head[at]].tolist(), (place[stop[until]] - 1).tolist(), strict=True)]
        where = np.searchsorted(at, edge)
        for i in range(len(part)):
            s, e = edge[i], edge[i + 1]
            x, y = where[i], where[i + 1]
            yield np.stack([lo[s:e], hi[s:e]], axis=1), run[x:y], np.stack([at[x:y] - s, until[x:y] + 1 - s], axis=1)


def _firsts(hashes: list[bytes]) -> dict[bytes, int]:
    """The first place of each different hash."""
    out: dict[bytes, int] = {}
    for i, h in enumerate(hashes):
        out.setdefault(h, i)
    return out


def _run_rows(batch, column: int, sizes: tuple[int, int]):
    """For all texts of a batch: the row, both halves of the hash, and the span of each different run."""
    rows, digests, spans = [], [], []
    for i, (_, hashes, places) in enumerate(runs_of(utf8(batch.column(column)), *sizes)):
        own = _firsts(hashes)
        rows.append(np.full(len(own), i))
        digests += own
        spans.append(places[list(own.values())])
    halves = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), halves, (np.concatenate(spans) if spans else np.zeros((0, 2), np.int64))


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(h + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _filter(repeated: DataFrame, most: int) -> np.ndarray:
    """A Bloom filter of the hashes (column h): about 16 bits for each, ``most`` bits at most."""
    bits = min(most, 1 << max(10, (16 * repeated.count() - 1).bit_length()))

    def place(batch):
        at = np.concatenate(_positions(batch.column(0).to_numpy().view(np.uint64), bits))
        return {"word": at >> 6, "mask": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)}

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(_PACKED, dtype=np.int64)
        block[group["word"].to_numpy() & (_PACKED - 1)] = group["mask"].to_numpy()
        return pd.DataFrame({"block": group["word"].iloc[:1] // _PACKED, "bits": [block.tobytes()]})

    words = map_arrow(repeated, place, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    packed = words.groupBy((F.col("word") / _PACKED).cast("bigint")).applyInPandas(pack, "block bigint, bits binary")
    out = np.zeros(max(bits >> 6, _PACKED), dtype=np.int64)
    for r in packed.toLocalIterator():  # bits / 8 bytes
        out[r["block"] * _PACKED : (r["block"] + 1) * _PACKED] = np.frombuffer(r["bits"], np.int64)
    return out[: bits >> 6]


def repeated_spans(rows: DataFrame, tag: str, sentences: int = SENTENCES, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``tag`` and spans (begin, end in sentences) of runs whose first occurrence is in another row.

    ``rows`` has doc_id (bigint, no nulls), text (no nulls) and the tag of each row.  The first occurrence is in the row
    with the smallest doc_id; among rows with the same, in any one of them.
    """
    sizes = (sentences, words)
    hashes = map_arrow(rows.select("text"), lambda t: {"h": _run_rows(t, 0, sizes)[1][:, 0].view(np.int64)}, "h bigint")
    repeated = materialize(hashes.groupBy("h").count().where("count > 1").select("h"), "repeated")
    shared = rows.sparkSession.sparkContext.broadcast(_filter(repeated, bits))

    def let_through(batch):
        table = shared.value
        row, halves, spans = _run_rows(batch, 2, sizes)
        keep = np.ones(len(row), dtype=bool)
        for at in _positions(halves[:, 0], len(table) << 6):
            keep &= (table[at >> 6] >> (at & 63)) & 1 == 1
        row, halves, spans = pa.array(row[keep]), halves[keep].view(np.int64), spans[keep]
        return {"h": halves[:, 0], "g": halves[:, 1], "doc_id": batch.column(0).take(row), "tag": batch.column(1).take(row), "begin": spans[:, 0], "end": spans[:, 1]}

    found = materialize(map_arrow(rows.select("doc_id", tag, "text"), let_through, "h bigint, g bigint, doc_id bigint, tag bigint, begin int, end int"), "runs")
    first = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min_by("tag", "doc_id").alias("first")).where("n > 1")
    later = found.join(materialize(first.select("h", "g", "first"), "firsts"), ["h", "g"]).where("tag <> first")
    return later.groupBy(F.col("tag").alias(tag)).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (what is left), n_sentences, n_removed, removed (ranges of sentences).

    The first occurrence of a run is in the row with the smallest id (a null id comes before all others; of rows with
    the same id any one, the same in every job), and there at the first place; it stays, and every sentence of any other
    occurrence goes, with the white space after it.  Null and empty texts have no sentences and give an empty text.  A
    text with no removed sentence is left as it is.  Ids are integers; columns other than the two named are not read; an
    empty table gives no rows.
    """
    lowest = F.lit(-(1 << 63))
    rows, tag = tagged(docs.select(F.coalesce(F.col(id_col).cast("bigint"), lowest).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "repeat-docs")
    found = materialize(repeated_spans(rows, tag, sentences, words, bits), "spans")
    stay, others = apart(rows, found, tag)
    others = others.join(found, tag, "left").select("doc_id", "text", "spans")
    both = others if stay is None else others.unionByName(stay.select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans")))

    def cut(batch):
        texts, spans = utf8(batch.column(1)), batch.column(2).to_pylist()
        out: dict = {"text": [], "n_sentences": [], "n_removed": [], "removed": []}
        for t, other, (places, hashes, own) in zip(texts, spans, runs_of(texts, sentences, words), strict=True):
            gone = np.zeros(len(places) + 1, dtype=np.int64)
            hit = {(s["begin"], s["end"]) for s in other or ()}
            if len(hashes):
                # repeats of other rows, wherever they stand here, and repeats within the text, all but the first
                first = np.fromiter(map(_firsts(hashes).__getitem__, hashes), dtype=np.int64, count=len(hashes))
                late = first != np.arange(len(hashes))
                if hit:
                    late |= np.fromiter((tuple(s) in hit for s in own[first].tolist()), dtype=bool, count=len(first))
                np.add.at(gone, own[late, 0], 1)
                np.add.at(gone, own[late, 1], -1)
            drop = np.cumsum(gone[:-1]) > 0
            out["n_sentences"].append(len(places))
            out["n_removed"].append(int(drop.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
            out["removed"].append([{"begin": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            if drop.any():
                kept, at = [], 0
                for a, b in edges.reshape(-1, 2):
                    kept.append(t[at : places[a, 0]])
                    at = int(places[b, 0]) if b < len(places) else len(t)
                t = b"".join([*kept, t[at:]])
            out["text"].append(t.decode("utf-8", "replace"))
        return out | {"doc_id": batch.column(0)}

    done = map_arrow(both, cut, "doc_id bigint, text string, n_sentences int, n_removed int, removed array<struct<begin:int,end:int>>")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))
