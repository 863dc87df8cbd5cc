"""SimHash near-dedup with a hierarchical index over Gray order.

Fingerprints with at most three differing bits agree in one of four blocks of 16 bits, so each different fingerprint is
dealt out four times, keyed by one block.  A key with more than ``LARGE`` fingerprints is dealt out again by the four
blocks of its other bits, and so on, as fingerprints within three bits agree in one of those as well.  Within a key, fingerprints are sorted by Gray rank, where neighbours share
most bits.  Sixteen neighbours make a node; a node holds the bits that all below it share, and sixteen nodes make the
node above.  Pairs of nodes are walked from the top: the differences in the bits that both share add up on the way
down, and a pair with more than three is dropped with all below it; nodes whose free and differing bits are three or
fewer are linked whole.  A task reports a spanning forest, never all pairs; components of the links are found by
alternating large and small stars on tables of links between different fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, discard, map_arrow, materialize, tagged, utf8, without

SHINGLE, BITS, SEED = 3, 3, 42
FAN = 16
#: Different fingerprints of one key beyond which it is split.
LARGE = 1 << 20
#: For each byte, its bits spread over eight counters of eight bits.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of each run of k words, A-Z lower-cased and joined by one space; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_AZ).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(size + 1) - 1
    starts = (stops - size)[: len(words) - k + 1].tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops[k - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingle hashes; no words give zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        found = shingle_hashes(text, k)
        n = len(found)
        if n:
            lanes = _SPREAD[np.array(found, dtype=np.uint64).view(np.uint8).reshape(n, 8)]
            cuts = np.arange(0, n, 255)
            ones = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From leaves up: the shared bits (mask) of each node and their values."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    ones, zeros = x, ~x
    found = [(np.full(len(x), full), x)]
    while len(ones) > FAN:
        cuts = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        found.append((ones | zeros, ones))
    return found


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of many pairs at once; the smallest member stands for each set."""
    while True:
        parent = _find(parent)
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        lo, hi = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
        np.minimum.at(parent, hi, lo)


def linked(x: np.ndarray, bits: int = BITS, chunk: int = 1 << 14) -> np.ndarray:
    """For fingerprints in Gray order, the smallest index linked to each, directly or through others."""
    levels = _levels(x)
    parent = np.arange(len(x))
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    todo = [(len(levels) - 1, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
    while todo:
        level, a, b = todo.pop()
        shared, value = levels[level]
        both = shared[a] & shared[b]
        differ = (value[a] ^ value[b]) & both
        near = np.bitwise_count(differ) <= bits
        whole = near & (np.bitwise_count(differ | ~both) <= bits)
        span = FAN**level
        if whole.any():
            # all below both nodes are within reach of each other
            for node in (a, b):
                first = node[whole] * span
                members = first[:, None] + np.arange(span)[None, :] if span > 1 else first[:, None]
                fits = members < len(x)
                parent = _unite(parent, np.broadcast_to(first[:, None], members.shape)[fits], members[fits])
            parent = _unite(parent, a[whole] * span, b[whole] * span)
        rest = near & ~whole
        if level and rest.any():
            a, b = a[rest], b[rest]
            n = len(levels[level - 1][0])
            ca = (a[:, None] * FAN + np.arange(FAN))[:, :, None]
            cb = (b[:, None] * FAN + np.arange(FAN))[:, None, :]
            ca, cb = np.broadcast_arrays(ca, cb)
            ok = (ca < n) & (cb < n) & (ca <= cb)
            ca, cb = ca[ok], cb[ok]
            todo += [(level - 1, ca[i : i + chunk], cb[i : i + chunk]) for i in range(0, len(ca), chunk)]
    return _find(parent)


def _dealt(rows: DataFrame, parts: int, bits: int) -> DataFrame:
    """Rows (fp, rest, key) once for each of ``parts`` blocks of the ``bits`` bits of ``rest``: the block joins the key."""
    width = bits // parts
    rest, copies = F.col("rest"), []
    for i in range(parts):
        low = width * i
        value = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << width) - 1)) if low else rest.bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftleft(F.shiftrightunsigned(rest, low + width), low) if low + width < 64 else F.lit(0).cast("bigint")
        below = rest.bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("bigint")
        number = F.shiftleft(F.col("key"), _index_bits(parts) + width).bitwiseOR(F.lit(i << width)).bitwiseOR(value)
        copies.append(F.struct(number.alias("key"), above.bitwiseOR(below).alias("rest")))
    return rows.select("fp", F.explode(F.array(*copies)).alias("x")).select("fp", F.col("x.rest").alias("rest"), F.col("x.key").alias("key"))


def _index_bits(parts: int) -> int:
    return max(1, (parts - 1).bit_length())


def keyed(fps: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """fp and key: any two fingerprints with at most ``bits`` differing bits meet under some key.

    Keys of more than ``large`` rows are split until they are smaller or the key's 59 bits are used up.
    """
    parts, left, used, number = bits + 1, 64, 0, 0
    todo, done = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("bigint").alias("key")), None
    while True:
        dealt = _dealt(todo, parts, left)
        used += _index_bits(parts) + left // parts
        left -= left // parts
        more = left // parts >= 4 and used + _index_bits(parts) + left // parts <= 59
        heavy = materialize(dealt.groupBy("key").count().where(F.col("count") > large).select("key"), "heavy") if more else None
        last = heavy is None or heavy.isEmpty()
        small = dealt if last else dealt.join(heavy, "key", "left_anti")
        small = small.select("fp", (F.col("key") * 8 + number).alias("key"))  # apart from keys of other rounds
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        number += 1
        todo = dealt.join(heavy, "key", "left_semi").select("fp", "rest", "key")


def link_keys(fps: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` with at most ``bits`` differing bits."""
    dealt = keyed(fps, bits, large)
    ranks = map_arrow(dealt, lambda t: {"key": t.column(1), "fp": t.column(0), "rank": gray_rank(t.column(0).to_numpy().view(np.uint64)).view(np.int64)}, "key bigint, fp bigint, rank bigint")
    sorted_keys = ranks.repartition("key").sortWithinPartitions("key", "rank")

    def run(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
            yield from _groups(key[:cut], fp[:cut], bits)
            held_key, held = key[cut:], fp[cut:]
        yield from _groups(held_key, held, bits)

    return sorted_keys.mapInArrow(run, "a bigint, b bigint")


def _groups(key: np.ndarray, fp: np.ndarray, bits: int):
    """Links within each key: small groups all at once by distance in the order, others through the index."""
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    out_a, out_b = [], []
    small = np.repeat(size <= FAN, size)
    k, f = key[small], fp[small]
    for d in range(1, FAN):
        hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= bits)) if len(k) > d else ()
        if len(hit):
            out_a.append(f[hit]), out_b.append(f[hit + d])
    for s, n in zip(first[size > FAN], size[size > FAN], strict=True):
        group = fp[s : s + n]
        root = linked(group, bits)
        moved = np.flatnonzero(root != np.arange(n))
        if len(moved):
            out_a.append(group[root[moved]]), out_b.append(group[moved])
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node and root (the smallest node reachable) for each node of ``links`` (a, b), by alternating stars.

    Each round writes the remaining links to the shared folder; the rounds grow with the logarithm of the longest
    chain.  Minima are pre-aggregated, and a link joins them as a plain equi-join, in which Spark may split a hub.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), name)
    while True:
        # large star: the higher neighbours of a node go to its lowest
        both = edges.select(F.col("low").alias("n"), F.col("high").alias("m")).union(edges.select(F.col("high").alias("n"), F.col("low").alias("m")))
        least = materialize(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("root")), name)
        large = edges.join(least, edges["low"] == least["n"]).select(F.col("high").alias("v"), "root").distinct()
        large = materialize(large.where("v <> root"), name)
        # small star: a node's lower neighbours and itself go to the lowest of them
        low = materialize(large.groupBy("v").agg(F.min("root").alias("best")), name)
        joined = large.join(low, "v")
        small = joined.where("root <> best").select(F.col("best").alias("low"), F.col("root").alias("high")).union(low.select(F.col("best").alias("low"), F.col("v").alias("high"))).distinct()
        small = materialize(small, name)
        discard(edges, least, large, low)
        if _is_star(small):
            return small.select(F.col("high").alias("node"), F.col("low").alias("root")).union(small.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        edges = small


def _is_star(edges: DataFrame) -> bool:
    """True if no node hangs on two others and no root hangs on another."""
    twice = edges.groupBy("high").count().where("count > 1")
    hung = edges.join(edges.select(F.col("high").alias("low")).distinct(), "low", "left_semi")
    return twice.isEmpty() and hung.isEmpty()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """doc_id, tag (0 unless one is given) and fp of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(0) if tag is None else tag).cast("bigint").alias("tag"))
    return map_arrow(rows, lambda t: {"doc_id": t.column(0), "tag": t.column(2), "fp": fingerprints(utf8(t.column(1))).view(np.int64)}, f"doc_id {kind}, tag bigint, fp bigint")


def _decided(table: DataFrame, bits: int) -> DataFrame:
    """Each row of a written fingerprint table with the first row of its component (``best``): id, null last, then tag."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tag").alias("tag")))
    ids = materialize(table.groupBy("fp").agg(first.alias("own")), "ids")
    roots = components(link_keys(ids.select("fp"), bits))
    member = materialize(roots.join(ids, roots["node"] == ids["fp"]).select("node", "root", "own"), "members")
    least = member.groupBy("root").agg(F.min("own").alias("least"))
    linked_fps = member.join(least, "root").select(F.col("node").alias("fp"), "least")
    known = materialize(ids.join(linked_fps, "fp", "left").select("fp", F.coalesce("least", "own").alias("best")), "known")
    return table.join(known, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero, which links like any other.  Documents with at most ``bits``
    differing bits are linked; component_id is the smallest id reachable (null ids count for nothing, and a component
    of null ids only has a null).  Rows that repeat have equal results.  An empty table gives no rows.  Columns other
    than the two named are not read.
    """
    table = materialize(fingerprint_table(docs, id_col, text_col), "fingerprints")
    return _decided(table, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id.

    Rows are told apart by a tag, not by their ids, which may be null (after all others) or repeat (any one of the
    rows in question stays, the same one in every job).  The documents are written once with that tag.  Null, empty
    and blank texts are near copies of each other.  An empty table gives no rows.
    """
    rows, tag = tagged(docs, "near-docs")
    table = materialize(fingerprint_table(rows, id_col, text_col, F.col(tag)), "fingerprints")
    gone = materialize(_decided(table, bits).where(F.col("tag") != F.col("best.tag")).select(F.col("tag").alias(tag)), "gone")
    return without(rows, gone, tag).drop(tag)
