import random
import re

import numpy as np
import pytest
import xxhash
from llm_texts import prose
from kinweave.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(map(repr, out))


def test_like_brute_force_with_near_copies(frame, odd_rows):
    rng = random.Random(1)
    rows = list(odd_rows)
    for k in range(12):
        base = prose(rng, 400).split()
        for i in range(6):
            copy = list(base)
            for _ in range(i):
                copy[rng.randrange(len(copy))] = f"changed{rng.randrange(1000)}"
            rows.append((1000 + 10 * k + i, " ".join(copy)))
    got = simhash.near_groups(frame(rows)).collect()
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == brute_components([(r[0], r[1]) for r in rows])
    assert len({r.component_id for r in got if (r.doc_id or 0) >= 1000}) < 60


def test_index_links_like_brute_force():
    rng = np.random.default_rng(0)
    for n in (2, 17, 300, 2500):
        base = rng.integers(0, 1 << 63, size=max(1, n // 5), dtype=np.uint64)
        x = base[rng.integers(0, len(base), n)]
        for _ in range(4):
            x = np.where(rng.random(n) < 0.6, x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), x)
        x = np.unique(x)
        x = x[np.argsort(simhash.gray_rank(x))]
        i, j = np.triu_indices(len(x), 1)
        near = np.bitwise_count(x[i] ^ x[j]) <= 3
        assert (simhash.linked(x) == simhash._unite(np.arange(len(x)), i[near], j[near])).all()


@pytest.mark.parametrize("large", [3, 20, 1 << 20])
def test_split_keys_lose_no_link(spark, large):
    """Fingerprints that share a block, so that its key is split, once and again: the links are those of all pairs."""
    rng = np.random.default_rng(large)
    base = rng.integers(0, 1 << 62, size=12, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF) | np.uint64(0xABCD << 48)
    x = base[rng.integers(0, len(base), 250)]
    for _ in range(3):
        x = np.where(rng.random(len(x)) < 0.7, x ^ (np.uint64(1) << rng.integers(0, 48, len(x)).astype(np.uint64)), x)
    x = np.unique(x)
    i, j = np.triu_indices(len(x), 1)
    near = np.bitwise_count(x[i] ^ x[j]) <= 3
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")
    keys = simhash.keyed(fps, large=large)
    assert (keys.groupBy("key").count().agg({"count": "max"}).first()[0] == len(x)) == (large > len(x))
    links = simhash.link_keys(fps, large=large).toPandas()
    number = {v: k for k, v in enumerate(x.view(np.int64).tolist())}
    a, b = (links[c].map(number).to_numpy() for c in ("a", "b"))
    assert (simhash._unite(np.arange(len(x)), a, b) == simhash._unite(np.arange(len(x)), i[near], j[near])).all()


def test_one_row_of_each_component_stays(spark, frame, odd_rows):
    """Repeated ids, ids shared by unlike texts, null ids and repeated rows: rows are dropped, not ids."""
    rng = random.Random(5)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (3, b + " "), (3, b), (4, None), (4, ""), (None, " "), (8, "long " * 60000), *((10 + i, a) for i in range(300))]
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.drop_near(frame(rows)).collect())
    assert [(n, i, t.strip()) for n, i, t in left] == sorted([(False, 1, a), (False, 2, b), (False, 4, ""), (False, 8, ("long " * 60000).strip()), (True, 0, c)])
    every = [r for r in odd_rows]
    kept = [(r.doc_id, r.text or "") for r in simhash.drop_near(frame(every)).collect()]
    assert len(kept) == len({brute_fingerprint(t) for _, t in every}) and kept.count((5, "Same row.")) == 1
    assert simhash.drop_near(frame([])).count() == 0


def test_long_chain_of_links(spark):
    rng = random.Random(3)
    fp, chain = rng.getrandbits(64), []
    for _ in range(40):
        chain.append(fp - (1 << 64) if fp >> 63 else fp)
        for b in rng.sample(range(64), 3):
            fp ^= 1 << b
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "a bigint, b bigint")
    found = simhash.components(links).collect()
    assert {r.root for r in found} == {min(chain)} and {r.node for r in found} == set(chain)


def test_empty_and_clashing(frame, clashing):
    assert simhash.near_groups(frame([])).count() == 0
    assert simhash.near_groups(clashing).count() == 2
    assert simhash.drop_near(clashing).columns == clashing.columns
