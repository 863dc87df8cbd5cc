import hashlib
import math
import random
import re
import zlib

import numpy as np
from kinweave.llm import queries, resample
from llm_texts import prose
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    """All runs of one to three words, in plain Python."""
    words = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target):
    """The contract, literally: a row (doc_id, n_features, weight, score, rank) for each document."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    total, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {}
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        rank.setdefault(r[0], []).append(k + 1)
    return sorted(((r[0], r[2], r[3], r[4], rank[r[0]].pop(0) if r[1] >= 20 and rank.get(r[0]) else None) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_like_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = queries.QUERIES["op13_importance_resample"](spark, SF)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint"] * 5 and df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(df) == plain(docs, target)


def test_odd_rows_and_shared_lines(spark, frame, odd_rows):
    rng = random.Random(5)
    shared = [prose(rng, 12) for _ in range(3)]
    rows = [*odd_rows, *((100 + i, "\n".join([shared[i % 3], "", "--", prose(rng, 15 + i % 9), shared[0], shared[0]])) for i in range(90)), (300, "line one\nline two " * 20), (301, "one\n\n\ntwo\nthree\nfour")]
    target = [(1, shared[1]), (2, None), (3, "")]
    want = plain([(r[0], r[1]) for r in rows], [t for _, t in target])
    assert sum(r[4] is not None for r in want) == 5 * sum(features(r[1])[0] >= 20 for r in rows) // 100
    assert got(resample.resample(frame(rows), frame(target))) == want


def test_repeated_rows_and_ties_are_drawn_one_by_one(frame):
    text = "word " * 30
    rows = [(7, text)] * 20 + [(8, text)] * 20
    found = resample.resample(frame(rows), frame([(1, text)])).where("rank IS NOT NULL")
    assert sorted(r["rank"] for r in found.collect()) == [1, 2]


def test_empty_tables_and_clashing_columns(frame, clashing):
    assert resample.resample(frame([]), frame([(1, "some words")])).count() == 0
    assert resample.resample(clashing, frame([])).count() == 2
    assert resample.resample(clashing.withColumns({c: F.lit(1) for c in ("row", "line", "n", "lines", "words", "weight", "n_features")}), clashing).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_hot_lines_are_looked_up_by_broadcast(frame, monkeypatch):
    rows = [(i, f"common line\nown {i} line\ncommon line") for i in range(60)]
    want = got(resample.resample(frame(rows), frame([(1, "own line")])))
    monkeypatch.setattr(resample, "HOT_SHARE", 2.0)
    assert got(resample.resample(frame(rows), frame([(1, "own line")]))) == want == plain(rows, ["own line"])


def test_crcs_of_runs_are_put_together_exactly():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abc019") for _ in range(rng.choice([1, 2, 5, 31, 32, 33, 63, 64, 65, 66, 129, 700, 4097]))) for _ in range(300)]
    joined = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    found = resample.ngram_buckets(joined, ends - size, ends)
    for k in (1, 2, 3):
        assert found[k - 1][: len(words) - k + 1].tolist() == [zlib.crc32(b" ".join(words[i : i + k])) % 10000 for i in range(len(words) - k + 1)]
