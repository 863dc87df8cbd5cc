import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from llm_texts import prose
from kinweave.llm import bpe, lang_id
from pyspark.sql import functions as F
from test_simhash import brute_fingerprint


def grams(text):
    text = re.sub(" +", " ", " " + "".join(c if c.isalpha() or ord(c) > 0xFFFF else " " for c in text.lower()) + " ")
    return [text[i : i + 4] for i in range(len(text) - 3)]


def share(known, text):
    return sum(g in known for g in grams(text)) / len(grams(text))


def language(texts):
    """The n-grams of the one language, and the mean share of n-grams that they are of its documents."""
    n = Counter(g for t in texts for g in set(grams(t)))
    known = {g for g, k in n.items() if k >= max(2, lang_id.LEAST_SHARE * len(texts))}
    return known, sum(share(known, t) for t in texts if grams(t)) / sum(bool(grams(t)) for t in texts)


def brute(rows, items):
    """(id, text) of the rows that all filtering stages leave; ids that are null come last."""
    left = [(d is None, d or 0, n, t) for n, (d, t) in enumerate(rows) if t and re.search(r"[^\W\d_]", t)]
    known, typical = language([t for _, t in {(d, t) for d, t in rows if t is not None}])
    left = [x for x in left if not grams(x[3]) or share(known, x[3]) >= 0.2 * typical]
    best = {}
    for none, d, n, t in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1,)), (-len(t), none, d, n, t))
    left = sorted(x[1:] for x in best.values())
    fps = [brute_fingerprint(x[3]) for x in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    left = [x for i, x in enumerate(left) if root[i] == i]
    return sorted((d if not none else -1, t) for none, d, _, t in left if not any(item in t for _, item in items))


def test_pipeline_like_brute_force(spark, frame, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(6)]
    rows = [(i, prose(rng, 120)) for i in range(60)]
    rows += [(100, None), (101, "12 34"), (102, rows[0][1] + "  "), (103, rows[1][1].replace(" ", "\n")), (104, rows[2][1])]
    rows += [(200 + i, prose(rng, 60) + " " + t + " " + prose(rng, 40)) for i, t in items]
    # ids that repeat with unlike texts, with two spellings and with near copies; null ids; a very long text
    two, three, four = (prose(rng, 90) for _ in range(3))
    rows += [(3, two), (4, two), (5, three), (5, three + "   "), (None, four), (None, four), (None, prose(rng, 50)), (7, rows[8][1]), (300, "long text " * 20000), (301, ""), (None, None)]
    rows += [(400 + i, three) for i in range(50)]
    # other scripts, and signs: no language explains them; one that is explained in part stays
    foreign = [(500, "Съешь же ещё этих мягких булок да выпей чаю " * 3), (501, "xqzv jkwq zzxv qqwk vvkj " * 9), (502, "Съешь чаю. " + prose(rng, 60))]
    rows += foreign
    left = {d for d, _ in brute(rows, items)}
    assert left & {500, 501, 502} == {502}
    frame(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    tok = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in brute(rows, items):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256) for r in found) == sorted(want)


def test_each_stage_on_odd_and_empty_tables(spark, frame, odd_rows, clashing, tmp_path):
    spark.createDataFrame([(1, prose(random.Random(1), 30)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    odd = frame(odd_rows)
    left = {"language_id": 6, "exact_dedup": 6, "near_dedup": 6, "decontamination": 9}  # of 9 rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, str(tmp_path))
        assert kept.columns == odd.columns and kept.count() == left[name], name
        assert stage(spark, frame([]), str(tmp_path)).count() == 0
        out = stage(spark, clashing.withColumns({"__row": F.lit(1), "__bucket": F.lit(2)}), str(tmp_path))
        assert set(clashing.columns) < set(out.columns) and out.count() == 2, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, str(tmp_path)).count() == 9 and last(spark, frame([]), str(tmp_path)).count() == 0 and last(spark, clashing, str(tmp_path)).count() == 2
