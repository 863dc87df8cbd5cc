import hashlib
import re
from collections import defaultdict

from kinweave.llm import common, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        t = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), doc is None, doc or 0))
    out = []
    for norm, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), sha) for m in members]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in df.collect())


def test_like_brute_force_with_a_hot_group(frame, odd_rows):
    rows = [*odd_rows, *[(100 + i, f"hot  text{' ' * (i % 3)}") for i in range(300)], *[(1000 + i, f"text {i // 2}") for i in range(200)]]
    df = exact_dedup.exact_groups(frame(rows), counters=4)
    assert got(df) == brute(rows)
    kept = [r for r in df.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({r.text_sha256 for r in df.collect()})


def test_one_row_of_each_group_stays(frame, odd_rows):
    left = exact_dedup.drop_exact(frame([*odd_rows, (9, "Same  row.")])).collect()
    ids = [r.doc_id for r in left]
    assert sorted(i for i in ids if i is not None) == [3, 6, 7, 8, 9] and None in ids


def test_rows_are_told_apart_and_not_ids(frame):
    """An id with two spellings of one text, ids shared by unlike texts, null ids, repeated rows."""
    rows = [(5, "A b"), (5, "A   b"), (6, "A b"), (7, "x"), (7, "y"), (8, "y"), (None, "z"), (None, "z"), (9, "z "), (None, "q"), (None, "q"), *((20 + i, "hot") for i in range(200))]
    for counters in (2, exact_dedup.COUNTERS):
        left = exact_dedup.drop_exact(frame(rows).repartition(5), counters=counters).collect()
        assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, "q"), (5, "A   b"), (7, "x"), (7, "y"), (9, "z "), (20, "hot")]
    assert exact_dedup.drop_exact(frame([])).count() == 0


def test_a_full_filter_and_a_fair_one_agree(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id AS tag", "id % 7 AS x")
    gone = common.materialize(spark.range(0, 1000, 3).selectExpr("id AS tag"), "gone")
    for size in (1 << 20, 1000, 2):
        monkeypatch.setattr(common, "FILTER", size)
        assert sorted(r.tag for r in common.without(rows, gone, "tag").collect()) == [i for i in range(1000) if i % 3]


def test_empty_and_clashing(frame, clashing):
    assert exact_dedup.exact_groups(frame([])).count() == 0
    assert exact_dedup.exact_groups(clashing).count() == 2
    assert exact_dedup.drop_exact(clashing).columns == clashing.columns


def test_frequent_digests_are_found(spark, frame):
    rows = [(i, "a" if i % 3 == 0 else f"t{i}") for i in range(900)]
    digests = exact_dedup.digest_table(frame(rows).repartition(7))
    assert hashlib.sha256(b"a").digest() in {bytes(r[0]) for r in exact_dedup.frequent(digests, 5).collect()}
