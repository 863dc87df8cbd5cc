"""Reviews, recorded values and matched topics on small tables."""

import pytest
from kinweave.operators import clustering as cl
from kinweave.operators import published as pub
from kinweave.operators import review


def test_problems_of_reviews(spark):
    rows = [("a", 1.0, "x"), ("a", 5.0, "x"), (None, 0.5, "x"), ("b", None, "y"), ("c", float("nan"), "y")]
    df = spark.createDataFrame(rows, "id string, score double, provider string")
    found = {(r.problem, r.column): r.n for r in review.problems(df, "id", ("score", "other"), ("provider", "model")).collect()}
    assert found == {("missing", "other"): 5, ("hidden", "provider"): 5, ("unnamed", "id"): 1, ("repeated", "id"): 1, ("out of range", "score"): 3}


def test_sound_and_empty_reviews(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5)], "id string, score int")
    assert review.problems(df, "id", ("score",), ("provider",)).collect() == []
    assert review.problems(df.limit(0), "id", ("score",)).collect() == []
    assert [tuple(r) for r in review.problems(df.limit(0), "id", ("score", "other")).collect()] == [("missing", "other", 0)]


def test_what_was_not_recorded_is_an_error(spark):
    rows, known = spark.createDataFrame([("a",), ("b",), ("a",)], "text string"), spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "text string, v int")
    assert sorted(map(tuple, review.recorded(rows, known, "text").collect())) == [("a", 1), ("a", 1), ("b", 2)]
    for bad in ("d", None):
        with pytest.raises(Exception, match="nothing recorded for text"):
            review.recorded(spark.createDataFrame([("a",), (bad,)], "text string"), known, "text").collect()


def test_matched_topics_keep_each_side_to_its_knee(spark):
    words = lambda key: spark.createDataFrame([(c, f"{key}{c}{i}", w) for c in (1, 2) for i, w in enumerate([100.0, 50.0, 20.0] + [3 - k / 30 for k in range(60)])], f"{key} int, word string, weight double")
    matches = spark.createDataFrame([(1, 2), (2, 9), (8, 8)], "a int, b int")
    got = {(r.a, r.b, r.side, r.word) for r in pub.matched_topics(matches, words("a"), words("b")).collect()}
    kept = {key: {(r[key], r.word) for r in cl.keep_to_knee(words(key), key, "word", "weight").collect()} for key in "ab"}
    want = {(a, b, "a", w) for a, b in [(1, 2), (2, 9), (8, 8)] for c, w in kept["a"] if c == a} | {(a, b, "b", w) for a, b in [(1, 2), (2, 9), (8, 8)] for c, w in kept["b"] if c == b}
    assert got == want
    sizes = [sum(1 for g in got if g[:3] == side) for side in ((1, 2, "a"), (1, 2, "b"), (2, 9, "a"), (2, 9, "b"), (8, 8, "a"))]
    assert all(3 <= n <= 5 for n in sizes[:3]) and sizes[3:] == [0, 0]  # of 63 words; a side without words keeps the other
