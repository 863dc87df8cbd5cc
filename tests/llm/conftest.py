import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
@pytest.fixture
def frame(spark):
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Null and empty texts, a null id, a repeated row, a very long text and signs of many scripts."""
    return [(1, None), (2, ""), (3, " \n\t"), (None, "Some words here."), (5, "Same row."), (5, "Same row."), (6, "wörd " * 30000), (7, "日本語 и ещё Ωmega 🙂 é"), (8, "a" * 50000)]


@pytest.fixture
def clashing(frame):
    """Documents whose further columns have the names that operators use inside."""
    from pyspark.sql import functions as F

    df = frame([(1, "One text."), (2, "Another text with words.")])
    return df.withColumns({c: F.lit(0) for c in ("digest", "tag", "h", "key", "kind", "rank", "fp", "score", "mark", "spans", "keep_id", "size", "path", "host", "number", "ids")})
