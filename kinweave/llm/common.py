"""Helpers shared by the text operators: shared scratch tables, splits by id, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from kinweave.scratch import discard as discard
from kinweave.scratch import materialize as materialize
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch may hold on its way to a Python worker; a batch is closed when either is reached.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Buckets of the filter that ``without`` broadcasts, whatever the tables hold.
FILTER = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, for tables with very long texts.

    Both are settings of the session, which stay as they are afterwards, as plans are run later than they are made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def tagged(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written once with a number for each row, and that column's name: all later jobs agree on the numbers."""
    tag = fresh(docs, "__row")
    return materialize(docs.withColumn(tag, F.monotonically_increasing_id()), name), tag


def apart(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame]:
    """``rows`` in two: those whose ``key`` (not null) is surely not in ``keys``, a written table with that column, and the others.

    A filter of at most ``FILTER`` hashed buckets is broadcast, so that only the others need to be shuffled to meet
    ``keys`` itself.  Once ``keys`` fills half of the buckets the filter has little to say: then all rows are others.
    """
    name = fresh(rows, "__bucket")
    bucket = F.pmod(F.xxhash64(key), F.lit(FILTER))
    filled = materialize(keys.select(bucket.alias(name)).distinct(), "filter")
    if filled.count() > FILTER // 2:
        return None, rows
    rows = rows.withColumn(name, bucket)
    return rows.join(F.broadcast(filled), name, "left_anti").drop(name), rows.join(F.broadcast(filled), name, "left_semi").drop(name)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` (not null) is not in ``gone``, a written table of that column."""
    stay, others = apart(rows, gone, key)
    left = others.join(gone, key, "left_anti")
    return left if stay is None else stay.unionByName(left)


def drawn(rows: DataFrame, bound: int, within: str | None = None, totals: dict | int | None = None) -> DataFrame:
    """At most ``bound`` rows of ``rows`` (of each value of ``within``, not null), picked by a hash of all columns.

    Rows that are equal in all columns are one here, so neither null nor repeated ids bring more rows.  ``totals``: the
    number of rows, by value if ``within`` is given; counted if not.  A threshold of the hash leaves about ``bound``
    rows, of which the first are taken by its order.
    """
    if totals is None:
        totals = {r[0]: r[1] for r in rows.groupBy(within).count().collect()} if within else rows.count()
    draw, most = fresh(rows, "__draw"), 1 << 62
    hashed = rows.withColumn(draw, F.pmod(F.xxhash64(*rows.columns, F.lit(17)), F.lit(most)))
    share = lambda n: int(most * min(1.0, 1.1 * bound / max(1, n)))
    edge = F.coalesce(*(F.when(F.col(within) == x, F.lit(share(n))) for x, n in totals.items()), F.lit(0)) if within else F.lit(share(totals))
    some = hashed.where(F.col(draw) <= edge).dropDuplicates(rows.columns)
    place = fresh(some, "__place")
    window = Window.partitionBy(within if within else F.lit(0)).orderBy(draw, *rows.columns)
    return some.withColumn(place, F.row_number().over(window)).where(F.col(place) <= bound).drop(place, draw)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """draw, id, y and text of at most ``sample`` labelled ids, drawn by a hash of the id, one row for each.

    Labels that contradict each other for an id, null labels and null ids are not learned from; of rows that share an
    id the one whose text has the smallest hash is.  Ids and labels of the sample are broadcast.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).alias("top"))
    picked = known.where("y = top").select("id", "y", F.xxhash64(F.col("id").cast("string"), F.lit(11)).alias("draw")).orderBy("draw", "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    return rows.groupBy("id").agg(F.min("y").alias("y"), F.min("draw").alias("draw"), F.min_by("text", F.xxhash64("text")).alias("text"))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` for a function that takes a batch (and what ``setup`` built once per task) and gives columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch, state) if setup else fn(batch)
                yield pa.RecordBatch.from_arrays([_as_array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


#: Lower-cases A-Z only.
LOWER_AZ = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: 1 where a byte is one of [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: True for bytes outside words of letters and digits, once A-Z are lower-cased: all of ASCII but those.
NOT_ALNUM = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.p = _powers(_P, 1 << 16)
        self.q = _powers(_PINV, 1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.p):
            size = 1 << (n - 1).bit_length()
            self.p, self.q = _powers(_P, size), _powers(_PINV, size)
        return self.p, self.q


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(texts: list[bytes], between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a block of texts at once.

    Words are maximal runs without bytes that are true in ``between`` ([\\x20\\x09-\\x0D] if not given; a newline is one
    always).  Gives the joined bytes, each word's start and end in them, and
    for each text the number of its first word (one entry more than texts).
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = between[joined]
    inside = ~space
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    first = np.searchsorted(starts, offsets, side="left")
    return joined, starts, ends, first


def word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, from running sums, then mixed."""
    n = len(joined)
    p, q = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    value = (sums[ends] - sums[starts]) * q[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes add up to about ``limit``, so that working arrays stay small."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
