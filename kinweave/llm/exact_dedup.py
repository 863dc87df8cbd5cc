"""Exact dedup by a heavy-hitter split.

Digests of the normalised texts are written once, as a narrow table.  A Misra-Gries pass over it finds every digest
that may be frequent; exact counts and winners of those few candidates are verified and broadcast (at most
``counters`` rows), so the rows of hot digests never move.  All other digests take an ordinary shuffle, in which no
digest has more than about 2 / ``counters`` of the rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tagged, without

#: Misra-Gries counters; also the most rows that are broadcast.
COUNTERS = 256
WHITE = "[\\x20\\x09-\\x0D]+"


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """doc_id, 32-byte SHA-256 of the text without [\\x20\\x09-\\x0D], code points of the text, a row tag."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256)).alias("digest"),
        F.length(text).alias("points"),
        (F.monotonically_increasing_id() if tag is None else tag).alias("tag"),
    )


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them every one with more than 2 / (counters + 1) of the rows."""

    def summary(batches):
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - cut for k, v in held.items() if v > cut})
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"])

    parts = digests.select("digest").mapInArrow(summary, "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def _winner():
    """The row that stays: most code points, then smallest id (null last), then smallest tag."""
    return F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag"))).alias("best")


def _grouped(digests: DataFrame, counters: int) -> DataFrame:
    """Each row of the written digest table with the size of its group and the row that stays (``best``)."""
    candidates = frequent(digests, counters)
    counted = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _winner())
    winners = materialize(counted, "winners")  # at most ``counters`` rows
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _winner()), "digest")
    return hot.unionByName(cold)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty or all-white texts form one group.  Among equal texts the row with most code
    points stays, then the smallest id; a null id loses to any other.  Rows that repeat an id and its text are rows of
    the group like others, and exactly one row of each group has ``kept``.  An empty table gives no rows.  Columns
    other than the two named are not read.
    """
    digests = materialize(digest_table(docs, id_col, text_col), "digests")
    return _grouped(digests, counters).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that have ``kept`` in ``exact_groups``, with all their columns: one of each group of equal texts.

    Rows are told apart by a tag, not by their ids, which may be null or repeat.  The documents are written once with
    that tag.  An empty table gives no rows.
    """
    rows, tag = tagged(docs, "exact-docs")
    digests = materialize(digest_table(rows, id_col, text_col, F.col(tag)), "digests")
    gone = materialize(_grouped(digests, counters).where(F.col("tag") != F.col("best.tag")).select(F.col("tag").alias(tag)), "gone")
    return without(rows, gone, tag).drop(tag)
