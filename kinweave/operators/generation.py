"""Answers of theme providers: distinct payloads, a cache of recorded answers, providers tried in order.

A provider is a function from a list of payloads to a list of answers of the same length.  It may raise ``Refused`` for
payloads that it declines for safety, which is a result, and ``Unavailable``, which hands the payload on to the next
provider; any other error ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str], str]
ANSWERS = "request string, payload string, answer string, outcome string, provider string, attempts int"


class Refused(Exception):
    """The provider declines a payload; no other provider is asked."""


class Unavailable(Exception):
    """The provider can't answer now; the next one is asked."""


def request_key(payload, version: str):
    """What an answer is recorded under: the exact payload and the version of prompt and settings."""
    return F.sha2(F.concat_ws("|", F.lit(version), payload).cast("binary"), 256)


def answered(payloads: DataFrame, providers: list[tuple[str, Provider]], version: str = "v1") -> DataFrame:
    """request, payload, answer, outcome, provider and attempts for each different, non-null payload, asked once.

    Outcomes: answered, refused (by the provider named), failed (no provider was available; provider is null).
    """
    different = payloads.select("payload").where("payload IS NOT NULL").distinct().select(request_key(F.col("payload"), version).alias("request"), "payload")

    def ask(payload: str) -> tuple:
        for attempt, (name, provider) in enumerate(providers, 1):
            try:
                return provider(payload), "answered", name, attempt
            except Refused:
                return None, "refused", name, attempt
            except Unavailable:
                continue
        return None, "failed", None, len(providers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [ask(p) for p in pdf["payload"]]
            yield pdf.assign(**{c: [f[i] for f in found] for i, c in enumerate(("answer", "outcome", "provider", "attempts"))})

    return different.mapInPandas(run, ANSWERS)


def run_with_cache(payloads: DataFrame, cache: DataFrame, providers: list[tuple[str, Provider]], version: str = "v1") -> DataFrame:
    """The answers to all payloads, recorded ones first, with ``hit``; what is not a hit is what a cache has to add.

    ``cache`` has the columns of ``answered``.  Only answered and refused requests count as recorded; those that failed
    are asked again.
    """
    wanted = payloads.select("payload").where("payload IS NOT NULL").distinct().withColumn("request", request_key(F.col("payload"), version))
    recorded = cache.where("outcome IN ('answered', 'refused')")
    hits = recorded.join(wanted.select("request"), "request", "left_semi").withColumn("hit", F.lit(True))
    missing = wanted.join(recorded.select("request"), "request", "left_anti")
    return hits.unionByName(answered(missing, providers, version).withColumn("hit", F.lit(False)))


def theme_rows(rows: DataFrame, payload: str, answers: DataFrame) -> DataFrame:
    """``rows`` with answer, outcome and provider of their payload; rows without a payload have nulls."""
    return rows.join(answers.select(F.col("payload").alias(payload), "answer", "outcome", "provider"), payload, "left")
