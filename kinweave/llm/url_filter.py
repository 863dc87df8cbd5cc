"""URL filters as a sort-merge range join, in DataFrame functions only.

A host's labels in reverse order, each closed by a dot, make its key, so that "a host and all its subdomains" is a
prefix of keys, which is an interval in byte order: it opens at the prefix and closes at the prefix and a byte FF, which
UTF-8 never has.  Intervals of prefixes are nested or disjoint.  ``sweep`` deals points, openings and closings out by
range and goes through them in order: the running sum of openings and closings is the height of the stack of active
rules, an opening puts its rule at that height, and a point's active rules are the last ones put at each height up to
its own.  What a range begins with, its height and the last rule at each height, is carried over from those before it.

The first sweep finds the rule hosts that each different host is under.  The second finds, for each different host and
path and each of those rule hosts, the innermost of its path rules, whose keys are the rule host's and the path.  The
longest of these decides for the host and path; urls meet it in an equi-join, in which a hot host may be split.  No row
holds the rules of a host or a stack of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_from(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from literal (host, path, verdict) entries, as a native relation."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules) + " AS t(host, path, verdict)")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    after = F.substr(url, F.instr(url, "://") + 3)
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.when(known, F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")
    path = F.when(known, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def sweep(points: DataFrame, rules: DataFrame, innermost: bool) -> DataFrame:
    """``point`` and ``rule`` for each rule whose key is a prefix of the point's key, or only the longest of them.

    ``points`` has key (binary) and point, ``rules`` key (binary, each once) and rule.
    """
    spark = points.sparkSession
    events = (
        rules.select("key", F.lit(0).alias("kind"), F.lit(1).alias("step"), "rule")
        .unionByName(points.select("key", F.lit(1).alias("kind"), F.lit(0).alias("step"), "point"), allowMissingColumns=True)
        .unionByName(rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step")), allowMissingColumns=True)
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(events.repartitionByRange(ranges, "key", "kind").withColumn("part", F.spark_partition_id()), "sweep")
    order = Window.partitionBy("part").orderBy("key", "kind")
    # one row for each range from here on where it says so: the heights that ranges begin with
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heights = dealt.groupBy("part").agg(F.sum("step").alias("step")).select("part", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("base"))
    stacked = dealt.join(heights, "part").withColumn("height", (F.col("base") + F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    opened = stacked.where("kind = 0").select("part", F.col("height").alias("level"), "key", "kind", "rule")
    levels = F.array("height") if innermost else F.sequence(F.lit(1), "height")
    asked = stacked.where("kind = 1 AND height > 0").select("part", F.explode(levels).alias("level"), "key", "kind", "point")
    placed = materialize(opened.unionByName(asked, allowMissingColumns=True), "stack")
    last = F.last("rule", True).over(Window.partitionBy("part", "level").orderBy("key", "kind"))
    # one row for each range and height: the last rule put at that height in the ranges before
    closing = placed.groupBy("part", "level").agg(F.max_by("rule", F.when(F.col("kind") == 0, F.col("key"))).alias("closing"))
    earlier = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = closing.select("part", "level", F.last("closing", True).over(earlier).alias("carried"))
    found = placed.withColumn("open", last).where("kind = 1").join(carry, ["part", "level"])
    return found.select("point", F.coalesce("open", "carried").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict.  A rule fits its host and all subdomains, if the url's path starts with the
    rule's (a null path counts as "/"); the longest rule (characters of host and path, then of host, then text) wins.
    Rules with a null or empty host, a byte 0 in it, or a null verdict are no rules; repeated rules count once, block before allow.  No fitting rule: a
    null rule and ``default``.  Null urls and urls without ``://`` have an empty host and path, which fit no rule.  Ids may be null or repeat.
    Empty tables give empty results, an empty rule table gives ``default`` everywhere; rows that repeat are judged each.
    """
    host, path = split_url(F.col("__url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    known = rules.where("host <> '' AND instr(host, '\\0') = 0 AND verdict IS NOT NULL").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict"
    )
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(host_key(F.col("host")).alias("host_key"), F.concat("host", "path").alias("rule"), "path", "verdict")
    different = urls.where("host <> ''").select("host", "path").distinct()
    hosts = different.select("host").distinct().select(host_key(F.col("host")).cast("binary").alias("key"), F.col("host").alias("point"))
    under = sweep(hosts, known.select("host_key").distinct().select(F.col("host_key").cast("binary").alias("key"), F.col("host_key").alias("rule")), False)
    pair_key = lambda path: F.concat(F.col("host_key").cast("binary"), F.lit(b"\x00"), path.cast("binary")).alias("key")
    pairs = different.join(under.select(F.col("point").alias("host"), F.col("rule").alias("host_key")), "host")
    rank = F.struct(F.length("rule").alias("n"), (-F.length("path")).alias("h"), "rule", "verdict")
    inner = sweep(pairs.select(pair_key(F.col("path")), F.struct("host", "path").alias("point")), known.select(pair_key(F.col("path")), rank.alias("rule")), True)
    best = inner.groupBy(F.col("point.host").alias("host"), F.col("point.path").alias("path")).agg(F.max("rule").alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
