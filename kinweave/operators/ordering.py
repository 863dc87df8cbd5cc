"""Numbers for rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.scratch import materialize


def numbered(df: DataFrame, *order: Column | str, name: str = "number", total_of: str | None = None) -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order`` (best a total one; else equal rows come in any order).

    With ``total_of``, a column of numbers, also the column ``name``_total: its sum over all rows up to each.  Rows are
    dealt out by range and numbered within their range; a range begins at the sums of those before it, which are a
    window over one row for each range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = [F.count(F.lit(1)).alias("__rows")] + ([F.sum(total_of).alias("__sum")] if total_of else [])
    sizes = dealt.groupBy("__range").agg(*sums)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__range").orderBy(*order)
    starts = [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")] + ([F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")] if total_of else [])
    placed = dealt.withColumn(name, F.row_number().over(within) - 1)
    if total_of:
        placed = placed.withColumn(f"{name}_total", F.sum(total_of).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    found = placed.join(F.broadcast(sizes.select("__range", *starts)), "__range").withColumn(name, F.col(name) + F.col("__start"))
    if total_of:
        found = found.withColumn(f"{name}_total", F.col(f"{name}_total") + F.col("__before")).drop("__before")
    return found.drop("__range", "__start")
