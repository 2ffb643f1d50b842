"""Running totals inside groups of any size, and over all rows, without one task for a group or for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, stored

#: Rows of a range, at most about so many once the input has more than the session has partitions for.
RANGE_ROWS = 1 << 20
#: So many rows of a table by value, a few megabytes of numbers and names, are totalled in one task; sums are the same either way.
ONE_TASK = 1 << 16


def buckets_for(rows: int) -> int:
    """About the square root: as many buckets in a group as rows in a bucket."""
    return max(1, int(rows**0.5))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows that come before in the group, by bucket and then by order.

    Sums by bucket are added up first; a window then runs inside one bucket of one group at a time.
    """
    df = df.withColumn("_value", value)
    sums = df.groupBy(*group, bucket).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return placed.join(sums, [*group, bucket]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside", "_value")


def ranked(df: DataFrame, order: list[Column], totals: dict[str, Column], name: str, one_task: int = 0) -> DataFrame:
    """df with the sums of each of totals over all rows that come before a row in the order, written once, as a table.

    Rows are dealt to ranges of the order; ranges are summed up and the sums added up, one row a range. So many rows
    as one_task says, or fewer, are one range.
    """
    spark = df.sparkSession
    cells = df.withColumns({f"_v_{k}": v.cast("long") for k, v in totals.items()}).withColumns({f"_o{k}": c for k, c in enumerate(order)})
    keys = [f"_o{k}" for k in range(len(order))]
    total = lambda value, window: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = df.count()
    if many <= one_task:
        return stored(cells.select(*df.columns, *[total(f"_v_{k}", Window.orderBy(*keys)).alias(k) for k in totals]), name)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // RANGE_ROWS + 1)
    ranges = stored(cells.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals])
    sums = sums.select("_range", *[total(f"_s_{k}", Window.orderBy("_range")).alias(f"_b_{k}") for k in totals])
    placed = ranges.withColumns({f"_i_{k}": total(f"_v_{k}", Window.partitionBy("_range").orderBy(*keys)) for k in totals}).join(sums, "_range")
    out = stored(placed.select(*df.columns, *[(F.col(f"_b_{k}") + F.col(f"_i_{k}")).alias(k) for k in totals]), name)
    forget(ranges)
    return out
