"""Source health: latest runs, failure streaks and suspension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SUSPEND_AFTER


def latest(health: DataFrame) -> DataFrame:
    """The last run of each source; equal times go to the larger seq."""
    return health.groupBy("source").agg(F.max_by(F.struct(*[c for c in health.columns if c != "source"]), F.struct("run_at", "seq")).alias("r")).select("source", "r.*")


def states(health: DataFrame, suspend_after: int = SUSPEND_AFTER) -> DataFrame:
    """Each source's state after all its runs: consecutive_failures, suspended, suspended_at, last_success_at, updated_at.

    Runs that only record a suspension (error_message 'suspended') change nothing. Everything follows from the last
    success, which is an aggregate, and the failures after it; of these only the first few are ranked, so a source's
    history meets in no one task.
    """
    runs = health.filter(~F.coalesce(F.col("error_message") == "suspended", F.lit(False)))
    at = F.struct("run_at", "seq")
    seen = runs.groupBy("source").agg(F.max(F.when(F.col("success"), at)).alias("_good"), F.max("run_at").alias("updated_at"))
    failed = runs.filter(~F.col("success")).join(seen.select("source", "_good"), "source").filter(F.col("_good").isNull() | (at > F.col("_good"))).select("source", "run_at", "seq")
    counts = failed.groupBy("source").agg(F.count("*").alias("consecutive_failures"))
    ranked = failed.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("run_at", "seq"))).filter(F.col("_n") <= suspend_after)
    nth = ranked.groupBy("source").agg(F.max(F.when(F.col("_n") == suspend_after, F.col("run_at"))).alias("suspended_at"))
    n = F.coalesce("consecutive_failures", F.lit(0))
    return seen.join(counts, "source", "left").join(nth, "source", "left").select("source", n.cast("int").alias("consecutive_failures"), (n >= suspend_after).alias("suspended"), "suspended_at", F.col("_good.run_at").alias("last_success_at"), "updated_at")


def overview(last: DataFrame, counts: DataFrame) -> DataFrame:
    """Sources that ran or that have postings (source, live, fresh), with defaults where one side has none."""
    both = last.join(counts, "source", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("source", F.coalesce("success", F.lit(True)).alias("success"), zero("jobs_found").alias("jobs_found"), "duration_ms", zero("live").alias("live"), zero("fresh").alias("fresh"))


def sort_keys(key: str, descending: bool) -> list[Column]:
    """Order by any column; an unknown duration counts as less than all others, ties go by source."""
    c = F.coalesce(F.col(key), F.lit(-(2**62))) if key == "duration_ms" else F.col(key)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("source").asc()]


def log_rows(health: DataFrame, chars: int = 1000) -> DataFrame:
    return health.withColumn("error_message", F.substring("error_message", 1, chars)).withColumn("run_date", F.to_date("run_at"))
