"""Spend ledger: caps, rollups, alerts and estimates. Money is decimal, so sums don't depend on the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "cache_write_input_tokens", "cached_input_tokens", "output_tokens")


def month_start(as_of: Column) -> Column:
    return F.date_trunc("month", as_of)


def month_to_date(ledger: DataFrame, as_of: Column, user_id: int | None = None) -> DataFrame:
    rows = ledger.filter((F.col("run_at") >= month_start(as_of)) & (F.col("run_at") <= as_of))
    return rows if user_id is None else rows.filter(F.col("user_id") == user_id)


def spend(ledger: DataFrame) -> Column:
    return F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)), 6).cast("double")


def cap_status(ledger: DataFrame, caps: DataFrame, as_of: Column, global_cap: float) -> DataFrame:
    """For each stage of caps (operation, cap_usd): spent, stage_tripped, global_tripped; a cap is tripped from its value on."""
    month = month_to_date(ledger, as_of)
    by_stage = month.groupBy("operation").agg(F.sum("cost_usd").alias("spent"))
    total = month.agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("total"))
    # One row each: the caps are as many as there are stages, the total is one.
    rows = caps.join(by_stage, "operation", "left").withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    spent = F.coalesce("spent", F.lit(0))
    return rows.select("operation", spent.cast("double").alias("spent"), (spent >= F.col("cap_usd")).alias("stage_tripped"), (F.col("total") >= global_cap).alias("global_tripped"))


def by_operation(ledger: DataFrame) -> DataFrame:
    name = F.coalesce("operation", F.lit("unknown")).alias("operation")
    return ledger.groupBy(name).agg(spend(ledger).alias("cost_usd"), F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in TOKENS])


def cache_ratio() -> Column:
    """Tokens read from the cache for each hundred that went in; null if none did."""
    read, every = F.sum("cached_input_tokens"), F.sum(F.col("input_tokens") + F.col("cache_write_input_tokens") + F.col("cached_input_tokens"))
    return F.round(F.try_divide(read * F.lit(100.0), every), 6)


def daily(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.date_trunc("day", "run_at").alias("day"), "operation").agg(spend(ledger).alias("cost_usd"), *[F.sum(c).alias(c) for c in TOKENS])


def daily_matrix(ledger: DataFrame, operations: list[str]) -> DataFrame:
    """A row for each day from the first to the last, a column for each operation; days without calls are zeros."""
    day = F.to_date("run_at")
    sums = ledger.groupBy(day.alias("day")).pivot("operation", operations).agg(F.sum("cost_usd"))
    span = ledger.agg(F.min(day).alias("a"), F.max(day).alias("b")).filter("a IS NOT NULL")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(sums, "day", "left").select("day", *[F.coalesce(F.col(f"`{o}`"), F.lit(0)).cast("double").alias(o) for o in operations])


def job_count(notes: Column) -> Column:
    return F.regexp_extract(notes, r"jobs=(\d+)", 1).try_cast("long")


def mean_cost(ledger: DataFrame, as_of: Column, fallback: dict[str, float], days: int = 30) -> DataFrame:
    """For each operation of fallback: dollars a job over the days before as_of where a count is known, or the fallback."""
    n = job_count(F.col("notes"))
    recent = ledger.filter((F.col("run_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("run_at") <= as_of) & (n > 0))
    seen = recent.groupBy("operation").agg((F.sum("cost_usd").cast("double") / F.sum(n)).alias("seen"))
    known = ledger.sparkSession.createDataFrame(list(fallback.items()), "operation string, fallback double")
    return known.join(seen, "operation", "left").select("operation", F.coalesce("seen", "fallback").alias("usd_per_job"))


def new_alerts(tripped: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts (month_start, scope, operation) that were not sent; global ones are one for a month, whichever stage tripped."""
    keyed = tripped.withColumn("operation", F.when(F.col("scope") == "global", "*").otherwise(F.col("operation"))).distinct()
    return keyed.join(sent, ["month_start", "scope", "operation"], "left_anti")


def log_rows(ledger: DataFrame, chars: int = 500) -> DataFrame:
    """Rows as they are appended: notes in so many characters."""
    return ledger.withColumn("notes", F.substring("notes", 1, chars))
