"""Counts and estimates that dashboards show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import APPLICATION_STATUSES
from .enrich import classify_queue, geo_queue


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """The columns of several tables of one row each."""
    first, *others = (d.withColumn("_one", F.lit(1)) for d in one_row)
    for d in others:
        first = first.join(d, "_one")
    return first.drop("_one")


def stats_bar(postings: DataFrame, scores: DataFrame, applications: DataFrame) -> DataFrame:
    """indexed, scored, average (half up) and saved, as one row."""
    return _side_by_side(
        postings.agg(F.count_if("is_active").alias("indexed")),
        scores.agg(F.count("match_score").alias("scored"), F.floor(F.avg("match_score") + 0.5).alias("average")),
        applications.agg(F.count_if(F.col("status") == "saved").alias("saved")),
    )


def source_counts(postings: DataFrame, since: Column) -> DataFrame:
    """Live postings of each source, and those first seen since a moment; a source without name is ?."""
    on = F.col("is_active")
    return postings.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count_if(on).alias("live"), F.count_if(on & (F.col("first_seen_at") >= since)).alias("fresh"))


def board(applications: DataFrame) -> DataFrame:
    """The number of applications in each column of the board, also where there is none; unknown statuses are saved ones."""
    names = applications.sparkSession.createDataFrame([(s,) for s in APPLICATION_STATUSES], "status string")
    known = F.when(F.col("status").isin(*APPLICATION_STATUSES), F.col("status")).otherwise("saved")
    counts = applications.groupBy(known.alias("status")).agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def saved_map(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """Each posting with each of its users and that user's first application."""
    own = applications.groupBy(F.col("job_id").alias("id"), "user_id").agg(F.min("id").alias("application_id"))
    return postings.select("id").join(own, "id", "left")


def rescore_estimate(postings: DataFrame, cost_of: DataFrame, stages: dict[str, str], least: int, trips_at: float) -> DataFrame:
    """operation, jobs, estimate and headroom. cost_of: operation, usd_per_job; stages: operation to classify, geo or score."""
    scope = {"classify": classify_queue(postings, least), "geo": geo_queue(postings), "score": postings.filter(F.col("is_active") & (F.col("score_total") >= least))}
    counts = _side_by_side(*[scope[stage].agg(F.count("*").alias(name)) for name, stage in stages.items()])
    each = counts.select(F.explode(F.create_map(*[x for name in stages for x in (F.lit(name), F.col(name))])).alias("operation", "jobs"))
    cost = F.col("jobs") * F.col("usd_per_job")
    return each.join(cost_of, "operation").select("operation", "jobs", F.round(cost, 6).alias("estimate"), F.when(cost > trips_at, "TRIPS CAP").otherwise("OK").alias("headroom"))


def dimension_ratio(scores: DataFrame, value: dict[str, Column], most: dict[str, float]) -> DataFrame:
    """One row for each dimension of each row of scores: job_id, dimension, ratio of its maximum, bar (ratio up to 1)."""
    each = F.create_map(*[x for name, v in value.items() for x in (F.lit(name), v.cast("long"))])
    tops = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    rows = scores.select("job_id", F.explode(each).alias("dimension", "v")).withColumn("ratio", F.col("v").cast("double") / F.element_at(tops, F.col("dimension")))
    return rows.select("job_id", "dimension", "ratio", F.when(F.col("ratio").isNotNull(), F.least(F.lit(1.0), F.col("ratio"))).otherwise(F.lit(1.0)).alias("bar"))
