"""Deduplication and key repair of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keyed(postings: DataFrame) -> DataFrame:
    return postings.withColumn("dedup_key", T.dedup_key(F.col("title"), F.col("company"), F.col("location")))


def split_by_key(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid dedup_key, and the others, which are kept apart before an upsert."""
    ok = T.valid_key(F.col("dedup_key"))
    return postings.filter(ok), postings.filter(~ok)


def richest(postings: DataFrame) -> DataFrame:
    """One row for each valid dedup_key: highest tier, then listed pay, then the longest description, then the first by
    seq. Rows without a valid key pass through, each as a group of its own. One aggregate over one reading of postings,
    so rows meet map-side first and each key is made once."""
    solo = F.when(~T.valid_key(F.col("dedup_key")), F.monotonically_increasing_id())
    paid = ((F.coalesce("salary_min_usd", F.lit(0)) != 0) | (F.coalesce("salary_max_usd", F.lit(0)) != 0)).cast("int")
    rank = F.struct("source_tier", paid, F.length(T.or_empty(F.col("description"))), -F.col("seq"))
    rows = postings.withColumn("_solo", solo)
    best = rows.groupBy(F.when(F.col("_solo").isNull(), F.col("dedup_key")).alias("_key"), "_solo").agg(F.max_by(F.struct(*postings.columns), rank).alias("r"))
    return best.select("r.*")


def repair_collisions(rows: DataFrame, day) -> DataFrame:
    """rows with an action: canonical (the oldest of a title and company), deleted (others first seen since day), kept.

    A canonical row takes the newest last_seen_at of its group; an inactive one whose group has members that go is active
    again and its reject reason is cleared. Rows without title or company are kept apart, not grouped.
    """
    named = (T.strip(T.or_empty(F.col("title"))) != "") & (T.strip(T.or_empty(F.col("company"))) != "")
    order, rest = rows.columns, rows.filter(~named).withColumn("action", F.lit("kept"))
    group = Window.partitionBy(F.lower("title"), F.lower("company"))
    rows = rows.filter(named).withColumn("_n", F.row_number().over(group.orderBy("first_seen_at", "id")))
    gone = (F.col("_n") > 1) & (F.col("first_seen_at") >= day)
    rows = rows.withColumn("_gone", gone).withColumn("_any", F.max("_gone").over(group)).withColumn("_newest", F.max(F.when(F.col("_gone") | (F.col("_n") == 1), F.col("last_seen_at"))).over(group))
    repaired = (F.col("_n") == 1) & F.col("_any")
    rows = rows.withColumn("action", F.when(F.col("_gone"), "deleted").when(repaired, "canonical").otherwise("kept"))
    again = repaired & ~F.col("is_active")
    rows = rows.withColumns({
        "last_seen_at": F.when(repaired, F.greatest("last_seen_at", "_newest")).otherwise(F.col("last_seen_at")),
        "geo_reject_reason": F.when(again, F.lit(None)).otherwise(F.col("geo_reject_reason")),
        "is_active": F.col("is_active") | again,
    })
    return rows.select(*order, "action").unionByName(rest)


def backfill_keys(rows: DataFrame) -> DataFrame:
    """rows with old two-part keys get the new key; of the rows of one key the oldest stays: columns new_key, survives."""
    bars = F.length("dedup_key") - F.length(F.replace("dedup_key", F.lit("|"), F.lit("")))
    new = F.when(F.coalesce(bars, F.lit(0)) < 2, T.dedup_key(F.col("title"), F.col("company"), F.col("location"))).otherwise(F.col("dedup_key"))
    first = F.row_number().over(Window.partitionBy("new_key").orderBy("first_seen_at", "id")) == 1
    return rows.withColumn("new_key", new).withColumn("survives", first)


def new_uploads(uploads: DataFrame, existing: DataFrame, chars: int, least: int = 100) -> DataFrame:
    """Uploads (user_id, seq, body) whose bytes and whose text in so many characters are new for their user, with
    text_hash, bytes_hash and is_active for the first profile of a user. Short texts are refused."""
    rows = uploads.filter(F.length("body") >= least).withColumn("bytes_hash", T.fingerprint(F.col("body"))).withColumn("text_hash", T.fingerprint(F.col("body"), chars))
    for c in ("bytes_hash", "text_hash"):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", c).orderBy("seq"))).filter("_n = 1").drop("_n")
        rows = rows.join(existing.select("user_id", c).distinct(), ["user_id", c], "left_anti")
    owners = existing.select("user_id").distinct().withColumn("_has", F.lit(True))
    rows = rows.join(owners, "user_id", "left")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) == 1
    return rows.withColumn("is_active", first & F.col("_has").isNull()).drop("_has")
