"""Postings as Parquet files partitioned by the day first seen: a change rewrites the days that it touches and no others.

Which days these are is found by reading the columns that decide it. Their rows are read (the others are pruned by
partition), changed and written over the same days, while their changes are counted in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from . import lifecycle

DAY = "seen_day"


@dataclass(frozen=True)
class DayTable:
    """A table of postings under a path; schema is that of its rows, without the day."""

    spark: SparkSession
    path: str
    schema: StructType

    def rows(self, days: list | None = None) -> DataFrame:
        """All rows, or those of some days, which may include none (rows without a first_seen_at)."""
        whole = StructType([*self.schema.fields]).add(DAY, DateType())
        rows = self.spark.read.schema(whole).parquet(self.path)
        if days is None:
            return rows
        known = F.col(DAY).isin([d for d in days if d is not None])
        return rows.filter(known | F.col(DAY).isNull() if None in days else known)

    def rewrite(self, days: DataFrame, change: Callable[[DataFrame], DataFrame], counts: dict[str, Column], gone: Column | None = None) -> dict[str, int]:
        """Changes the rows of some days (column seen_day, bounded by the number of days) and gives counts of what changed.

        change makes rows with the columns of the table and any flags; counts and gone are conditions on them. Rows that
        are gone aren't written; days that none is left of lose their folder. A change that is run again gives the same
        rows, so one that broke off is run again.
        """
        touched = [r[0] for r in days.select(DAY).distinct().collect()]
        if not touched:
            return dict.fromkeys(counts, 0)
        gone = F.lit(False) if gone is None else gone
        seen = Observation()
        rows = change(self.rows(touched).drop(DAY)).withColumn(DAY, F.to_date("first_seen_at"))
        kept_day = F.when(~gone, F.coalesce(F.col(DAY).cast("string"), F.lit("")))
        rows = rows.observe(seen, *[F.count_if(c).alias(k) for k, c in counts.items()], F.collect_set(kept_day).alias("_days"))
        _put(rows.filter(~gone).select(*self.schema.names, DAY), self.path, "overwrite")
        found = seen.get
        for day in touched:
            if ("" if day is None else day.isoformat()) not in found["_days"]:
                self._remove(day)
        return {k: found[k] for k in counts}

    def _remove(self, day) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        name = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{DAY}={name}")
        where.getFileSystem(conf).delete(where, True)


def _put(rows: DataFrame, path: str, mode: str) -> None:
    """Writes rows by day; a day with much in it is written in several files, by Spark's own balance."""
    rows.hint("rebalance", DAY).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def create(postings: DataFrame, path: str) -> DayTable:
    _put(postings.withColumn(DAY, F.to_date("first_seen_at")), path, "errorifexists")
    return DayTable(postings.sparkSession, path, postings.schema)


def upsert(table: DayTable, incoming: DataFrame, key: str = "dedup_key", order: str = "seq") -> dict[str, int]:
    """lifecycle.upsert() of the days that hold a key of incoming or that new keys are first seen on: inserted, updated.
    A row that the table has keeps its day."""
    incoming = lifecycle.latest(incoming, [key], order)
    held = incoming.select(key, F.to_date("first_seen_at").alias("_new")).join(table.rows().select(key, DAY), key, "left")
    # A key that the table has in a row without a day is told from one that it lacks by a flag.
    there = table.rows().filter(F.col(DAY).isNull()).select(key).distinct().withColumn("_undated", F.lit(True))
    days = held.join(there, key, "left").select(F.when(F.col(DAY).isNotNull() | F.col("_undated"), F.col(DAY)).otherwise(F.col("_new")).alias(DAY))
    did = F.col("_did")
    return table.rewrite(days, lambda rows: lifecycle.upsert(rows, incoming, key, order, flag="_did"), {"inserted": did == "inserted", "updated": did == "updated"})


def patch(table: DayTable, patches: DataFrame, key: str = "id", order: str = "seq") -> dict[str, int]:
    """lifecycle.patched() of the days with rows that have a patch: patched."""
    days = table.rows().select(key, DAY).join(patches.select(key), key, "left_semi")
    return table.rewrite(days, lambda rows: lifecycle.patched(rows, patches, key, order, flag="_hit"), {"patched": F.col("_hit")})


def retain(table: DayTable, as_of: Column, inactive_after: int, delete_after: int) -> dict[str, int]:
    """lifecycle.retained() of the days with rows to delete or to mark: marked (active rows not seen for a while, also
    those that are deleted then) and deleted."""
    flags = lambda rows: lifecycle.retention_flags(rows, as_of, inactive_after, delete_after)
    days = flags(table.rows()).filter("_stale OR _gone").select(DAY)

    def change(rows: DataFrame) -> DataFrame:
        return flags(rows).withColumn("is_active", F.col("is_active") & ~F.col("_stale"))

    return table.rewrite(days, change, {"marked": F.col("_stale"), "deleted": F.col("_gone")}, F.col("_gone"))
