"""Incremental forms of batch operators: source states, posting upserts and daily spend."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup, lifecycle
from ..schemas import SUSPEND_AFTER

STATE = "consecutive_failures int, suspended boolean, suspended_at timestamp, last_success_at timestamp, updated_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SourceState(StatefulProcessor):
    """One source's state machine: a success clears it, the n-th failure in a row suspends it.

    Runs of a batch count in the order of time; runs that are not later than the last one of earlier batches are left
    out, and runs that only record a suspension change nothing. Of a batch, only the failures after the last success are
    held, a chunk of rows at a time.
    """

    def __init__(self, suspend_after: int = SUSPEND_AFTER):
        self.suspend_after = suspend_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, suspended, since, good, last = self.state.get() if self.state.exists() else (0, False, None, None, None)
        failed, success, newest = [], None, last
        for chunk in rows:
            # Plain columns: most sources have few rows a batch, and data frame operations would take most of the time.
            runs = zip(chunk.run_at.tolist(), chunk.seq.tolist(), chunk.success.tolist(), chunk.error_message.tolist(), strict=True)
            runs = [(at, seq, ok) for at, seq, ok, said in runs if said != "suspended" and (last is None or at > last)]
            if not runs:
                continue
            at = max(r[0] for r in runs)
            newest = at if newest is None else max(newest, at)
            success = max([r[:2] for r in runs if r[2]] + ([success] if success is not None else []), default=None)
            failed += [r[:2] for r in runs if not r[2]]
            if success is not None:
                failed = [r for r in failed if r > success]
        if success is not None:
            failures, suspended, since, good = 0, False, None, success[0]
        if failed:
            nth = self.suspend_after - failures - 1
            failures += len(failed)
            if not suspended and failures >= self.suspend_after:
                suspended, since = True, sorted(failed)[nth][0]
        out = (failures, suspended, since, good, newest)
        plain = lambda x: x.to_pydatetime() if isinstance(x, pd.Timestamp) else x
        self.state.update(tuple(plain(x) for x in out))
        yield pd.DataFrame([(key[0], *out)], columns=["source", "consecutive_failures", "suspended", "suspended_at", "last_success_at", "updated_at"])

    def close(self) -> None:
        pass


def source_states(health: DataFrame, suspend_after: int = SUSPEND_AFTER) -> DataFrame:
    """A stream of states by source from a stream of runs. The session needs the RocksDB state store."""
    return health.groupBy("source").transformWithStateInPandas(statefulProcessor=SourceState(suspend_after), outputStructType=f"source string, {STATE}", outputMode="Update", timeMode="None")


def upserts(postings: DataFrame, root: str):
    """A writer that puts each batch of a posting stream into the table under root, one snapshot for each batch.

    The snapshot of batch n is made from that of batch n - 1 alone, so a batch that is replayed gives the same snapshot.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = dedup.richest(dedup.keyed(batch))
        valid, _ = dedup.split_by_key(fresh)
        if number:
            valid = lifecycle.upsert(spark.read.parquet(f"{root}/{number - 1}"), valid)
        valid.write.mode("overwrite").parquet(f"{root}/{number}")

    return postings.writeStream.foreachBatch(put)


def daily_spend(ledger: DataFrame, delay: str = "2 days") -> DataFrame:
    """Spend by day and operation; rows later than the delay are left out."""
    day = F.window("run_at", "1 day")
    sums = ledger.withWatermark("run_at", delay).groupBy(day, "operation").agg(F.sum("cost_usd").alias("cost_usd"))
    return sums.select(F.col("window.start").alias("day"), "operation", F.col("cost_usd").cast("double").alias("cost_usd"))


def drained(query_of, checkpoint: str) -> list:
    """Runs a stream over all that is there and ends; gives the progress of its batches."""
    run = query_of.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run.recentProgress


def late(progress: list) -> list[tuple[int, str, int]]:
    """batch, watermark and how many groups of late rows were left out, for each batch of an aggregation that took rows.

    Late rows meet in the groups they would have gone to before they are counted, so it is groups that are counted.
    """
    taken = [p for p in progress if p.numInputRows]
    return [(p.batchId, p.eventTime.get("watermark", ""), sum(o.numRowsDroppedByWatermark for o in p.stateOperators)) for p in taken]
