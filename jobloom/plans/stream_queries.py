"""Queries of the streaming forms: the given tables are read as file streams until all is taken, and the result read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import jobs
from . import bindings as B
from . import sql as S
from .registry import query
from .state_queries import BEST, STATES, shared_folder


@query(B.with_tables("SELECT * FROM states", B.HEALTH, STATES))
def t1_state_stream(spark, sf_dir):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    try:
        rows = B.health(spark, sf_dir).select("source", "run_at", "success", "error_message", "seq")
        path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
        middle = F.lit(rows.agg(F.expr("percentile_approx(run_at, 0.5)")).first()[0])
        put = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/{n}")
        # Two batches in the order of time; between them the stream stops and goes on from its state.
        for part in (F.col("run_at") <= middle, F.coalesce(F.col("run_at") > middle, F.lit(True))):
            rows.filter(part).write.mode("append").parquet(f"{path}/in")
            runs = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
            jobs.drained(jobs.source_states(runs, 3).writeStream.outputMode("update").foreachBatch(put), f"{path}/checkpoint")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    states = spark.read.parquet(f"{path}/out/*")
    last = states.groupBy("source").agg(F.max_by(F.struct(*[c for c in states.columns if c != "source"]), "n").alias("s")).select("source", "s.*")
    return last.select("source", "consecutive_failures", "suspended", B.stamp("suspended_at"), B.stamp("last_success_at"))


KEYED = f"keyed AS (SELECT *, {S.key('title', 'company', 'location')} AS dedup_key FROM postings)"
VALID = f"valid AS (SELECT * FROM ({BEST.split('(', 1)[1].rsplit(')', 1)[0].replace('PARTITION BY dedup_key', 'PARTITION BY id % 2, dedup_key')}) WHERE {S.valid_key('dedup_key')})"


@query(B.with_tables("SELECT coalesce(a.dedup_key, b.dedup_key) AS dedup_key, coalesce(a.id, b.id) AS id, coalesce(b.score_total, a.score_total) AS score_total, coalesce(b.title, a.title) AS title FROM (SELECT * FROM valid WHERE id % 2 = 0) a FULL JOIN (SELECT * FROM valid WHERE id % 2 = 1) b ON a.dedup_key = b.dedup_key", B.POSTINGS, KEYED, VALID))
def t2_upsert_stream(spark, sf_dir):
    """Postings come in two batches, even ids first; between them the stream stops and goes on from its checkpoint."""
    rows = B.postings(spark, sf_dir)
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    for part in (0, 1):
        rows.filter(F.col("id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        posts = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        jobs.drained(jobs.upserts(posts, f"{path}/table"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/table/1").select("dedup_key", "id", "score_total", "title")


#: What comes first: rows until a day, but every tenth, which comes later, with all others.
EARLY = "run_at <= TIMESTAMP '1995-06-15' AND id % 10 <> 0"
MARK = f"mark AS (SELECT max(run_at) FILTER ({EARLY}) - INTERVAL 2 DAY AS first, max(run_at) - INTERVAL 2 DAY AS last FROM ledger)"
LATE = f"NOT ({EARLY}) AND date_trunc('day', run_at) + INTERVAL 1 DAY <= first"


def _spend_stream(spark, sf_dir):
    """The ledger in two parts, after each of which the stream stops and goes on from its checkpoint; the path, and the
    progress of all batches."""
    rows = B.ledger(spark, sf_dir).select("id", "run_at", "operation", "cost_usd")
    path, progress = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}", []
    for part in (F.expr(EARLY), ~F.expr(EARLY)):
        rows.filter(part).write.mode("append").parquet(f"{path}/in")
        spend = jobs.daily_spend(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        progress += jobs.drained(spend.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/checkpoint")
    return path, progress


@query(B.with_tables(f"SELECT strftime(date_trunc('day', run_at), '%Y-%m-%d') AS day, operation, round(CAST(sum(cents) AS DOUBLE) / 1000000, 6) AS cost_usd FROM ledger, mark WHERE NOT ({LATE}) AND date_trunc('day', run_at) + INTERVAL 1 DAY <= last GROUP BY ALL", B.LEDGER, MARK))
def t3_daily_stream(spark, sf_dir):
    """Days that the watermark has closed, without the rows that came after theirs was."""
    path, _ = _spend_stream(spark, sf_dir)
    out = spark.read.schema("day timestamp, operation string, cost_usd double").parquet(f"{path}/out")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "operation", F.round("cost_usd", 6).alias("cost_usd"))


@query(B.with_tables(f"SELECT part, CASE part WHEN 0 THEN '1970-01-01' ELSE strftime(any_value(first), '%Y-%m-%d') END AS watermark, count(DISTINCT CASE WHEN part = 1 AND {LATE} THEN (date_trunc('day', run_at), operation) END) AS late_groups FROM ledger, mark, (SELECT unnest([0, 1]) AS part) GROUP BY part", B.LEDGER, MARK))
def t3_late_rows(spark, sf_dir):
    """For both parts, the watermark they met and how many groups of late rows were left out, by the stream's progress."""
    _, progress = _spend_stream(spark, sf_dir)
    rows = [(k, mark[:10], n) for k, (_, mark, n) in enumerate(jobs.late(progress))]
    return spark.createDataFrame(rows, "part int, watermark string, late_groups long")
