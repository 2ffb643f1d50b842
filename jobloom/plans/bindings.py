"""The given tables as the engine's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that queries about recent rows look back from.
AS_OF = "2024-03-01 00:00:00"
LEDGER_AS_OF = "1998-06-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str):
    return F.lit(text).cast("timestamp")


def stamp(c: str, alias: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(alias or c)


def sql_stamp(c: str, alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    pay = 20000 + (n % 130) * 1000
    first = F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int"))
    return d.select(
        i.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("company"),
        F.col("text").alias("description"),
        F.when(F.col("lang") == "en", "Remote, US").when(F.col("lang") == "fr", "Paris, France").when(F.col("lang") == "de", "Berlin").alias("location"),
        (i % 3 + 1).cast("int").alias("source_tier"),
        F.when(i % 4 == 0, pay.cast("int")).alias("salary_min_usd"),
        F.when(i % 8 == 0, (pay + 20000).cast("int")).alias("salary_max_usd"),
        F.when(i % 4 == 0, "listed").alias("salary_source"),
        F.concat(F.lit("https://jobs.example.com/"), i.cast("string")).alias("apply_url"),
        F.lit("https://board.example.com").alias("source_url"),
        F.col("source").alias("source"),
        first.cast("timestamp").alias("first_seen_at"),
        F.date_add(first, (n % 30).cast("int")).cast("timestamp").alias("last_seen_at"),
        (i % 7 != 0).alias("is_active"),
        (i % 5 != 0).alias("geo_filtered"),
        F.when((i % 5 == 1) & (i % 7 == 0), "country").alias("geo_reject_reason"),
        (n % 101).cast("int").alias("score_total"),
        F.when(i % 13 == 0, "title-excluded: intern").alias("gate_failed"),
        F.when(i % 6 == 0, None).when(i % 6 == 1, "Marketing").when(i % 6 == 2, "Community").otherwise("Other").alias("function_category"),
        F.when(i % 9 == 0, None).when(i % 9 < 5, "Remote").otherwise("Onsite").alias("remote_status"),
        F.when(i % 10 == 0, None).when(i % 10 < 4, "Senior").otherwise("Mid").alias("seniority"),
        F.when(i % 11 == 0, None).when(i % 11 < 6, "SaaS").otherwise("Fintech").alias("vertical"),
        i.alias("seq"),
    )


POSTINGS = """postings AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS company, text AS description,
    CASE lang WHEN 'en' THEN 'Remote, US' WHEN 'fr' THEN 'Paris, France' WHEN 'de' THEN 'Berlin' END AS location,
    CAST(doc_id % 3 + 1 AS INT) AS source_tier,
    CASE WHEN doc_id % 4 = 0 THEN CAST(20000 + (n_chars % 130) * 1000 AS INT) END AS salary_min_usd,
    CASE WHEN doc_id % 8 = 0 THEN CAST(40000 + (n_chars % 130) * 1000 AS INT) END AS salary_max_usd,
    CASE WHEN doc_id % 4 = 0 THEN 'listed' END AS salary_source,
    'https://jobs.example.com/' || doc_id AS apply_url, 'https://board.example.com' AS source_url, source,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INT)) AS first_seen_at,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 + n_chars % 30 AS INT)) AS last_seen_at,
    doc_id % 7 <> 0 AS is_active, doc_id % 5 <> 0 AS geo_filtered,
    CASE WHEN doc_id % 5 = 1 AND doc_id % 7 = 0 THEN 'country' END AS geo_reject_reason,
    CAST(n_chars % 101 AS INT) AS score_total, CASE WHEN doc_id % 13 = 0 THEN 'title-excluded: intern' END AS gate_failed,
    CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Marketing' WHEN 2 THEN 'Community' ELSE 'Other' END AS function_category,
    CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 < 5 THEN 'Remote' ELSE 'Onsite' END AS remote_status,
    CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 < 4 THEN 'Senior' ELSE 'Mid' END AS seniority,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 < 6 THEN 'SaaS' ELSE 'Fintech' END AS vertical,
    doc_id AS seq
  FROM documents)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.least(F.lit(100), F.greatest(F.lit(0), F.col("quality") * 50 - F.col("toxic") * 20 + (i % 50)))
    return table(spark, sf_dir, "labels").select(i.alias("job_id"), (i % 3).alias("profile_id"), F.when(i % 11 != 0, raw.cast("int")).alias("match_score"), (i % 17 != 0).alias("has_breakdown"))


SCORES = """scores AS (
  SELECT doc_id AS job_id, doc_id % 3 AS profile_id,
    CASE WHEN doc_id % 11 <> 0 THEN CAST(least(100, greatest(0, quality * 50 - toxic * 20 + doc_id % 50)) AS INT) END AS match_score,
    doc_id % 17 <> 0 AS has_breakdown FROM labels)"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"),
        F.col("ts").cast("timestamp").alias("run_at"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("jobs_found"),
        (F.col("event_type") != "error").alias("success"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), F.col("props"))).alias("error_message"),
        F.col("event_id").alias("seq"),
    )


HEALTH = """health AS (
  SELECT CAST(user_id AS VARCHAR) AS source, ts AS run_at, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS jobs_found,
    event_type <> 'error' AS success, CAST(floor(value * 1000) AS BIGINT) AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error_message, event_id AS seq FROM events)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("run_at"),
        F.col("o_orderpriority").alias("operation"),
        (k % 1000).alias("input_tokens"),
        (k % 300).alias("cache_write_input_tokens"),
        (k % 700).alias("cached_input_tokens"),
        (k % 200).alias("output_tokens"),
        (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)").alias("cost_usd"),
        F.concat(F.lit("batch jobs="), (k % 50).cast("string")).alias("notes"),
        F.col("o_custkey").alias("user_id"),
    )


LEDGER = """ledger AS (
  SELECT o_orderkey AS id, o_orderdate AS run_at, o_orderpriority AS operation, o_orderkey % 1000 AS input_tokens,
    o_orderkey % 300 AS cache_write_input_tokens, o_orderkey % 700 AS cached_input_tokens, o_orderkey % 200 AS output_tokens,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DECIMAL(18,0)) AS cents, 'batch jobs=' || (o_orderkey % 50) AS notes, o_custkey AS user_id FROM orders)"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(k % 10 != 0, k % 2000).alias("job_id"),
        F.concat(F.lit("snapshot "), k.cast("string")).alias("job_title_snapshot"),
        F.when(s == "F", "applied").when(s == "O", "saved").when(s == "P", "interview").otherwise(s).alias("status"),
        F.when(s == "F", F.col("o_orderdate").cast("timestamp")).alias("applied_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


APPLICATIONS = """applications AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 2000 END AS job_id,
    'snapshot ' || o_orderkey AS job_title_snapshot,
    CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'saved' WHEN 'P' THEN 'interview' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS applied_at, o_orderdate AS updated_at FROM orders)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 100).alias("user_id"), (k % 7 == 0).alias("is_active"), F.col("c_name").alias("filename"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nationkey"),
    )


PROFILES = """profiles AS (
  SELECT c_custkey AS id, c_custkey % 100 AS user_id, c_custkey % 7 = 0 AS is_active, c_name AS filename,
    c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nationkey FROM customer)"""


def with_tables(body: str, *tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + body
