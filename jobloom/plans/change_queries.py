"""Queries of changes that rewrite parts of a written table, count what they change, or have several results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lifecycle, partitioned
from . import bindings as B
from .registry import query
from .state_queries import LATE, WANTED, _written, shared_folder


def _days(spark, sf_dir) -> partitioned.DayTable:
    """All postings as a table by day, newly written; rows of each 50th id have no day."""
    p = B.postings(spark, sf_dir).withColumn("dedup_key", F.concat(F.lit("k"), F.col("id").cast("string")))
    p = p.withColumn("first_seen_at", F.when(F.col("id") % 50 != 49, F.col("first_seen_at")))
    return partitioned.create(p, f"{shared_folder(spark)}/days-{uuid.uuid4().hex[:12]}")


DATED = "dated AS (SELECT * REPLACE (CASE WHEN id % 50 <> 49 THEN first_seen_at END AS first_seen_at), 'k' || id AS dedup_key FROM postings)"
#: Rows of ten days come again, two for each key, under the keys of rows of those days, or new ones.
INCOMING = """incoming AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN dedup_key ELSE 'n' || id END AS dedup_key, score_total + turn AS score_total), turn AS seq2
  FROM dated, (SELECT unnest([0, 1]) AS turn) WHERE id % 60 BETWEEN 20 AND 29)"""


def _incoming(rows):
    key = F.when(F.col("id") % 2 == 0, F.col("dedup_key")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
    again = rows.filter((F.col("id") % 60).between(20, 29)).withColumn("dedup_key", key).drop(partitioned.DAY)
    return again.withColumn("seq", F.lit(0)).unionByName(again.withColumns({"seq": F.lit(1), "score_total": F.col("score_total") + 1}))


@query(B.with_tables(
    """SELECT coalesce(i.dedup_key, c.dedup_key) AS dedup_key, coalesce(i.score_total, c.score_total) AS score_total, CASE WHEN c.id IS NULL THEN true ELSE c.is_active END AS is_active,
      strftime(CASE WHEN c.id IS NULL THEN i.first_seen_at ELSE c.first_seen_at END, '%Y-%m-%d') AS day
      FROM dated c FULL JOIN (SELECT * FROM incoming WHERE seq2 = 1) i ON c.dedup_key = i.dedup_key""", B.POSTINGS, DATED, INCOMING))  # fmt: skip
def m1_partitioned_upsert(spark, sf_dir):
    """An upsert that rewrites ten of sixty days."""
    table = _days(spark, sf_dir)
    partitioned.upsert(table, _incoming(table.rows()))
    return table.rows().select("dedup_key", "score_total", "is_active", F.date_format(partitioned.DAY, "yyyy-MM-dd").alias("day"))


@query(B.with_tables("SELECT count(DISTINCT dedup_key) FILTER (dedup_key IN (SELECT dedup_key FROM dated)) AS updated, count(DISTINCT dedup_key) FILTER (dedup_key NOT IN (SELECT dedup_key FROM dated)) AS inserted FROM incoming", B.POSTINGS, DATED, INCOMING))
def m1_upsert_counts(spark, sf_dir):
    table = _days(spark, sf_dir)
    n = partitioned.upsert(table, _incoming(table.rows()))
    return spark.createDataFrame([(n["updated"], n["inserted"])], "updated long, inserted long")


@query(B.with_tables("SELECT p.id, CASE WHEN id % 60 < 12 AND quality IS NOT NULL THEN 'L' || quality ELSE seniority END AS seniority, strftime(first_seen_at, '%Y-%m-%d') AS day FROM dated p LEFT JOIN labels ON doc_id = id", B.POSTINGS, DATED))
def m2_partitioned_patch(spark, sf_dir):
    """Patches of rows of twelve days."""
    table = _days(spark, sf_dir)
    label = F.concat(F.lit("L"), F.col("quality").cast("string"))
    partitioned.patch(table, B.table(spark, sf_dir, "labels").filter("doc_id % 60 < 12").select(F.col("doc_id").alias("id"), label.alias("seniority")))
    return table.rows().select("id", "seniority", F.date_format(partitioned.DAY, "yyyy-MM-dd").alias("day"))


STALE = f"is_active AND last_seen_at < TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY"
GONE = f"coalesce(first_seen_at < TIMESTAMP '{B.AS_OF}' - INTERVAL 45 DAY, false)"


@query(B.with_tables(f"SELECT id, is_active AND NOT ({STALE}) AS is_active FROM dated WHERE NOT {GONE}", B.POSTINGS, DATED))
def m5_partitioned_retention(spark, sf_dir):
    table = _days(spark, sf_dir)
    partitioned.retain(table, B.at(B.AS_OF), 30, 45)
    return table.rows().select("id", "is_active")


@query(B.with_tables(f"SELECT count(*) FILTER ({STALE}) AS marked, count(*) FILTER ({GONE}) AS deleted FROM dated", B.POSTINGS, DATED))
def m5_retention_counts(spark, sf_dir):
    """What retention did, counted while it wrote."""
    n = partitioned.retain(_days(spark, sf_dir), B.at(B.AS_OF), 30, 45)
    return spark.createDataFrame([(n["marked"], n["deleted"])], "marked long, deleted long")


ASKED = """asked AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey % 50 AS user_id, CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey % 2000 END AS job_id, 'new ' || l_orderkey AS title,
  CASE l_linenumber WHEN 1 THEN 'applied' WHEN 2 THEN 'offer' WHEN 3 THEN NULL ELSE 'saved' END AS status FROM lineitem)"""


@query(B.with_tables(
    f"""SELECT a.seq, CASE WHEN NOT a.ok THEN 'refused' WHEN o.id IS NOT NULL OR a.n > 1 THEN 'duplicate' ELSE 'created' END AS outcome, CASE WHEN a.ok THEN o.id END AS id,
      CASE WHEN NOT a.ok THEN NULL WHEN o.id IS NOT NULL THEN o.job_title_snapshot WHEN a.n > 1 THEN f.title ELSE a.title END AS title,
      CASE WHEN NOT a.ok THEN NULL WHEN o.id IS NOT NULL THEN o.status WHEN a.n > 1 THEN f.status ELSE a.status END AS status,
      CASE WHEN NOT a.ok THEN NULL WHEN o.id IS NOT NULL THEN strftime(o.applied_at, '%Y-%m-%d') WHEN (CASE WHEN a.n > 1 THEN f.status ELSE a.status END) = 'applied' THEN '{LATE[:10]}' END AS applied
      FROM numbered a LEFT JOIN (SELECT * FROM applications WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, job_id ORDER BY id) = 1) o ON o.user_id = a.user_id AND o.job_id = a.job_id
      LEFT JOIN (SELECT * FROM numbered WHERE job_id IS NOT NULL AND ok AND n = 1) f ON f.user_id = a.user_id AND f.job_id = a.job_id""",
    B.APPLICATIONS, ASKED, """numbered AS (SELECT *, CASE WHEN job_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY user_id, job_id, ok ORDER BY seq) END AS n
      FROM (SELECT * REPLACE (coalesce(status, 'saved') AS status), coalesce(status, 'saved') IN ('saved', 'applied') AS ok FROM asked))"""))  # fmt: skip
def m9_insert_results(spark, sf_dir):
    """Each insert with its outcome and the row that is there after it."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    status = F.when(line == 1, "applied").when(line == 2, "offer").when(line != 3, "saved")
    asked = B.table(spark, sf_dir, "lineitem").select((k * 10 + line).alias("seq"), (F.col("l_partkey") % 50).alias("user_id"), F.when(k % 9 != 0, k % 2000).alias("job_id"), F.concat(F.lit("new "), k.cast("string")).alias("job_title_snapshot"), status.alias("status"), B.at(LATE).alias("at"))
    out = lifecycle.inserted(B.applications(spark, sf_dir), asked)
    return out.select("seq", "outcome", "id", F.col("job_title_snapshot").alias("title"), "status", F.date_format("applied_at", "yyyy-MM-dd").alias("applied"))


DECIDED = "decided AS (SELECT w.id, w.user_id, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.user_id <> w.user_id THEN 'not owned' WHEN p.is_active THEN 'active' ELSE 'deleted' END AS outcome FROM wanted w LEFT JOIN profiles p ON p.id = w.id)"
#: Scores of many profiles.
SPREAD = "spread AS (SELECT job_id, job_id % (SELECT max(id) FROM profiles) AS profile_id FROM scores)"


@query(B.with_tables(
    """SELECT 'profile' AS part, id, user_id, NULL AS outcome FROM profiles WHERE id NOT IN (SELECT id FROM decided WHERE outcome = 'deleted')
      UNION ALL SELECT 'score', job_id, profile_id, NULL FROM spread WHERE profile_id NOT IN (SELECT id FROM decided WHERE outcome = 'deleted')
      UNION ALL SELECT 'refusal', id, user_id, outcome FROM decided WHERE outcome <> 'deleted'""", B.PROFILES, B.SCORES, WANTED, DECIDED, SPREAD))  # fmt: skip
def m15_delete_cascade(spark, sf_dir):
    """Profiles, scores and refusals after deletions, from decisions that are written once."""
    c = B.table(spark, sf_dir, "customer")
    wanted = c.select((F.col("c_custkey") * 2).alias("id"), (F.col("c_custkey") % 40).alias("user_id"))
    p = B.profiles(spark, sf_dir)
    last = p.agg(F.max("id")).first()[0]
    scores = B.scores(spark, sf_dir).withColumn("profile_id", F.col("job_id") % last)
    profiles, left, refused = lifecycle.profile_cascade(p, scores, wanted, lambda rows: _written(spark, rows))
    none = F.lit(None).cast("string").alias("outcome")
    return (
        profiles.select(F.lit("profile").alias("part"), "id", "user_id", none)
        .unionByName(left.select(F.lit("score").alias("part"), F.col("job_id").alias("id"), F.col("profile_id").alias("user_id"), none))
        .unionByName(refused.select(F.lit("refusal").alias("part"), "id", "user_id", "outcome"))
    )


ASKS = "asks AS (SELECT c_custkey % 120 AS user_id, c_custkey * 3 % 1000 AS id, c_custkey AS seq FROM customer)"
JUDGED = "judged AS (SELECT a.*, p.user_id AS owner, coalesce(p.user_id = a.user_id, false) AS ok FROM asks a LEFT JOIN profiles p ON p.id = a.id)"
CHOSEN = "chosen AS (SELECT user_id, max(seq) AS seq, arg_max(id, seq) AS id FROM judged WHERE ok GROUP BY user_id)"


def _activations(spark, sf_dir):
    k = F.col("c_custkey")
    wanted = B.table(spark, sf_dir, "customer").select((k % 120).alias("user_id"), (k * 3 % 1000).alias("id"), k.alias("seq"))
    return lifecycle.activations(B.profiles(spark, sf_dir), wanted)


@query(B.with_tables("SELECT p.id, CASE WHEN c.id IS NOT NULL THEN p.id = c.id ELSE p.is_active END AS is_active FROM profiles p LEFT JOIN chosen c USING (user_id)", B.PROFILES, ASKS, JUDGED, CHOSEN))
def m7_activations(spark, sf_dir):
    """Profiles after every customer asked for some profile, most of which are someone else's."""
    return _activations(spark, sf_dir)[0].select("id", "is_active")


@query(B.with_tables("SELECT j.user_id, j.id, j.seq, CASE WHEN owner IS NULL THEN 'missing' WHEN NOT ok THEN 'not owned' WHEN j.seq = c.seq THEN 'activated' ELSE 'replaced' END AS outcome FROM judged j LEFT JOIN chosen c USING (user_id)", B.PROFILES, ASKS, JUDGED, CHOSEN))
def m7_outcomes(spark, sf_dir):
    return _activations(spark, sf_dir)[1]


@query(B.with_tables("SELECT s.job_id, s.profile_id, CASE WHEN NOT coalesce(p.first_seen_at >= TIMESTAMP '2024-02-01', false) AND has_breakdown THEN 'b' || s.job_id END AS breakdown FROM scores s LEFT JOIN postings p ON p.id = s.job_id", B.SCORES, B.POSTINGS))
def m16_rescorable(spark, sf_dir):
    """Scores whose breakdown goes, as their posting is of the window."""
    s = B.scores(spark, sf_dir)
    s = s.withColumn("breakdown", F.when(F.col("has_breakdown"), F.concat(F.lit("b"), F.col("job_id").cast("string"))))
    return lifecycle.rescorable(s, B.postings(spark, sf_dir), B.at("2024-02-01")).select("job_id", "profile_id", "breakdown")
