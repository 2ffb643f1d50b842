"""Queries of the ledger, source health, deduplication and table changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, dedup, enrich, health, ledger, lifecycle, reports, scoring
from ..schemas import APPLICATION_STATUSES
from . import bindings as B
from . import sql as S
from .registry import query
from .text_queries import BANDED, BLOBBED, CONFIG, GATE, SCORED

OPERATIONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CAPS = {"1-URGENT": 5.0, "2-HIGH": 1.0, "3-MEDIUM": 20.0, "classify": 5.0}
MONTH = f"run_at >= date_trunc('month', TIMESTAMP '{B.LEDGER_AS_OF}') AND run_at <= TIMESTAMP '{B.LEDGER_AS_OF}'"
COST = "round(CAST(sum(cents) AS DOUBLE) / 1000000, 6)"
COUNTS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ledger.TOKENS)


def _l(spark, sf_dir):
    return B.ledger(spark, sf_dir)


def _p(spark, sf_dir):
    return B.postings(spark, sf_dir)




@query(B.with_tables(f"SELECT operation, coalesce({COST}, 0) AS spent FROM ledger WHERE {MONTH} GROUP BY ROLLUP (operation)", B.LEDGER))
def a1_mtd_spend(spark, sf_dir):
    return ledger.month_to_date(_l(spark, sf_dir), B.at(B.LEDGER_AS_OF)).rollup("operation").agg(ledger.spend(_l(spark, sf_dir)).alias("spent"))


CAPS_SQL = "caps(operation, cap) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in CAPS.items()) + ")"


def _caps(spark):
    return spark.createDataFrame(list(CAPS.items()), "operation string, cap_usd double")


@query(B.with_tables(f"SELECT c.operation, coalesce(m.s, 0) AS spent, coalesce(m.s, 0) >= c.cap AS stage_tripped, (SELECT coalesce({COST}, 0) FROM ledger WHERE {MONTH}) >= 30 AS global_tripped FROM caps c LEFT JOIN (SELECT operation, {COST} AS s FROM ledger WHERE {MONTH} GROUP BY operation) m USING (operation)", B.LEDGER, CAPS_SQL))
def a2_cap_status(spark, sf_dir):
    return ledger.cap_status(_l(spark, sf_dir), _caps(spark), B.at(B.LEDGER_AS_OF), 30)


@query(B.with_tables(f"SELECT operation, {COST} AS cost_usd, count(*) AS calls, {COUNTS} FROM ledger GROUP BY operation", B.LEDGER))
def a3_spend_by_op(spark, sf_dir):
    return ledger.by_operation(_l(spark, sf_dir))


@query(B.with_tables("SELECT operation, round(sum(cached_input_tokens) * 100.0 / nullif(sum(input_tokens + cache_write_input_tokens + cached_input_tokens), 0), 6) AS ratio FROM ledger GROUP BY operation", B.LEDGER))
def a4_cache_ratio(spark, sf_dir):
    return _l(spark, sf_dir).groupBy("operation").agg(ledger.cache_ratio().cast("double").alias("ratio"))


@query(B.with_tables(
    "SELECT strftime(d.day, '%Y-%m-%d') AS day, " + ", ".join(f"""round(CAST(coalesce(sum(cents) FILTER (operation = '{o}'), 0) AS DOUBLE) / 1000000, 6) AS "{o}\"""" for o in OPERATIONS)
    + " FROM (SELECT unnest(generate_series(min(run_at)::DATE, max(run_at)::DATE, INTERVAL 1 DAY))::DATE AS day FROM ledger) d LEFT JOIN ledger ON run_at::DATE = d.day GROUP BY d.day", B.LEDGER))
def a5_daily_matrix(spark, sf_dir):
    return ledger.daily_matrix(_l(spark, sf_dir), list(OPERATIONS)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(B.with_tables(f"SELECT strftime(date_trunc('day', run_at), '%Y-%m-%d') AS day, operation, {COST} AS cost_usd, {COUNTS} FROM ledger GROUP BY ALL", B.LEDGER))
def a6_daily_rollup(spark, sf_dir):
    return ledger.daily(_l(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(B.with_tables("SELECT operation, least(100.0, s / 2000 * 100) AS pct, CASE WHEN s / 2000 * 100 >= 80 THEN 'red' WHEN s / 2000 * 100 >= 50 THEN 'amber' ELSE 'green' END AS light FROM (SELECT operation, CAST(sum(cents) AS DOUBLE) / 1000000 AS s FROM ledger GROUP BY operation)", B.LEDGER))
def a7_pct_of_cap(spark, sf_dir):
    pct = F.col("cost_usd") / 2000 * 100
    return ledger.by_operation(_l(spark, sf_dir)).select("operation", F.least(F.lit(100.0), pct).alias("pct"), T.bucketed(pct, [(80, "red"), (50, "amber")], "green").alias("light"))


FALLBACK = {"1-URGENT": 0.00027, "2-HIGH": 0.00016, "cv_score": 0.0006}
KNOWN = "known(operation, fallback) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in FALLBACK.items()) + ")"
SEEN = f"""seen AS (SELECT operation, CAST(sum(cents) AS DOUBLE) / 1000000 / sum(n) AS seen FROM (SELECT *, TRY_CAST(regexp_extract(notes, 'jobs=(\\d+)', 1) AS BIGINT) AS n FROM ledger)
  WHERE n > 0 AND run_at >= TIMESTAMP '{B.LEDGER_AS_OF}' - INTERVAL 30 DAY AND run_at <= TIMESTAMP '{B.LEDGER_AS_OF}' GROUP BY operation)"""


def _mean(spark, sf_dir):
    return ledger.mean_cost(_l(spark, sf_dir), B.at(B.LEDGER_AS_OF), FALLBACK)


@query(B.with_tables("SELECT operation, round(coalesce(seen, fallback), 9) AS usd_per_job FROM known LEFT JOIN seen USING (operation)", B.LEDGER, KNOWN, SEEN))
def a8_mean_cost(spark, sf_dir):
    return _mean(spark, sf_dir).withColumn("usd_per_job", F.round("usd_per_job", 9))


@query(B.with_tables(
    f"""SELECT operation, n AS jobs, round(n * usd, 6) AS estimate, CASE WHEN n * usd > 0.001 THEN 'TRIPS CAP' ELSE 'OK' END AS headroom FROM (
      SELECT operation, coalesce(seen, fallback) AS usd, CASE operation WHEN '1-URGENT' THEN (SELECT count(*) FROM postings WHERE function_category IS NULL AND is_active AND score_total >= 40)
      WHEN '2-HIGH' THEN (SELECT count(*) FROM postings WHERE is_active AND NOT geo_filtered AND remote_status IS NOT NULL) ELSE (SELECT count(*) FROM postings WHERE is_active AND score_total >= 40) END AS n
      FROM known LEFT JOIN seen USING (operation))""", B.POSTINGS, B.LEDGER, KNOWN, SEEN))  # fmt: skip
def a9_rescore_estimate(spark, sf_dir):
    return reports.rescore_estimate(_p(spark, sf_dir), _mean(spark, sf_dir), {"1-URGENT": "classify", "2-HIGH": "geo", "cv_score": "score"}, 40, 0.001)


@query(B.with_tables("SELECT (SELECT count(*) FROM postings WHERE is_active) AS indexed, count(match_score) AS scored, CAST(floor(avg(match_score) + 0.5) AS BIGINT) AS average, (SELECT count(*) FROM applications WHERE status = 'saved') AS saved FROM scores", B.POSTINGS, B.SCORES, B.APPLICATIONS))
def a10_stats_bar(spark, sf_dir):
    return reports.stats_bar(_p(spark, sf_dir), B.scores(spark, sf_dir), B.applications(spark, sf_dir))


@query(B.with_tables("SELECT coalesce(source, '?') AS source, count(*) FILTER (is_active) AS live, count(*) FILTER (is_active AND first_seen_at >= TIMESTAMP '2024-02-20') AS fresh FROM postings GROUP BY 1", B.POSTINGS))
def a11_source_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


def _counts(spark, sf_dir):
    return reports.source_counts(_p(spark, sf_dir), B.at("2024-02-20"))


LATEST = "latest AS (SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_at DESC, seq DESC) = 1)"
BY_SOURCE = "counts AS (SELECT replace(source, 'src', '') AS source, count(*) FILTER (is_active) AS live, count(*) FILTER (is_active AND first_seen_at >= TIMESTAMP '2024-02-20') AS fresh FROM postings GROUP BY 1)"
OVERVIEW = "overview AS (SELECT coalesce(l.source, c.source) AS source, coalesce(success, true) AS success, coalesce(jobs_found, 0) AS jobs_found, duration_ms, coalesce(live, 0) AS live, coalesce(fresh, 0) AS fresh FROM latest l FULL JOIN counts c ON l.source = c.source)"


def _overview(spark, sf_dir):
    counts = _counts(spark, sf_dir).withColumn("source", F.replace("source", F.lit("src"), F.lit("")))
    return health.overview(health.latest(B.health(spark, sf_dir)), counts)


@query(B.with_tables("SELECT * FROM overview", B.HEALTH, B.POSTINGS, LATEST, BY_SOURCE, OVERVIEW))
def j6_health_full_outer(spark, sf_dir):
    return _overview(spark, sf_dir)


@query(B.with_tables("SELECT count(*) AS sources, count(*) FILTER (NOT success) AS failing, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(live) AS BIGINT) AS live FROM overview", B.HEALTH, B.POSTINGS, LATEST, BY_SOURCE, OVERVIEW))
def a12_health_header(spark, sf_dir):
    return _overview(spark, sf_dir).agg(F.count("*").alias("sources"), F.count_if(~F.col("success")).alias("failing"), F.sum("fresh").alias("fresh"), F.sum("live").alias("live"))


@query(B.with_tables("SELECT source, duration_ms FROM overview", B.HEALTH, B.POSTINGS, LATEST, BY_SOURCE, OVERVIEW))
def k7_health_sorted(spark, sf_dir):
    return _overview(spark, sf_dir).select("source", "duration_ms").orderBy(*health.sort_keys("duration_ms", True))


@query(B.with_tables(f"SELECT ({GATE}) AS gate_failed, count(*) AS n FROM postings GROUP BY 1", B.POSTINGS))
def a13_gate_histogram(spark, sf_dir):
    g = F.replace(scoring.gate(F.col("title"), CONFIG), F.lit("title-excluded: "), F.lit(""))
    return _p(spark, sf_dir).groupBy(g.alias("gate_failed")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT lower(split_part(text, chr(10), 1)) AS t FROM documents) SELECT count(*) FILTER (length(t) >= 80 AND contains(t, 'the')) AS junk, count(*) AS total FROM t")
def a14_cleanup_counts(spark, sf_dir):
    return _p(spark, sf_dir).agg(F.count_if(clean.is_junk(F.col("title"), ("the",))).alias("junk"), F.count("*").alias("total"))


@query(B.with_tables("SELECT coalesce(nullif(status, ''), 'saved') AS status, 0 AS n FROM applications WHERE false UNION ALL SELECT s.status, count(a.id) FROM (SELECT unnest(['saved', 'applied', 'interview', 'offer', 'rejected', 'stale']) AS status) s LEFT JOIN applications a ON a.status = s.status GROUP BY s.status", B.APPLICATIONS))
def a21_board(spark, sf_dir):
    return reports.board(B.applications(spark, sf_dir))


@query(B.with_tables(f"SELECT id, {B.sql_stamp('run_at')} FROM ledger WHERE {MONTH}", B.LEDGER))
def k10_ledger_mtd(spark, sf_dir):
    rows = ledger.month_to_date(_l(spark, sf_dir), B.at(B.LEDGER_AS_OF))
    return rows.orderBy(F.col("run_at").desc(), "id").select("id", B.stamp("run_at"))


@query(B.with_tables("SELECT id, CAST(floor(input_tokens * 0.5 + cache_write_input_tokens * 1.0 + cached_input_tokens * 0.05 + output_tokens * 2.5 + 0.5) AS DOUBLE) / 1000000 AS cost FROM ledger", B.LEDGER))
def x34_token_cost(spark, sf_dir):
    c = T.token_cost(*(F.col(x) for x in ledger.TOKENS), 0.5, 2.5, 2.0, 0.1)
    return _l(spark, sf_dir).select("id", c.cast("double").alias("cost"))


@query(B.with_tables("SELECT id, TRY_CAST(regexp_extract(notes, 'jobs=(\\d+)', 1) AS BIGINT) AS n FROM ledger", B.LEDGER))
def x35_note_count(spark, sf_dir):
    return _l(spark, sf_dir).select("id", ledger.job_count(F.col("notes")).alias("n"))


TRIPPED = f"""tripped AS (SELECT strftime(date_trunc('month', run_at), '%Y-%m-%d') AS month_start, 'stage' AS scope, operation FROM ledger GROUP BY ALL HAVING sum(cents) >= 10000000
  UNION SELECT strftime(date_trunc('month', run_at), '%Y-%m-%d'), 'global', '*' FROM ledger GROUP BY ALL HAVING sum(cents) >= 30000000)"""


@query(B.with_tables("SELECT * FROM tripped WHERE NOT (month_start < '1996-01-01' AND scope = 'stage')", B.LEDGER, TRIPPED))
def m13_alert_once(spark, sf_dir):
    month = F.date_format(F.date_trunc("month", "run_at"), "yyyy-MM-dd").alias("month_start")
    stage = _l(spark, sf_dir).groupBy(month, "operation").agg(F.sum("cost_usd").alias("s")).filter("s >= 10").select("month_start", F.lit("stage").alias("scope"), "operation")
    every = _l(spark, sf_dir).groupBy(month).agg(F.sum("cost_usd").alias("s")).filter("s >= 30").select("month_start", F.lit("global").alias("scope"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("operation"))
    sent = stage.filter("month_start < '1996-01-01'")
    return ledger.new_alerts(stage.unionByName(every), sent)


# --- health ---------------------------------------------------------------------------------------------------------


@query(B.with_tables(f"SELECT source, {B.sql_stamp('run_at')}, success, jobs_found, duration_ms FROM latest", B.HEALTH, LATEST))
def w3_latest_health(spark, sf_dir):
    return health.latest(B.health(spark, sf_dir)).select("source", B.stamp("run_at"), "success", "jobs_found", "duration_ms")


STATES = """runs AS (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY source ORDER BY run_at, seq) AS streak FROM health),
tails AS (SELECT *, max(streak) OVER (PARTITION BY source) AS last FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_at, seq) AS n FROM tails WHERE streak = last AND NOT success),
failed AS (SELECT source, count(*) AS k, max(CASE WHEN n = 3 THEN run_at END) AS suspended_at FROM ranked GROUP BY source),
states AS (SELECT h.source, CAST(coalesce(f.k, 0) AS INT) AS consecutive_failures, coalesce(f.k, 0) >= 3 AS suspended, strftime(f.suspended_at, '%Y-%m-%d %H:%M:%S') AS suspended_at,
  strftime(h.ok, '%Y-%m-%d %H:%M:%S') AS last_success_at FROM (SELECT source, max(CASE WHEN success THEN run_at END) AS ok FROM health GROUP BY source) h LEFT JOIN failed f USING (source))"""


def _states(spark, sf_dir):
    return health.states(B.health(spark, sf_dir), 3)


@query(B.with_tables("SELECT * FROM states", B.HEALTH, STATES))
def w6_source_state(spark, sf_dir):
    return _states(spark, sf_dir).select("source", "consecutive_failures", "suspended", B.stamp("suspended_at"), B.stamp("last_success_at"))


@query(B.with_tables("SELECT DISTINCT source FROM health WHERE source NOT IN (SELECT source FROM states WHERE suspended)", B.HEALTH, STATES))
def f4_suspended_exclusion(spark, sf_dir):
    return B.health(spark, sf_dir).select("source").distinct().join(_states(spark, sf_dir).filter("suspended").select("source"), "source", "left_anti")


# --- deduplication --------------------------------------------------------------------------------------------------

KEYED = f"keyed AS (SELECT *, {S.key('title', 'company', 'location')} AS dedup_key FROM postings)"
BEST = f"""best AS (SELECT * FROM keyed QUALIFY NOT {S.valid_key('dedup_key')} OR row_number() OVER (PARTITION BY dedup_key ORDER BY source_tier DESC,
  CAST(coalesce(salary_min_usd, 0) <> 0 OR coalesce(salary_max_usd, 0) <> 0 AS INT) DESC, length(coalesce(description, '')) DESC, seq) = 1)"""


@query(B.with_tables("SELECT id, dedup_key FROM best", B.POSTINGS, KEYED, BEST))
def w1_dedup_within_run(spark, sf_dir):
    return dedup.richest(dedup.keyed(_p(spark, sf_dir))).select("id", "dedup_key")


def _few(spark, sf_dir):
    """Postings whose titles are one word, so that many collide."""
    return _p(spark, sf_dir).withColumn("title", F.substring_index("title", " ", 1))


FEW = "few AS (SELECT * REPLACE (split_part(title, ' ', 1) AS title) FROM postings)"


@query(B.with_tables(
    f"""SELECT id, CASE WHEN gone THEN 'deleted' WHEN n = 1 AND any_gone THEN 'canonical' ELSE 'kept' END AS action, is_active OR (n = 1 AND any_gone AND NOT is_active) AS is_active,
      strftime(CASE WHEN n = 1 AND any_gone THEN greatest(last_seen_at, newest) ELSE last_seen_at END, '%Y-%m-%d %H:%M:%S') AS last_seen_at,
      CASE WHEN n = 1 AND any_gone AND NOT is_active THEN NULL ELSE geo_reject_reason END AS geo_reject_reason FROM (
      SELECT *, max(gone) OVER w AS any_gone, max(CASE WHEN gone OR n = 1 THEN last_seen_at END) OVER w AS newest FROM (
        SELECT *, n > 1 AND first_seen_at >= TIMESTAMP '2024-02-01' AS gone FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(company) ORDER BY first_seen_at, id) AS n FROM few))
      WINDOW w AS (PARTITION BY lower(title), lower(company)))""", B.POSTINGS, FEW))  # fmt: skip
def w4_collision_repair(spark, sf_dir):
    return dedup.repair_collisions(_few(spark, sf_dir), B.at("2024-02-01")).select("id", "action", "is_active", B.stamp("last_seen_at"), "geo_reject_reason")


@query(B.with_tables(
    f"""SELECT id, new_key, row_number() OVER (PARTITION BY new_key ORDER BY first_seen_at, id) = 1 AS survives FROM (SELECT *, CASE WHEN id % 2 = 0 THEN {S.key('title', 'company', 'location')} ELSE lower(title) || '|x|any' END AS new_key FROM few)""", B.POSTINGS, FEW))
def w5_key_backfill(spark, sf_dir):
    old = F.when(F.col("id") % 2 == 0, F.concat_ws("|", "title", "company")).otherwise(F.concat(F.lower("title"), F.lit("|x|any")))
    return dedup.backfill_keys(_few(spark, sf_dir).withColumn("dedup_key", old)).select("id", "new_key", "survives")


@query(
    """WITH u AS (SELECT doc_id AS seq, doc_id % 5 AS user_id, text AS body, sha256(text) AS bh, sha256(substr(text, 1, 300)) AS th FROM documents WHERE length(text) >= 100),
    old AS (SELECT * REPLACE (seq * 3 % 5 AS user_id) FROM u), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, bh ORDER BY seq) = 1),
    c AS (SELECT * FROM b WHERE (user_id, bh) NOT IN (SELECT user_id, bh FROM old)), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, th ORDER BY seq) = 1)
    SELECT seq, user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1 AND user_id NOT IN (SELECT user_id FROM old) AS is_active FROM d WHERE (user_id, th) NOT IN (SELECT user_id, th FROM old)"""
)
def w7_upload_dedup(spark, sf_dir):
    up = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 5).alias("user_id"), F.col("text").alias("body"))
    old = up.filter(F.length("body") >= 100).select((F.col("seq") * 3 % 5).alias("user_id"), T.fingerprint(F.col("body")).alias("bytes_hash"), T.fingerprint(F.col("body"), 300).alias("text_hash"))
    return dedup.new_uploads(up, old, 300).select("seq", "user_id", "is_active")


# --- table changes --------------------------------------------------------------------------------------------------

COLUMNS = "dedup_key, title, score_total, salary_min_usd, is_active, geo_filtered"


def _tables(spark, sf_dir):
    """All postings as the current table, and all of them again as incoming rows under other keys, each of two rows."""
    p = _p(spark, sf_dir)
    named = lambda k: p.withColumn("dedup_key", F.concat(F.lit("k"), k.cast("string")))
    return named(F.col("id")), named((F.col("id") - F.col("id") % 2) * 2)


#: Pairs of incoming rows have one key.
TABLES = """cur AS (SELECT *, 'k' || id AS dedup_key FROM postings),
inc AS (SELECT * FROM (SELECT *, 'k' || (id - id % 2) * 2 AS dedup_key FROM postings) QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq DESC) = 1)"""


@query(B.with_tables(
    """SELECT coalesce(i.dedup_key, c.dedup_key) AS dedup_key, CASE WHEN i.id IS NOT NULL THEN i.title ELSE c.title END AS title,
      CASE WHEN i.id IS NOT NULL THEN i.score_total ELSE c.score_total END AS score_total,
      CASE WHEN i.salary_source = 'listed' THEN i.salary_min_usd ELSE c.salary_min_usd END AS salary_min_usd,
      CASE WHEN c.id IS NOT NULL THEN c.is_active ELSE true END AS is_active, CASE WHEN c.id IS NOT NULL THEN c.geo_filtered ELSE i.geo_filtered END AS geo_filtered
      FROM cur c FULL JOIN inc i ON c.dedup_key = i.dedup_key""", B.POSTINGS, TABLES))  # fmt: skip
def m1_upsert(spark, sf_dir):
    return lifecycle.upsert(*_tables(spark, sf_dir)).select(*COLUMNS.split(", "))


@query(B.with_tables("SELECT p.id, coalesce(q.seniority, p.seniority) AS seniority, coalesce(q.vertical, p.vertical) AS vertical FROM postings p LEFT JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Staff' WHEN quality = 1 THEN 'Lead' END AS seniority, CASE WHEN toxic = 1 THEN 'AI' WHEN doc_id % 2 = 0 THEN 'B2B' END AS vertical FROM labels) q USING (id)", B.POSTINGS))
def m2_patch_merge(spark, sf_dir):
    patch = lambda n, seniority, vertical: B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(n).alias("seq"), seniority.alias("seniority"), vertical.alias("vertical"))
    i = F.col("doc_id")
    patches = patch(1, F.when(F.col("quality") == 1, "Lead"), F.when(i % 2 == 0, "B2B")).unionByName(patch(2, F.when(i % 3 == 0, "Staff"), F.when(F.col("toxic") == 1, "AI")))
    return lifecycle.patched(_p(spark, sf_dir), patches).select("id", "seniority", "vertical")


NEW_SCORES = "fresh AS (SELECT job_id, (profile_id + job_id % 2) % 3 AS profile_id, CASE WHEN job_id % 3 = 0 THEN 88 ELSE 77 END AS match_score FROM scores)"


@query(B.with_tables("SELECT job_id, profile_id, match_score FROM fresh UNION ALL SELECT job_id, profile_id, match_score FROM scores s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.job_id = s.job_id AND f.profile_id = s.profile_id)", B.SCORES, NEW_SCORES))
def m3_score_upsert(spark, sf_dir):
    s = B.scores(spark, sf_dir)
    fresh = s.withColumn("profile_id", (F.col("profile_id") + F.col("job_id") % 2) % 3).withColumns({"match_score": F.lit(77), "seq": F.lit(1)})
    fresh = fresh.unionByName(fresh.filter("job_id % 3 = 0").withColumns({"match_score": F.lit(88), "seq": F.lit(2)}))
    return lifecycle.score_upsert(s, fresh).select("job_id", "profile_id", "match_score")


@query(B.with_tables("SELECT p.id, geo_filtered OR m.id IS NOT NULL AS geo_filtered, is_active AND NOT (m.id IS NOT NULL AND m.reason IS NOT NULL) AS is_active, coalesce(m.reason, geo_reject_reason) AS geo_reject_reason FROM postings p LEFT JOIN (SELECT conv_id AS id, arg_max(role || ' ' || turn, turn) FILTER (turn % 3 = 2) AS reason FROM conversations GROUP BY conv_id) m USING (id)", B.POSTINGS))
def m4_geo_marks(spark, sf_dir):
    reason = F.when(F.col("turn") % 3 == 2, F.concat_ws(" ", "role", F.col("turn").cast("string")))
    marks = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), reason.alias("reason"))
    return lifecycle.geo_marked(_p(spark, sf_dir), marks).select("id", "geo_filtered", "is_active", "geo_reject_reason")


@query(B.with_tables(f"SELECT id, is_active AND last_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY AS is_active FROM postings WHERE first_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 45 DAY", B.POSTINGS))
def m5_retention(spark, sf_dir):
    return lifecycle.retained(_p(spark, sf_dir), B.at(B.AS_OF), 30, 45).select("id", "is_active")


LATE, LATER = "1999-01-01 00:00:00", "1999-02-03 04:05:06"


@query(B.with_tables(f"SELECT id, CASE WHEN old THEN 'stale' ELSE status END AS status, strftime(CASE WHEN old THEN TIMESTAMP '{LATE}' ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (SELECT *, status = 'applied' AND updated_at < TIMESTAMP '{LATE}' - INTERVAL 30 DAY AS old FROM applications)", B.APPLICATIONS))
def m6_stale(spark, sf_dir):
    return lifecycle.staled(B.applications(spark, sf_dir), B.at(LATE), 30).select("id", "status", B.stamp("updated_at"))


@query(B.with_tables("SELECT id, CASE WHEN user_id = 5 THEN id = 105 ELSE is_active END AS is_active FROM profiles", B.PROFILES))
def m7_activate_one(spark, sf_dir):
    return lifecycle.activated(B.profiles(spark, sf_dir), 5, 105).select("id", "is_active")


@query(B.with_tables(
    f"""SELECT id, coalesce(s, status) AS status, strftime(coalesce(applied_at, first), '%Y-%m-%d %H:%M:%S') AS applied_at, strftime(coalesce(changed, updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at
      FROM applications LEFT JOIN (SELECT id, arg_max(s, moment) AS s, max(moment) AS changed, min(moment) FILTER (s = 'applied') AS first FROM (
        SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'offer' WHEN 2 THEN 'rejected' END AS s, TIMESTAMP '{LATE}' AS moment FROM orders WHERE o_orderkey % 4 < 3
        UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'applied' ELSE 'interview' END, TIMESTAMP '{LATER}' FROM orders) GROUP BY id) c USING (id)""", B.APPLICATIONS))  # fmt: skip
def m8_status_stamps(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    change = lambda status, at: B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), B.at(at).alias("at"))
    changes = change(F.when(k == 0, "applied").when(k == 1, "offer").when(k == 2, "rejected").otherwise("bogus"), LATE)
    changes = changes.unionByName(change(F.when(F.col("o_orderkey") % 3 == 0, "applied").otherwise("interview"), LATER))
    return lifecycle.status_changes(B.applications(spark, sf_dir), changes, APPLICATION_STATUSES).select("id", "status", B.stamp("applied_at"), B.stamp("updated_at"))


@query(B.with_tables(
    """SELECT user_id, job_id, seq, job_id IS NOT NULL AND (EXISTS (SELECT 1 FROM applications a WHERE a.user_id = i.user_id AND a.job_id = i.job_id) OR row_number() OVER (PARTITION BY user_id, job_id ORDER BY seq) > 1) AS duplicate,
      (SELECT min(a.id) FROM applications a WHERE a.user_id = i.user_id AND a.job_id = i.job_id) AS existing_id
      FROM (SELECT l_partkey % 50 AS user_id, CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey % 2000 END AS job_id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) i""", B.APPLICATIONS))  # fmt: skip
def m9_idempotent_insert(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = B.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("user_id"), F.when(k % 9 != 0, k % 2000).alias("job_id"), (k * 10 + F.col("l_linenumber")).alias("seq"))
    return lifecycle.idempotent_insert(B.applications(spark, sf_dir), rows).select("user_id", "job_id", "seq", "duplicate", "existing_id")


@query(B.with_tables("SELECT id, coalesce(function_category, 'Other') AS function_category, coalesce(seniority, 'Unspecified') AS seniority, coalesce(vertical, 'Other') AS vertical, coalesce(remote_status, 'Unspecified') AS remote_status FROM postings", B.POSTINGS))
def m10_sentinels(spark, sf_dir):
    return lifecycle.with_sentinels(_p(spark, sf_dir)).select("id", *lifecycle.SENTINELS)


@query(B.with_tables("SELECT id, geo_filtered AND NOT b AS geo_filtered, is_active OR b AS is_active, CASE WHEN NOT b THEN geo_reject_reason END AS geo_reject_reason FROM (SELECT *, first_seen_at >= TIMESTAMP '2024-01-20' AND geo_reject_reason IS NOT NULL AS b FROM postings)", B.POSTINGS))
def m11_geo_reset(spark, sf_dir):
    return lifecycle.geo_reset(_p(spark, sf_dir), B.at("2024-01-20")).select("id", "geo_filtered", "is_active", "geo_reject_reason")


@query(B.with_tables("SELECT id, CASE WHEN first_seen_at >= TIMESTAMP '2024-02-01' THEN total ELSE score_total END AS score_total FROM scored", B.POSTINGS, BLOBBED, BANDED, SCORED))
def m12_rescore(spark, sf_dir):
    recent = F.col("first_seen_at") >= B.at("2024-02-01")
    p = _p(spark, sf_dir)
    return scoring.scored(p.filter(recent), CONFIG).select("id", "score_total").unionByName(p.filter(~recent).select("id", "score_total"))


@query(B.with_tables("SELECT a.id, coalesce(p.title, a.job_title_snapshot) AS title FROM applications a LEFT JOIN postings p ON p.id = a.job_id", B.APPLICATIONS, B.POSTINGS))
def m14_snapshot_fallback(spark, sf_dir):
    return lifecycle.with_snapshots(B.applications(spark, sf_dir), _p(spark, sf_dir)).select("id", "title")


WANTED = "wanted AS (SELECT c_custkey * 2 AS id, c_custkey % 40 AS user_id FROM customer)"


@query(B.with_tables("SELECT w.id, w.user_id, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.user_id <> w.user_id THEN 'not owned' WHEN p.is_active THEN 'active' ELSE 'deleted' END AS outcome FROM wanted w LEFT JOIN profiles p ON p.id = w.id", B.PROFILES, WANTED))
def m15_profile_delete(spark, sf_dir):
    wanted = B.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), (F.col("c_custkey") % 40).alias("user_id"))
    return lifecycle.deleted_profiles(B.profiles(spark, sf_dir), wanted)


@query(B.with_tables("SELECT id, geo_filtered AND NOT is_active AS geo_filtered, CASE WHEN first_seen_at < TIMESTAMP '2024-02-01' THEN function_category END AS function_category, CASE WHEN first_seen_at < TIMESTAMP '2024-02-01' THEN seniority END AS seniority FROM postings", B.POSTINGS))
def m16_requeue(spark, sf_dir):
    return lifecycle.requeued(_p(spark, sf_dir), B.at("2024-02-01")).select("id", "geo_filtered", "function_category", "seniority")


@query(B.with_tables("SELECT id, user_id FROM applications a WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = a.user_id AND c.c_custkey * 3 = a.id)", B.APPLICATIONS))
def m17_tracker_delete(spark, sf_dir):
    gone = B.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("id"), F.col("c_custkey").alias("user_id"))
    return lifecycle.without(B.applications(spark, sf_dir), gone, ["id", "user_id"]).select("id", "user_id")


@query(B.with_tables("SELECT job_id, profile_id, profile_id + 1 IN (SELECT id FROM profiles) AS kept FROM scores", B.SCORES, B.PROFILES))
def j7_orphans(spark, sf_dir):
    rows = B.scores(spark, sf_dir).withColumn("_pid", F.col("profile_id") + 1)
    return lifecycle.orphans(rows, B.profiles(spark, sf_dir), "_pid").select("job_id", "profile_id", "kept")


@query(B.with_tables("SELECT job_id, profile_id FROM scores s WHERE NOT (profile_id = 1 AND EXISTS (SELECT 1 FROM postings p WHERE p.id = s.job_id AND p.first_seen_at >= TIMESTAMP '2024-02-01'))", B.SCORES, B.POSTINGS))
def j8_scoped_delete(spark, sf_dir):
    window = _p(spark, sf_dir).filter(F.col("first_seen_at") >= B.at("2024-02-01")).select(F.col("id").alias("job_id"), F.lit(1).cast("long").alias("profile_id"))
    return lifecycle.without(B.scores(spark, sf_dir), window, ["job_id", "profile_id"]).select("job_id", "profile_id")


@query(B.with_tables("SELECT count(*) AS queue, count(*) > 1.5 * 50 AS backlog FROM postings WHERE function_category IS NULL AND is_active AND score_total >= 40", B.POSTINGS))
def a18_backlog(spark, sf_dir):
    return enrich.classify_queue(_p(spark, sf_dir)).agg(F.count("*").alias("queue")).withColumn("backlog", F.col("queue") > 1.5 * 50)


@query(B.with_tables("SELECT profile_id, count(*) FILTER (has_breakdown) AS scored, CASE WHEN count(*) FILTER (has_breakdown) < 100 THEN 2000 ELSE 1000 END AS run_limit FROM scores GROUP BY profile_id", B.SCORES))
def a19_run_limit(spark, sf_dir):
    n = F.count_if("has_breakdown")
    return B.scores(spark, sf_dir).groupBy("profile_id").agg(n.alias("scored"), enrich.run_limit(n).alias("run_limit"))


# --- sinks ----------------------------------------------------------------------------------------------------------


def _written(spark, df, by: str | None = None):
    """df, appended to a new table in the session's shared folder and read back."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).mode("append").parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark) -> str:
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="jobloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


@query(B.with_tables(f"SELECT seq, source, success, substr(error_message, 1, 1000) AS error_message, strftime(run_at, '%Y-%m-%d') AS run_date FROM health", B.HEALTH))
def s19_health_sink(spark, sf_dir):
    back = _written(spark, health.log_rows(B.health(spark, sf_dir)), "run_date")
    return back.select("seq", "source", "success", "error_message", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"))


@query(B.with_tables("SELECT id, operation, substr(notes, 1, 500) AS notes, CAST(cents AS DOUBLE) / 1000000 AS cost FROM ledger", B.LEDGER))
def s20_ledger_sink(spark, sf_dir):
    back = _written(spark, ledger.log_rows(_l(spark, sf_dir)))
    return back.select("id", "operation", "notes", F.col("cost_usd").cast("double").alias("cost"))
