"""Queries of filters, ranked views, joins and exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, dedup, enrich, lifecycle, reports, scoring, serving
from . import bindings as B
from . import sql as S
from .registry import query
from .state_queries import shared_folder
from .text_queries import BANDED, BLOBBED, CONFIG, GATE, SCORED

PROFILE, OWNER = 1, 1
SERVED = "is_active AND gate_failed IS NULL"
JOINED = f"joined AS (SELECT p.*, s.match_score FROM postings p LEFT JOIN scores s ON s.job_id = p.id AND s.profile_id = {PROFILE})"
ORDER = "match_score DESC NULLS LAST, score_total DESC NULLS LAST, first_seen_at DESC, id"


def _p(spark, sf_dir):
    return B.postings(spark, sf_dir)


def _joined(spark, sf_dir):
    return serving.with_scores(_p(spark, sf_dir), B.scores(spark, sf_dir), PROFILE)


def paged(where: str, order: str, limit: int, offset: int = 0, source: str = "joined") -> str:
    return f"SELECT id, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS rank, total_count FROM (SELECT *, count(*) OVER () AS total_count FROM {source} WHERE {where}) ORDER BY {order} LIMIT {limit} OFFSET {offset}"


def _page(rows, profile: bool, limit: int, offset: int = 0):
    return serving.page(rows, serving.ranked_order(profile), limit, offset).select("id", "rank", "total_count")


@query(B.with_tables(
    f"""SELECT id, score_total, CAST(row_number() OVER (ORDER BY {ORDER}) AS INT) AS rank, total_count FROM (
      SELECT *, count(*) OVER () AS total_count FROM (SELECT k.id, k.total AS score_total, k.first_seen_at, s.match_score FROM best k
        LEFT JOIN scores s ON s.job_id = k.id AND s.profile_id = {PROFILE} WHERE k.is_active AND k.gate IS NULL)) ORDER BY {ORDER} LIMIT 50""",
    B.POSTINGS, B.SCORES, BLOBBED, BANDED, SCORED,
    f"keyed AS (SELECT *, {S.key('title', 'company', 'location')} AS dedup_key FROM scored)",
    f"""best AS (SELECT * FROM keyed QUALIFY NOT {S.valid_key('dedup_key')} OR row_number() OVER (PARTITION BY dedup_key ORDER BY source_tier DESC,
      CAST(coalesce(salary_min_usd, 0) <> 0 OR coalesce(salary_max_usd, 0) <> 0 AS INT) DESC, length(coalesce(description, '')) DESC, seq) = 1)"""))  # fmt: skip
def flagship_ranked(spark, sf_dir):
    """Top 50 ranked, deduplicated, rule-scored postings with the total."""
    best = dedup.richest(dedup.keyed(_p(spark, sf_dir)).drop("score_total", "gate_failed"))
    rows = scoring.scored(best, CONFIG).withColumn("gate_failed", F.col("score_breakdown.gate_failed"))
    top = serving.filtered(serving.with_scores(rows, B.scores(spark, sf_dir), PROFILE), serving.Filters())
    return serving.page(top, serving.ranked_order(), 50).select("id", "score_total", "rank", "total_count")


MARKERS = ("tion the", "of the", "der die")
LOWT = "lower(coalesce(title, ''))"


@query(B.with_tables(f"SELECT id FROM postings WHERE NOT (length({LOWT}) >= 80 AND {S.hits(LOWT, MARKERS)} > 0)", B.POSTINGS))
def f1_junk_listing(spark, sf_dir):
    return _p(spark, sf_dir).filter(~clean.is_junk(F.col("title"), MARKERS)).select("id")


@query(B.with_tables(f"SELECT id, 'title-excluded: ' || ({GATE}) AS gate_failed FROM postings", B.POSTINGS))
def f2_title_gate(spark, sf_dir):
    return _p(spark, sf_dir).select("id", scoring.gate(F.col("title"), CONFIG).alias("gate_failed"))


KEYED = f"keyed AS (SELECT *, CASE WHEN id % 10 = 0 THEN '||any' WHEN id % 10 = 1 THEN NULL ELSE {S.key('title', 'company', 'location')} END AS k FROM postings)"


@query(B.with_tables(f"SELECT id, {S.valid_key('k')} AS ok FROM keyed", B.POSTINGS, KEYED))
def f3_valid_key(spark, sf_dir):
    k = F.when(F.col("id") % 10 == 0, "||any").when(F.col("id") % 10 == 1, None).otherwise(F.col("dedup_key"))
    return dedup.keyed(_p(spark, sf_dir)).select("id", T.valid_key(k).alias("ok"))


ROLES = r"(?i)\b(the|der|de|of)\b"


def _re(c: str, p: str) -> str:
    return f"regexp_matches({c}, {S.lit(p)})"


LINES = "lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line FROM documents)"


def _lines(spark, sf_dir):
    """Every line of every text: id, line, t."""
    return B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))


@query(f"WITH {LINES} SELECT id, line, coalesce(NOT {_re('t', clean.JUNK_PREFIX)} AND length(t) BETWEEN 8 AND 160 AND NOT {_re('t', clean.NAV_PHRASE)} AND {_re('t', ROLES)}, false) AS ok FROM lines")
def f5_title_like(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "line", clean.looks_like_title(F.col("t"), ROLES).alias("ok"))


FUNCTION, DEFAULT = r"(?i)\b(the|and|of)\b", r"(?i)\b(der|la|el)\b"


def _word(p: str) -> str:
    """The pattern with word bounds that know all letters; the oracle's own know ASCII only."""
    return p.replace("\\b(", "(?:^|[^\\p{L}\\p{N}_])(", 1).replace(")\\b", ")(?:$|[^\\p{L}\\p{N}_])", 1)


@query(f"SELECT doc_id AS id FROM documents WHERE CASE WHEN lang = 'en' THEN {_re('text', _word(FUNCTION))} ELSE {_re('text', _word(DEFAULT))} END")
def f6_relevance_mode(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    mode = F.when(F.col("lang") == "en", "function").otherwise("default")
    return d.filter(clean.relevant(mode, F.col("text"), FUNCTION, DEFAULT)).select(F.col("doc_id").alias("id"))


@query(B.with_tables(f"SELECT id, match_score FROM joined WHERE {SERVED} AND first_seen_at >= TIMESTAMP '2024-01-10' AND function_category = 'Other' AND (salary_max_usd IS NULL OR salary_max_usd >= 60000) AND (title ILIKE '%th%' OR company ILIKE '%th%')", B.POSTINGS, B.SCORES, JOINED))
def f7_serving_filter(spark, sf_dir):
    f = serving.Filters(since="2024-01-10", function="Other", salary_floor=60000, q="th")
    return serving.filtered(_joined(spark, sf_dir), f).select("id", "match_score")


#: Parameters as they come, and the conditions that are left of them.
ASKED = (
    ({"function": "Marketing", "salaryFloor": "60000", "q": "th"}, "function_category = 'Marketing' AND (salary_max_usd IS NULL OR salary_max_usd >= 60000) AND (title ILIKE '%th%' OR company ILIKE '%th%')"),
    ({"function": "Wizardry", "vertical": "Fintech", "matchMin": "60"}, "vertical = 'Fintech' AND match_score >= 60"),
    ({"seniority": ["Senior", "Mid"], "salaryFloor": "much", "remote": "Remote"}, "remote_status = 'Remote'"),
    ({"seniority": "Senior", "matchMin": "inf", "q": ""}, "seniority = 'Senior'"),
)


@query(B.with_tables(" UNION ALL ".join(f"SELECT {k} AS asked, id FROM joined WHERE {SERVED} AND {sql}" for k, (_, sql) in enumerate(ASKED)), B.POSTINGS, B.SCORES, JOINED))
def f8_filter_parameters(spark, sf_dir):
    rows = _joined(spark, sf_dir)
    each = [serving.filtered(rows, serving.parse_filters(p)).select(F.lit(k).alias("asked"), "id") for k, (p, _) in enumerate(ASKED)]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(B.with_tables(
    f"SELECT id, rank, total_count FROM (SELECT id, CAST(row_number() OVER (ORDER BY {ORDER}) AS INT) AS rank, count(*) OVER () AS total_count FROM joined WHERE {SERVED}) WHERE rank > (total_count - 1) // 50 * 50", B.POSTINGS, B.SCORES, JOINED))
def k3_page_past_the_end(spark, sf_dir):
    rows = serving.filtered(_joined(spark, sf_dir), serving.Filters())
    return serving.clamped_page(rows, serving.ranked_order(), 50, 10**9).select("id", "rank", "total_count")


@query(B.with_tables(f"SELECT id FROM postings WHERE first_seen_at >= greatest(TIMESTAMP '{B.AS_OF}' - INTERVAL 60 DAY, TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY)", B.POSTINGS))
def f9_effective_cutoff(spark, sf_dir):
    return _p(spark, sf_dir).filter(F.col("first_seen_at") >= serving.cutoff(B.AS_OF, 60, serving.POSTED_WITHIN["30d"])).select("id")


@query(f"WITH {LINES} SELECT id, line, nullif(substr({S.strip(S.sub('t', chr(91) + '%_*,()' + chr(92) + chr(92) + '.:' + chr(34) + chr(39) + chr(92) + 'x00-' + chr(92) + 'x1f' + chr(92) + 'x7f]', ''))}, 1, 100), '') AS term FROM lines")
def f10_search_sanitize(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "line", T.search_term(F.col("t")).alias("term"))


BEST = "score_total DESC NULLS LAST, id"


@query(B.with_tables(f"SELECT id FROM postings WHERE function_category IS NULL AND is_active AND score_total >= 40 ORDER BY {BEST} LIMIT 500", B.POSTINGS))
def f11_classify_queue(spark, sf_dir):
    return enrich.classify_queue(_p(spark, sf_dir)).orderBy(*enrich.best_first()).limit(500).select("id")


@query(B.with_tables(f"SELECT id FROM postings WHERE is_active AND NOT geo_filtered AND remote_status IS NOT NULL ORDER BY {BEST} LIMIT 1000", B.POSTINGS))
def f12_geo_queue(spark, sf_dir):
    return enrich.geo_queue(_p(spark, sf_dir)).orderBy(*enrich.best_first()).limit(1000).select("id")


@query(B.with_tables("SELECT job_id, match_score FROM scores WHERE EXISTS (SELECT 1 FROM profiles WHERE id = 1 AND user_id = 1)", B.SCORES, B.PROFILES))
def f13_owner_scope(spark, sf_dir):
    return serving.owned(B.scores(spark, sf_dir), B.profiles(spark, sf_dir), PROFILE, OWNER).select("job_id", "match_score")


URLS = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'ftp://files.example.com/x' ELSE url || repeat('a', 1000) END"


@query(f"WITH t AS (SELECT page_id AS id, {URLS} AS u FROM pages) SELECT id, concat_ws(',', CASE WHEN NOT {_re('u', '^https?://')} THEN 'scheme' END, CASE WHEN {_re('u', '^[a-z]+://[^/?#]*@')} THEN 'credentials' END, CASE WHEN length(u) > 1000 THEN 'length' END) AS violations FROM t")
def f14_url_validity(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), clean.url_violations(F.expr(URLS)).alias("violations"))


@query(B.with_tables("SELECT id FROM postings WHERE first_seen_at >= TIMESTAMP '2024-01-20' AND geo_reject_reason IS NOT NULL", B.POSTINGS))
def f15_rescore_window(spark, sf_dir):
    return lifecycle.rescore_window(_p(spark, sf_dir), B.at("2024-01-20")).select("id")


@query(B.with_tables("SELECT id, match_score FROM joined", B.POSTINGS, B.SCORES, JOINED))
def j1_left_scores(spark, sf_dir):
    return _joined(spark, sf_dir).select("id", "match_score")


TOP = f"SELECT p.id, s.match_score, CAST(row_number() OVER (ORDER BY s.match_score DESC NULLS LAST, p.id) AS INT) AS rank FROM postings p JOIN scores s ON s.job_id = p.id WHERE s.profile_id = {PROFILE} AND {SERVED} AND p.first_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY ORDER BY s.match_score DESC NULLS LAST, p.id LIMIT 10"


def _top(spark, sf_dir, days: int):
    own = B.scores(spark, sf_dir).filter(F.col("profile_id") == PROFILE).select(F.col("job_id").alias("id"), "match_score")
    rows = serving.filtered(_p(spark, sf_dir).filter(F.col("first_seen_at") >= serving.cutoff(B.AS_OF, days)).join(own, "id"), serving.Filters())
    return serving.page(rows, [F.col("match_score").desc_nulls_last(), F.col("id").asc()], 10)


@query(B.with_tables(TOP, B.POSTINGS, B.SCORES))
def j2_inner_top(spark, sf_dir):
    return _top(spark, sf_dir, 30).select("id", "match_score", "rank")


@query(B.with_tables(f"SELECT id FROM postings p WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.job_id = p.id AND s.profile_id = {PROFILE} AND s.has_breakdown)", B.POSTINGS, B.SCORES))
def j3_unscored(spark, sf_dir):
    return enrich.unscored(_p(spark, sf_dir), B.scores(spark, sf_dir), PROFILE).select("id")


@query(B.with_tables("SELECT p.id, a.user_id, min(a.id) AS application_id FROM postings p LEFT JOIN applications a ON a.job_id = p.id GROUP BY ALL", B.POSTINGS, B.APPLICATIONS))
def j5_saved_map(spark, sf_dir):
    return reports.saved_map(_p(spark, sf_dir), B.applications(spark, sf_dir))


TERMS = ("the", "tion", "wh", "enau", "leaux", "der", "que", "ción")
RECENT = f"first_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY"
UNSCORED = f"NOT EXISTS (SELECT 1 FROM scores s WHERE s.job_id = p.id AND s.profile_id = {PROFILE} AND s.has_breakdown)"
#: Postings just under the warm score that passed every gate, with the text that terms are looked up in.
BORDERLINE = f"""borderline AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS b FROM postings
  WHERE is_active AND geo_filtered AND score_total >= 35 AND score_total < 40 AND {RECENT})"""
RESCUED = f"SELECT * FROM (SELECT *, CAST({S.hits('b', TERMS)} AS INT) AS hits FROM borderline p WHERE {UNSCORED}) WHERE hits >= 3"


def _rescued(spark, sf_dir):
    return enrich.rescued(_p(spark, sf_dir), B.scores(spark, sf_dir), PROFILE, list(TERMS), serving.cutoff(B.AS_OF, 30))


@query(B.with_tables(f"SELECT id, hits FROM ({RESCUED})", B.POSTINGS, B.SCORES, BORDERLINE))
def j9_skill_hits(spark, sf_dir):
    return _rescued(spark, sf_dir).select("id", "hits")


#: Each profile's terms: the longer ones of a document's first words, of two customers the same.
PROFILE_TERMS = """own AS (SELECT c_custkey AS profile_id, lower(trim(w)) AS term FROM (
    SELECT c_custkey, unnest(list_slice(string_split(d.text, ' '), 1, 12)) AS w FROM customer JOIN documents d ON d.doc_id = c_custkey // 2) GROUP BY ALL),
  terms AS (SELECT * FROM own WHERE length(term) >= 3)"""
BY_PROFILE = """SELECT p.id, t.profile_id, count(*) AS hits, any_value(p.score_total) AS score_total FROM borderline p JOIN terms t ON contains(p.b, t.term)
  WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.job_id = p.id AND s.profile_id = t.profile_id AND s.has_breakdown) GROUP BY p.id, t.profile_id HAVING count(*) >= 3"""


def profile_terms(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.expr("c_custkey div 2").alias("doc_id"))
    # A text is cut before it meets the customers, so no whole text is shuffled or split.
    first = B.table(spark, sf_dir, "documents").select("doc_id", F.slice(F.split("text", " ", 13), 1, 12).alias("words"))
    return c.join(first, "doc_id").select("profile_id", F.explode("words").alias("term"))


def _rescued_by_profile(spark, sf_dir, best=None):
    def stored(rows):
        path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    return enrich.rescued_by_profile(_p(spark, sf_dir), B.scores(spark, sf_dir), profile_terms(spark, sf_dir), serving.cutoff(B.AS_OF, 30), best=best, stored=stored)


@query(B.with_tables(f"SELECT id, profile_id, hits FROM ({BY_PROFILE})", B.POSTINGS, B.SCORES, BORDERLINE, PROFILE_TERMS))
def j9_profile_hits(spark, sf_dir):
    """Borderline postings for all customers as profiles with terms of their own."""
    return _rescued_by_profile(spark, sf_dir).select("id", "profile_id", "hits")


@query(B.with_tables(paged(SERVED, ORDER, 50), B.POSTINGS, B.SCORES, JOINED))
def k1_ranked(spark, sf_dir):
    return _page(serving.filtered(_joined(spark, sf_dir), serving.Filters()), True, 50)


@query(B.with_tables(paged(SERVED, ORDER.split(", ", 1)[1], 50, source="postings"), B.POSTINGS))
def k2_ranked_no_profile(spark, sf_dir):
    return _page(serving.filtered(_p(spark, sf_dir), serving.Filters()), False, 50)


ELIGIBLE = f"is_active AND geo_filtered AND geo_reject_reason IS NULL AND score_total >= 40 AND first_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.job_id = p.id AND s.profile_id = {PROFILE} AND s.has_breakdown)"


def _eligible(spark, sf_dir):
    return enrich.eligible(_p(spark, sf_dir), B.scores(spark, sf_dir), PROFILE, serving.cutoff(B.AS_OF, 30))


@query(B.with_tables(f"SELECT id FROM postings p WHERE {ELIGIBLE} ORDER BY {BEST} LIMIT 1000", B.POSTINGS, B.SCORES))
def k4_eligible_topk(spark, sf_dir):
    return _eligible(spark, sf_dir).orderBy(*enrich.best_first()).limit(1000).select("id")


#: A limit that the eligible postings nearly reach.
RUN_LIMIT = 150


@query(B.with_tables(
    "SELECT id, false AS rescued FROM first UNION ALL SELECT id, true FROM (SELECT id, row_number() OVER (ORDER BY " + BEST + f") AS n FROM ({RESCUED})) WHERE n <= least(100, {RUN_LIMIT} - (SELECT count(*) FROM first))",
    B.POSTINGS, B.SCORES, BORDERLINE, f"first AS (SELECT id FROM postings p WHERE {ELIGIBLE} ORDER BY {BEST} LIMIT {RUN_LIMIT})"))
def k5_rescue_union(spark, sf_dir):
    first = _eligible(spark, sf_dir).orderBy(*enrich.best_first()).limit(RUN_LIMIT)
    return enrich.with_rescued(first.select("id"), _rescued(spark, sf_dir), RUN_LIMIT)


@query(B.with_tables(
    """SELECT profile_id, id, false AS rescued FROM first UNION ALL SELECT profile_id, id, true FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score_total DESC, id) AS n FROM more) m
      WHERE n <= least(100, 4 - (SELECT count(*) FROM first f WHERE f.profile_id = m.profile_id))""",
    B.POSTINGS, B.SCORES, BORDERLINE, PROFILE_TERMS, f"more AS ({BY_PROFILE})", "first AS (SELECT profile_id, job_id AS id FROM scores WHERE has_breakdown QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY job_id) <= 3)"))
def k5_rescue_by_profile(spark, sf_dir):
    """Each profile's first three scored postings, filled up to four with rescued ones."""
    done = B.scores(spark, sf_dir).filter("has_breakdown")
    first = done.withColumn("n", F.row_number().over(Window.partitionBy("profile_id").orderBy("job_id"))).filter("n <= 3").select("profile_id", F.col("job_id").alias("id"))
    return enrich.with_rescued_by_profile(first, _rescued_by_profile(spark, sf_dir, 4), 4)


#: What a score says for and against: lists of no, one or two entries.
STRENGTHS = "CASE job_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['s' || job_id] ELSE ['s' || job_id, 'more'] END"
DIGEST = f"""SELECT id, concat_ws(' · ', nullif(function_category, 'Unspecified'), nullif(vertical, 'Unspecified'), nullif(seniority, 'Unspecified'), nullif(remote_status, 'Unspecified')) AS badges,
  strengths[1] AS strength, CASE WHEN id % 2 = 0 THEN 'gap ' || id END AS gap, match_score, rank FROM (
  SELECT p.*, {STRENGTHS.replace('job_id', 'p.id')} AS strengths, s.match_score, CAST(row_number() OVER (ORDER BY s.match_score DESC NULLS LAST, p.id) AS INT) AS rank FROM postings p JOIN scores s ON s.job_id = p.id
  WHERE s.profile_id = {PROFILE} AND {SERVED} AND p.first_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 7 DAY ORDER BY s.match_score DESC NULLS LAST, p.id LIMIT 10)"""


@query(B.with_tables(DIGEST, B.POSTINGS, B.SCORES))
def k6_digest_top10(spark, sf_dir):
    k = F.col("job_id")
    name = F.concat(F.lit("s"), k.cast("string"))
    strengths = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(name)).otherwise(F.array(name, F.lit("more")))
    said = B.scores(spark, sf_dir).withColumns({"strengths": strengths, "gaps": F.when(k % 2 == 0, F.array(F.concat(F.lit("gap "), k.cast("string"))))})
    return serving.digest(_p(spark, sf_dir), said, PROFILE, serving.cutoff(B.AS_OF, 7)).select("id", "badges", "strength", "gap", "match_score", "rank")


@query(B.with_tables(paged(f"{SERVED} AND first_seen_at >= TIMESTAMP '{B.AS_OF}' - INTERVAL 7 DAY", ORDER, 100), B.POSTINGS, B.SCORES, JOINED))
def k8_week_view(spark, sf_dir):
    days, size = serving.VIEWS["week"]
    rows = serving.filtered(_joined(spark, sf_dir).filter(F.col("first_seen_at") >= serving.cutoff(B.AS_OF, days)), serving.Filters())
    return _page(rows, True, size)


@query(B.with_tables(f"SELECT user_id, id, {B.sql_stamp('updated_at')}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS INT) AS rank FROM applications", B.APPLICATIONS))
def k9_newest_first(spark, sf_dir):
    return lifecycle.newest_first(B.applications(spark, sf_dir)).select("user_id", "id", B.stamp("updated_at"), "rank")


EXPORT = ("id", "title", "company", "apply_url", "salary_min_usd", "match_score")


def _cell(c: str) -> str:
    t = f"coalesce(CAST({c} AS VARCHAR), '')"
    safe = f"CASE WHEN regexp_matches({t}, '^[=+\\-@\\t\\r]') THEN '''' || {t} ELSE {t} END"
    return f"CASE WHEN regexp_matches({safe}, '[\",\\n\\r]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END"


@query(B.with_tables(
    "SELECT " + " || ',' || ".join(_cell("coalesce(apply_url, source_url)" if c == "apply_url" else c) for c in EXPORT)
    + f" AS line FROM (SELECT * FROM joined WHERE {SERVED} ORDER BY {ORDER} LIMIT 2000)", B.POSTINGS, B.SCORES, JOINED))
def s21_export_lines(spark, sf_dir):
    rows = serving.filtered(_joined(spark, sf_dir), serving.Filters()).orderBy(*serving.ranked_order()).limit(2000)
    return rows.select(serving.export_lines(rows, list(EXPORT)).alias("line"))


SHOWN = {c: {"apply_url": "coalesce(apply_url, source_url)", "first_seen_at": "strftime(first_seen_at, '%Y-%m-%dT%H:%M:%SZ')", "verdict_one_liner": "CASE WHEN id % 3 = 0 THEN '=good, \"fit\"' END"}.get(c, c) for c in serving.EXPORTED}


def _csv_sql(header) -> str:
    return f"{S.lit(','.join(header))} || chr(10) || string_agg({' || chr(44) || '.join(_cell(c) for c in SHOWN.values())}, chr(10) ORDER BY {ORDER}) || chr(10)"


@query(B.with_tables(
    f"SELECT form, n_rows, sha256(body) AS sha256 FROM (SELECT 'csv' AS form, count(*) AS n_rows, {_csv_sql(serving.EXPORTED)} AS body FROM best UNION ALL SELECT 'notion', count(*), {_csv_sql(serving.EXPORTED.values())} FROM best UNION ALL "
    + "SELECT 'json', count(*), string_agg('{' || " + " || ',' || ".join(S.lit(f'"{c}":') + f" || coalesce(CAST(to_json({v}) AS VARCHAR), 'null')" for c, v in SHOWN.items()) + f" || '}}', chr(10) ORDER BY {ORDER}) || chr(10) FROM best)",
    B.POSTINGS, B.SCORES, JOINED, f"best AS (SELECT * FROM joined WHERE {SERVED} ORDER BY {ORDER} LIMIT 2000)"))
def s21_export_files(spark, sf_dir):
    """Exports in all forms, read back: how many rows each has, and a hash of its whole text in file order."""
    rows = serving.filtered(_joined(spark, sf_dir), serving.Filters()).withColumn("verdict_one_liner", F.when(F.col("id") % 3 == 0, '=good, "fit"'))
    out = []
    for form in ("csv", "notion", "json"):
        path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex[:12]}"
        n = serving.export(rows, path, form)
        files = F.array_sort(F.collect_list(F.struct("file", "text")))
        body = F.array_join(F.transform(files, lambda x: x["text"]), "")
        out.append(serving.exported(spark, path).agg(F.sha2(body.cast("binary"), 256).alias("sha256")).select(F.lit(form).alias("form"), F.lit(n).cast("long").alias("n_rows"), "sha256"))
    return reduce(DataFrame.unionByName, out)


@query(B.with_tables(f"SELECT id, total_count FROM (SELECT *, count(*) OVER () AS total_count FROM joined WHERE {SERVED} ORDER BY {ORDER} LIMIT 50 OFFSET 50)", B.POSTINGS, B.SCORES, JOINED))
def w2_page_total(spark, sf_dir):
    return _page(serving.filtered(_joined(spark, sf_dir), serving.Filters()), True, 50, 50).select("id", "total_count")


@query(B.with_tables("SELECT user_id, min(id) AS profile_id FROM profiles WHERE is_active GROUP BY user_id", B.PROFILES))
def w8_active_profile(spark, sf_dir):
    return lifecycle.active_profiles(B.profiles(spark, sf_dir))
