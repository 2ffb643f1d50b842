"""Ranked, filtered and paged views, digests and exports."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import FUNCTIONS, REMOTE, SENIORITIES, VERTICALS


@dataclass(frozen=True)
class Filters:
    since: str | None = None
    function: str | None = None
    vertical: str | None = None
    seniority: str | None = None
    remote: str | None = None
    salary_floor: float | None = None
    q: str | None = None
    match_min: float | None = None
    require_scored: bool = False
    include_rejected: bool = False
    posted_within: str | None = None


POSTED_WITHIN = {"1d": 1, "7d": 7, "30d": 30}


def parse_filters(params: dict[str, str | list[str]]) -> Filters:
    """Filters of query parameters; values outside a vocabulary, numbers that aren't, and repeated values are ignored."""
    get = lambda k: v if isinstance(v := params.get(k), str) and v else None

    def one_of(key: str, allowed) -> str | None:
        return get(key) if get(key) in allowed else None

    def number(key: str) -> float | None:
        try:
            n = float(get(key)) if get(key) is not None else None
        except ValueError:
            return None
        return n if n is not None and math.isfinite(n) else None

    return Filters(
        function=one_of("function", FUNCTIONS), vertical=one_of("vertical", VERTICALS), seniority=one_of("seniority", SENIORITIES),
        remote=one_of("remote", REMOTE), salary_floor=number("salaryFloor"), match_min=number("matchMin"),
        posted_within=one_of("postedWithin", POSTED_WITHIN), q=get("q"),
    )


def conditions(f: Filters) -> list[Column]:
    """The conditions that are set; an unset one is left out of the plan."""
    out = []
    if not f.include_rejected:
        out.append(F.col("is_active") & F.col("gate_failed").isNull())
    if f.since:
        out.append(F.col("first_seen_at") >= F.lit(f.since).cast("timestamp"))
    for column, value in (("function_category", f.function), ("vertical", f.vertical), ("seniority", f.seniority), ("remote_status", f.remote)):
        if value:
            out.append(F.col(column) == value)
    if f.salary_floor is not None:
        out.append(F.col("salary_max_usd").isNull() | (F.col("salary_max_usd") >= f.salary_floor))
    if f.q:
        like = f"%{f.q}%"
        out.append(F.col("title").ilike(like) | F.col("company").ilike(like))
    if f.match_min is not None:
        out.append(F.col("match_score") >= f.match_min)
    if f.require_scored:
        out.append(F.col("match_score").isNotNull())
    return out


def filtered(rows: DataFrame, f: Filters) -> DataFrame:
    return reduce(lambda d, c: d.filter(c), conditions(f), rows)


def with_scores(postings: DataFrame, scores: DataFrame, profile_id: int) -> DataFrame:
    """postings with the match_score of one profile; postings without a score stay."""
    own = scores.filter(F.col("profile_id") == profile_id).select(F.col("job_id").alias("id"), "match_score")
    return postings.join(own, "id", "left")


def owned(rows: DataFrame, profiles: DataFrame, profile_id: int, user_id: int) -> DataFrame:
    """rows if the profile is the user's, else none."""
    own = profiles.filter((F.col("id") == profile_id) & (F.col("user_id") == user_id)).select(F.lit(1).alias("_own")).distinct()
    return rows.withColumn("_own", F.lit(1)).join(F.broadcast(own.limit(1)), "_own", "left_semi").drop("_own")



def ranked_order(profile: bool = True) -> list[Column]:
    match = [F.col("match_score").desc_nulls_last()] if profile else []
    return [*match, F.col("score_total").desc_nulls_last(), F.col("first_seen_at").desc(), F.col("id").asc()]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page with rank and total_count. The total is an aggregate of its own, not a window over all rows;
    the page's rank is counted on the page only."""
    top = rows.orderBy(*order).offset(offset).limit(limit)
    total = rows.agg(F.count("*").alias("total_count"))
    numbered = top.withColumn("_all", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("_all").orderBy(*order)) + offset
    return numbered.withColumn("rank", rank).join(F.broadcast(total.withColumn("_all", F.lit(1))), "_all").drop("_all")


def last_page(total: int, size: int, wanted: int) -> int:
    """A page past the end is the last one; there is at least one."""
    return max(1, min(wanted, -(-total // size)))


def clamped_page(rows: DataFrame, order: list[Column], size: int, wanted: int) -> DataFrame:
    """The wanted page, from 1, or the last one where it is past the end. The number of rows comes to the driver."""
    return page(rows, order, size, (last_page(rows.count(), size, wanted) - 1) * size)


#: Named views: days back and rows.
VIEWS = {"today": (1, 60), "week": (7, 100), "archive": (60, 50)}


def cutoff(as_of: str, *days: int) -> Column:
    """The latest of several windows' beginnings."""
    each = [F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(d)) for d in days]
    return F.greatest(*each) if len(each) > 1 else each[0]


def csv_cell(c: Column) -> Column:
    """A cell by RFC 4180; a text that a spreadsheet would run as a formula gets an apostrophe first."""
    text = T.or_empty(c.cast("string"))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def export_lines(rows: DataFrame, columns: list[str]) -> Column:
    apply = F.coalesce(F.col("apply_url"), F.col("source_url"))
    return F.concat_ws(",", *[csv_cell(apply if c == "apply_url" else F.col(c)) for c in columns])


def digest(postings: DataFrame, scores: DataFrame, profile_id: int, since: Column, rows: int = 10) -> DataFrame:
    """The best matches of a profile among recent postings that are served: postings' columns, match_score, rank, badges
    (what is known of its kind), strength and gap (the first of each list, null where there is none)."""
    own = scores.filter(F.col("profile_id") == profile_id).select(F.col("job_id").alias("id"), "match_score", "strengths", "gaps")
    found = filtered(postings.filter(F.col("first_seen_at") >= since).join(own, "id"), Filters())
    top = page(found, [F.col("match_score").desc_nulls_last(), F.col("id").asc()], rows)
    kinds = [F.nullif(F.col(c), F.lit("Unspecified")) for c in ("function_category", "vertical", "seniority", "remote_status")]
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return top.withColumns({"badges": F.concat_ws(" · ", *kinds), "strength": first("strengths"), "gap": first("gaps")}).drop("strengths", "gaps", "total_count")


# Columns of an export, in two styles, and its most rows.
EXPORTED = {
    "title": "Name", "company": "Company", "match_score": "Match", "score_total": "Rule Score", "function_category": "Function",
    "vertical": "Vertical", "seniority": "Seniority", "remote_status": "Remote", "salary_min_usd": "Salary Min", "salary_max_usd": "Salary Max",
    "location": "Location", "source": "Source", "apply_url": "Apply URL", "first_seen_at": "First Seen", "verdict_one_liner": "Verdict",
}
MOST_EXPORTED = 2000


def export(rows: DataFrame, path: str, form: str = "csv", limit: int = MOST_EXPORTED) -> int:
    """Writes the best ranked rows as text under path, by form: `csv` (columns by name), `notion` (by title) or `json` (one
    object a line, no header); gives the number of rows.

    The header and the rows are sorted as one table, so files and their lines stand in rank order, however many there are.
    Columns that rows lack are empty.
    """
    if form not in ("csv", "notion", "json"):
        raise ValueError(f"unknown form: {form}")
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    shown = {c: F.coalesce(has(c), has("source_url")) if c == "apply_url" else has(c) for c in EXPORTED}
    shown["first_seen_at"] = F.date_format(has("first_seen_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    keys = ranked_order("match_score" in rows.columns)
    best = rows.orderBy(*keys).limit(limit)
    line = F.to_json(F.struct(*[v.alias(c) for c, v in shown.items()]), {"ignoreNullFields": "false"}) if form == "json" else F.concat_ws(",", *[csv_cell(v) for v in shown.values()])
    order = ["score_total", "first_seen_at", "id"]
    lines = best.select(line.alias("value"), F.lit(1).alias("_at"), has("match_score").cast("double").alias("match_score"), *order)
    if form != "json":
        names = [n if form == "notion" else c for c, n in EXPORTED.items()]
        head = rows.sparkSession.range(1).select(F.concat_ws(",", *[csv_cell(F.lit(n)) for n in names]).alias("value"), F.lit(0).alias("_at"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("match_score", *order)])
        lines = head.unionByName(lines)
    # The rows are counted as they are written; before the sort they are read more than once, to find its ranges.
    seen = Observation()
    lines.orderBy("_at", *ranked_order()).observe(seen, F.count_if(F.col("_at") == 1).alias("rows")).select("value").write.text(path)
    return seen.get["rows"]


def exported(spark: SparkSession, path: str) -> DataFrame:
    """What export() wrote, file by file: file (number in their order) and text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("name", r"part-(\d+)", 1).cast("int").alias("file"), "text")
