"""Cleaning of raw postings: junk, relevance, mashed titles, tiers and row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import TEXT_CAPS

# Markers, phrases and names.
JUNK_MARKERS = (
    "promoted", "curated marches", "find flexible remote roles", "curated by", "hiring talent from", "browse jobs",
    "post a job", "see all jobs", "view all openings", "featured jobs", "top remote companies",
)
AGGREGATORS = ("cryptojobslist", "web3.career", "cryptocurrencyjobs", "we work remotely", "remoteleaf", "remotive")
WEB3_AGGREGATORS = ("cryptojobslist", "web3.career", "cryptocurrencyjobs")
BROAD_CATEGORIES = ("Remote_Board", "Board")
MASHED = r"^(.+?)(\d+mo|\d+[dmhw]|Featured|Top\s*\d+)(.+?)(Full-Time|Part-Time|Contract|Freelance|Internship)(.*)$"
ROLE_WORDS = (
    r"(?i)\b(engineer|developer|manager|lead|director|analyst|designer|specialist|coordinator|architect|scientist|consultant|"
    r"strategist|head[\s\-]of|vp[\s\-]of|president|marketing|growth|content|social|community|partnerships|sales|bizdev|"
    r"business[\s\-]development|devrel|kol|ambassador|operations|product|research|recruiter|founder|counsel|legal|compliance|"
    r"writer|editor|producer|intern)\b"
)
NAV_PHRASE = (
    r"(?i)^\s*(about|home|contact|blog|news|press|privacy|terms|careers|jobs|login|sign[\s\-]in|subscribe|apply now|learn more|"
    r"read more|see all|view all|explore|discover|welcome|our team|join us)\s*$"
)
JUNK_PREFIX = (
    r"(?i)^\s*(read\s+more|learn\s+more|view\s+(?:full\s+)?(?:job|role|position)|see\s+(?:full\s+)?(?:job|role|description|details)|"
    r"apply\s+(?:now|here)|more\s+info)\b"
)
LONG_TITLE = 80


def is_junk(title: Column, markers: tuple[str, ...] = JUNK_MARKERS) -> Column:
    low = F.lower(T.or_empty(title))
    return (F.length(low) >= LONG_TITLE) & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def looks_like_title(text: Column, roles: str = ROLE_WORDS) -> Column:
    size = F.length(text)
    ok = ~text.rlike(JUNK_PREFIX) & size.between(8, 160) & ~text.rlike(NAV_PHRASE) & text.rlike(roles)
    return F.coalesce(ok, F.lit(False))


def relevant(mode: Column, haystack: Column, function_words: str, default_words: str) -> Column:
    return F.when(mode == "function", haystack.rlike(function_words)).otherwise(haystack.rlike(default_words))


def url_violations(url: Column, most: int = 1000) -> Column:
    """What is wrong with a link, joined by commas: scheme, credentials, length."""
    scheme = ~F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False))
    return F.concat_ws(",", F.when(scheme, "scheme"), F.when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "credentials"), F.when(F.length(url) > most, "length"))


def is_feed(category: Column, name: Column) -> Column:
    low = F.lower(T.or_empty(name))
    return category.eqNullSafe("X_Feed") | low.startswith("x: @") | low.startswith("x:@")


def unmashed(rows: DataFrame) -> DataFrame:
    """Titles of at least 80 characters in which an aggregator ran all fields together are taken apart; with a flag unmashed."""
    t = T.or_empty(F.col("title"))
    hit = (F.length(t) >= LONG_TITLE) & t.rlike(MASHED)
    part = lambda k: T.strip(F.regexp_extract(t, MASHED, k))
    firm = T.strip(F.regexp_replace(part(3), r"(Featured|Top\s*\d+)+$", ""))
    rows = rows.withColumn("unmashed", hit).withColumn("_firm", firm).withColumn("_tail", T.tail_salary(part(5)))
    camel = r"(?s)^(.*?[a-z])([A-Z].*)$"
    two = F.col("_firm").rlike(camel)
    name = F.when(two, T.strip(F.regexp_extract("_firm", camel, 1))).otherwise(F.col("_firm"))
    bled = F.when(two, T.strip(F.regexp_extract("_firm", camel, 2)))
    place = F.col("_tail.location")
    place = F.when(bled.isNotNull() & ((place == "") | (place == T.ANYWHERE)), bled).otherwise(place)
    swap = hit & F.lower(T.or_empty(F.col("company"))).isin(*AGGREGATORS) & (name != "")
    pay = hit & F.col("_tail.lo").isNotNull() & (F.coalesce("salary_min_usd", F.lit(0)) == 0)
    return rows.withColumns({
        "_discovery_channel": F.when(swap, F.col("company")),
        "company": F.when(swap, name).otherwise(F.col("company")),
        "title": F.when(hit, part(1)).otherwise(F.col("title")),
        "location": F.when(hit & (place != ""), place).otherwise(F.col("location")),
        "salary_min_usd": F.when(pay, F.col("_tail.lo")).otherwise(F.col("salary_min_usd")),
        "salary_max_usd": F.when(pay, F.col("_tail.hi")).otherwise(F.col("salary_max_usd")),
        "salary_source": F.when(pay, "listed").otherwise(F.col("salary_source")),
    }).drop("_firm", "_tail")


def source_tier(name: Column, category: Column) -> Column:
    return F.when(F.lower(T.or_empty(name)).isin(*WEB3_AGGREGATORS), 2).when(T.or_empty(category).isin(*BROAD_CATEGORIES), 1).otherwise(3)


def boosted(rows: DataFrame, boost: DataFrame) -> DataFrame:
    """Tier 3 for companies on the boost list (company), compared in lower case without outer space. Spark broadcasts the
    list as long as it is small."""
    names = boost.select(T.strip(F.lower("company")).alias("_b")).distinct()
    joined = rows.join(names, T.strip(F.lower("company")) == F.col("_b"), "left")
    return joined.withColumn("source_tier", F.when(F.col("_b").isNotNull(), 3).otherwise(F.col("source_tier"))).drop("_b")


def shaped(rows: DataFrame) -> DataFrame:
    """Trimmed and capped texts; empty ones are null, but the title; pay only if it is listed."""
    cap = lambda c: F.substring(c, 1, TEXT_CAPS[c])
    listed = F.coalesce(F.col("salary_source") == "listed", F.lit(False))
    text = {c: T.or_null(cap(c)) for c in ("location", "description", "apply_url", "source_url")}
    text["title"] = F.substring(T.strip(T.or_empty(F.col("title"))), 1, TEXT_CAPS["title"])
    text["company"] = T.or_null(F.substring(T.strip(T.or_empty(F.col("company"))), 1, TEXT_CAPS["company"]))
    text["source"] = cap("source")
    return rows.withColumns(text | {c: F.when(listed, F.col(c)) for c in ("salary_min_usd", "salary_max_usd", "salary_source")})
