"""Model enrichment as tables: queues, requests, responses and what they change."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import CLASSIFY_MIN, FUNCTIONS, PARSE_FAIL, PARSE_WARN, REMOTE, RESCUE_CAP, RESCUE_FLOOR, RESCUE_HITS, SENIORITIES, VERTICALS, WARM
from . import skill_index


def best_first() -> list[Column]:
    return [F.col("score_total").desc_nulls_last(), F.col("id").asc()]


def classify_queue(postings: DataFrame, least: int = CLASSIFY_MIN) -> DataFrame:
    return postings.filter(F.col("function_category").isNull() & F.col("is_active") & (F.col("score_total") >= least))


def geo_queue(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("is_active") & ~F.col("geo_filtered") & F.col("remote_status").isNotNull())


def unscored(postings: DataFrame, scores: DataFrame, profile_id: int) -> DataFrame:
    """Postings without a score that has a breakdown, for one profile."""
    done = scores.filter((F.col("profile_id") == profile_id) & F.col("has_breakdown")).select(F.col("job_id").alias("id"))
    return postings.join(done, "id", "left_anti")


def eligible(postings: DataFrame, scores: DataFrame, profile_id: int, since: Column, warm: int = WARM) -> DataFrame:
    ok = F.col("is_active") & F.col("geo_filtered") & F.col("geo_reject_reason").isNull() & (F.col("score_total") >= warm) & (F.col("first_seen_at") >= since)
    return unscored(postings.filter(ok), scores, profile_id)


def term_hits(blob: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(blob, t)))


def borderline(postings: DataFrame, since: Column, floor: int = RESCUE_FLOOR, warm: int = WARM) -> DataFrame:
    """Recent postings that passed every gate and whose score is just under the warm one; text is what terms are looked up in."""
    ok = F.col("is_active") & F.col("geo_filtered") & (F.col("score_total") >= floor) & (F.col("score_total") < warm) & (F.col("first_seen_at") >= since)
    return postings.filter(ok).withColumn("text", F.lower(F.concat_ws(" ", T.or_empty(F.col("title")), T.or_empty(F.col("description")))))


def rescued(postings: DataFrame, scores: DataFrame, profile_id: int, terms: list[str], since: Column, floor: int = RESCUE_FLOOR, warm: int = WARM, least_hits: int = RESCUE_HITS) -> DataFrame:
    """Borderline postings without a score for a profile whose title or description has so many of the profile's terms,
    with hits. A profile without terms rescues none."""
    rows = unscored(borderline(postings, since, floor, warm), scores, profile_id)
    return rows.withColumn("hits", term_hits(F.col("text"), terms)).filter(F.col("hits") >= least_hits) if terms else rows.withColumn("hits", F.lit(0)).filter(F.lit(False))


def rescued_by_profile(postings: DataFrame, scores: DataFrame, terms: DataFrame, since: Column, floor: int = RESCUE_FLOOR, warm: int = WARM, least_hits: int = RESCUE_HITS, best: int | None = None, stored: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """rescued() for every profile of terms (profile_id, term) at once: id, profile_id, hits, score_total. With best, some
    of each profile's pairs, its first so many (best_first()) among them."""
    rows = stored(borderline(postings, since, floor, warm).select("id", "text", "score_total"))
    done = scores.filter("has_breakdown").select(F.col("job_id").alias("id"), "profile_id")
    hits = skill_index.profile_hits(rows.select("id", "text", (-F.col("score_total")).alias("place")), terms, least_hits, done=done, best=best, stored=stored)
    # A few bytes for each borderline posting; the pairs stay where they are made.
    return hits.join(F.broadcast(rows.select("id", "score_total")), "id")


def with_rescued(first: DataFrame, more: DataFrame, limit: int, cap: int = RESCUE_CAP) -> DataFrame:
    """first (at most limit rows), and of more the best: so many as are left of the limit, and cap at most, with the flag
    rescued. How many are left is counted within the plan."""
    left = first.agg(F.greatest(F.lit(0), F.least(F.lit(cap), F.lit(limit) - F.count("*"))).alias("_left"), F.lit(1).alias("_all"))
    best = more.orderBy(*best_first()).limit(cap).withColumn("_all", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("_all").orderBy(*best_first()))
    kept = best.withColumn("_rank", rank).join(F.broadcast(left), "_all").filter(F.col("_rank") <= F.col("_left"))
    names = [c for c in first.columns if c in more.columns]
    return first.select(*names, F.lit(False).alias("rescued")).unionByName(kept.select(*names, F.lit(True).alias("rescued")))


def with_rescued_by_profile(first: DataFrame, more: DataFrame, limit: int, cap: int = RESCUE_CAP) -> DataFrame:
    """with_rescued() for each profile_id: profile_id, id, rescued. first has at most limit rows a profile."""
    left = first.groupBy("profile_id").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy(*best_first()))
    kept = more.withColumn("_rank", rank).filter(F.col("_rank") <= cap).join(left, "profile_id", "left").filter(F.col("_rank") <= F.lit(limit) - F.coalesce("_n", F.lit(0)))
    return first.select("profile_id", "id", F.lit(False).alias("rescued")).unionByName(kept.select("profile_id", "id", F.lit(True).alias("rescued")))


def run_limit(scored: Column, backlog_below: int = 100, normal: int = 1000, backlog: int = 2000) -> Column:
    return F.when(scored < backlog_below, backlog).otherwise(normal)


def matched(responses: DataFrame, requests_: DataFrame) -> DataFrame:
    """responses with the flag known: a request with their custom_id was sent."""
    asked = requests_.select("custom_id").distinct().withColumn("known", F.lit(True))
    return responses.join(asked, "custom_id", "left").withColumn("known", F.col("known").isNotNull())


def outcomes(responses: DataFrame, by: str) -> DataFrame:
    """Counts of failed, unparsed and good answers (outcome, body)."""
    failed, parsed = F.col("outcome") != "succeeded", F.col("body").isNotNull()
    return responses.groupBy(by).agg(F.count_if(failed).alias("errored"), F.count_if(~failed & ~parsed).alias("json_failed"), F.count_if(~failed & parsed).alias("ok"), F.count("*").alias("total"))


def verdict_of(outcome: Column, known: Column, body: Column, built: Column) -> Column:
    """What became of an answer: errored, unknown_id (nothing with its custom_id was sent), json_failed, build_failed (no
    row could be made of it) or ok."""
    return F.when(~outcome.eqNullSafe("succeeded"), "errored").when(~F.coalesce(known, F.lit(False)), "unknown_id").when(body.isNull(), "json_failed").when(~F.coalesce(built, F.lit(False)), "build_failed").otherwise("ok")


def write_back(responses: DataFrame, requests_: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of what became of the answers (custom_id, outcome, body) to score requests, by a column or of all: errored,
    unknown_id, json_failed, build_failed, parse_failed (the three together), ok and repeated.

    A custom_id that is answered more than once counts once, by the best of its answers (a good one before a failed one);
    the others are repeated. Answers without a custom_id each count as unknown.
    """
    row = score_of(F.col("body"))
    said = verdict_of(F.col("outcome"), F.col("known"), F.col("body"), row.isNotNull())
    rank = {"ok": 0, "build_failed": 1, "json_failed": 2, "unknown_id": 3, "errored": 4}
    order = F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("said"))
    keys = [by] if by else []
    judged = matched(responses, requests_).select(*keys, "custom_id", said.alias("said"))
    solo = F.when(F.col("custom_id").isNull(), F.monotonically_increasing_id())
    each = judged.withColumn("_solo", solo).groupBy(*keys, "custom_id", "_solo").agg(F.min_by("said", order).alias("said"), (F.count("*") - 1).alias("_again"))
    counts = [F.count_if(F.col("said") == k).alias(k) for k in ("errored", "unknown_id", "json_failed", "build_failed", "ok")]
    out = each.groupBy(*keys).agg(*counts, F.coalesce(F.sum("_again"), F.lit(0)).alias("repeated"))
    return out.withColumn("parse_failed", F.col("json_failed") + F.col("build_failed") + F.col("unknown_id"))


def usage(responses: DataFrame) -> DataFrame:
    """Tokens of failed and of other answers."""
    return responses.groupBy((F.col("outcome") != "succeeded").alias("errored")).agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"))


# --- requests -------------------------------------------------------------------------------------------------------


def requests(postings: DataFrame, stage: str, model: str, system: str, chars: int, max_tokens: int, redact: bool) -> DataFrame:
    """One request for each posting: stage, custom_id, model, max_tokens, system, user."""
    clean = T.redacted if redact else (lambda c: c)
    show = lambda c, label, n: F.concat(F.lit(f"{label}: "), F.coalesce(T.or_null(F.substring(clean(T.or_empty(F.col(c))), 1, n)), F.lit("(none)")))
    user = F.concat_ws("\n", show("title", "Title", 500), show("company", "Company", 200), show("location", "Location", 200), show("description", "Description", chars))
    return postings.select(F.lit(stage).alias("stage"), F.concat(F.lit(f"{stage}-"), F.col("id").cast("string")).alias("custom_id"), F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(system).alias("system"), user.alias("user"))


def request_lines(rows: DataFrame) -> Column:
    params = F.struct("model", "max_tokens", "system", F.array(F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))).alias("messages"))
    return F.to_json(F.struct("custom_id", params.alias("params")))


# --- responses ------------------------------------------------------------------------------------------------------

FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, with regard to strings and escapes."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for brace in re.finditer(r"\{", text):
        try:
            value, end = decoder.raw_decode(text, brace.start())
        except ValueError:
            return None
        return text[brace.start() : end] if isinstance(value, dict) else None
    return None


def _walked(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)


def json_object(text: Column) -> Column:
    """A text's JSON object as text: the whole text without a fence if it parses, else the first balanced object; null
    for other values, empty objects and texts without one. Only texts that don't parse as they are go to Python."""
    bare = F.coalesce(T.or_null(F.regexp_extract(text, FENCE, 1)), text)
    whole = F.when(bare.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(bare).isNotNull(), T.strip(bare))
    found = F.when(whole.isNotNull(), whole).otherwise(F.pandas_udf(_walked, "string")(F.when(whole.isNull(), bare)))
    return F.when(found.rlike(r"^\{\s*\}$"), None).otherwise(found)


def get(body: Column, path: str) -> Column:
    return F.get_json_object(body, f"$.{path}")


def in_enum(c: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(fallback)


def safe_int(c: Column, default: int | None = None) -> Column:
    """Whole numbers; fractions are cut off; anything else is the default."""
    n = c.try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 2**31)
    return F.when(ok, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("int")).otherwise(F.lit(default).cast("int"))


def clamped_salary(c: Column) -> Column:
    n = safe_int(c)
    return F.when((n >= 1) & (n <= 2_000_000), n)


def clamped_confidence(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)) * 100, 0) / 100)


def clamped_score(c: Column) -> Column:
    n = safe_int(c)
    return F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), n)))


def classify_patch(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows (id, salary_source, body) with the columns that a classification writes; pay only where none is listed."""
    b = F.col(body)
    open_pay = ~F.coalesce(F.col("salary_source") == "listed", F.lit(False))
    lo, hi = (F.when(open_pay, clamped_salary(get(b, f"salary_{s}_usd"))) for s in ("min", "max"))
    swap = lo > hi
    return rows.select(
        "id",
        in_enum(get(b, "function_category"), FUNCTIONS, "Other").alias("function_category"),
        clamped_confidence(get(b, "function_confidence")).alias("function_confidence"),
        in_enum(get(b, "seniority"), SENIORITIES, "Unspecified").alias("seniority"),
        in_enum(get(b, "vertical"), VERTICALS, "Other").alias("vertical"),
        in_enum(get(b, "remote_status"), REMOTE, "Unspecified").alias("remote_status"),
        F.when(swap, hi).otherwise(lo).alias("salary_min_usd"),
        F.when(swap, lo).otherwise(hi).alias("salary_max_usd"),
        F.when(lo.isNotNull() | hi.isNotNull(), "extracted_by_ai").alias("salary_source"),
    )


def geo_decision(outcome: Column, body: Column) -> Column:
    """struct(passed, reason): only a literal false rejects; errors, unparsed and missing answers pass."""
    no = (outcome == "succeeded") & body.isNotNull() & (get(body, "eligible") == "false") & body.rlike(r'"eligible"\s*:\s*false')
    return F.struct((~F.coalesce(no, F.lit(False))).alias("passed"), F.when(no, F.substring(F.coalesce(get(body, "reason"), F.lit("")), 1, 200)).alias("reason"))


#: The dimensions of a score.
DIMENSIONS = ("skill_match", "industry_fit", "title_alignment", "seniority", "requirements", "geography")
#: Values that say nothing, as text; a text among them says so much as it is, but for the empty one.
NOTHING = ("", "0", "0.0", "false", "[]", "{}")
BREAKDOWN = (
    "struct<location_eligible:boolean,subtotal:int,dimensions:map<string,struct<score:int,notes:string>>,"
    "adjustments:array<struct<label:string,value:int>>,strengths:array<string>,gaps:array<string>>"
)


def kind(v: Column) -> Column:
    """What a variant holds: object, array, string, number, boolean, or null where there is none or a JSON null."""
    return T.once(F.schema_of_variant(v), lambda t: F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t != "VOID", "number"))


def part(v: Column, name: str, kind_: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind_)


def listed(v: Column) -> Column:
    """The elements of a variant that is an array; of anything else, none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def typed(v: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(kind, text) of a variant, each computed once."""
    return T.once(F.struct(kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), lambda x: of(x["kind"], x["text"]))


def said(v: Column, chars: int, trimmed: bool = True) -> Column:
    """A variant as text of so many characters; what is empty, zero or false says nothing, and so does null."""
    full = typed(v, lambda k, t: F.when((k != "string") & t.isin(*NOTHING), "").otherwise(T.or_empty(t)))
    return F.substring(T.strip(full) if trimmed else full, 1, chars)


def whole(v: Column, default: int | None = 0) -> Column:
    """A variant as a whole number, fractions cut off; texts count if they hold a number, booleans don't."""
    return T.once(typed(v, lambda k, t: F.when(k.isin("number", "string"), T.strip(t))), lambda n: safe_int(n, default))


def clean_list(v: Column, most: int = 4, chars: int = 140) -> Column:
    """Of the first elements of an array, the texts that aren't blank, trimmed and cut."""
    texts = F.transform(F.slice(listed(v), 1, most), lambda x: typed(x, lambda k, t: F.when(k == "string", F.substring(T.strip(t), 1, chars))))
    return F.filter(texts, lambda s: F.coalesce(s != "", F.lit(False)))


def final_score(v: Column) -> Column:
    """A whole number within 0 and 100 of a number (fractions cut off), a boolean or the text of a whole number; else null."""

    def of(k: Column, t: Column) -> Column:
        digits = (k == "string") & t.rlike(r"^\s*[+-]?\d+\s*$")
        # Beyond 32 bits only the sign counts.
        number = F.when((k == "number") | digits, F.coalesce(safe_int(T.strip(t)), F.when(T.strip(t).startswith("-"), 0).otherwise(100)))
        return number.when(k == "boolean", F.when(t == "true", 1).otherwise(0))

    return T.once(typed(v, of), lambda n: F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), n))))


def fits(v: Column, *kinds: str) -> Column:
    """Whether a part is of one of some kinds, or says nothing."""
    return typed(v, lambda k, t: k.isNull() | k.isin(*kinds) | F.when(k == "string", t == "").otherwise(t.isin(*NOTHING)))


def score_of(body: Column) -> Column:
    """struct(match_score, strengths, gaps, verdict, breakdown) of an answer; null where no row can be made of it.

    An ineligible place scores 0 and has a breakdown that says just so. Else the score must be a whole number or the text
    of one, and is kept within 0 and 100. dimensions, and each dimension in it, must be objects where they are there;
    adjustments that are no objects are left out.
    """
    texts = F.array().cast("array<string>")
    minimal = F.struct(F.lit(False), *[F.lit(None)] * 5).cast(BREAKDOWN)
    row = lambda n, s, g, v, b: F.struct(n.cast("int").alias("match_score"), s.alias("strengths"), g.alias("gaps"), v.alias("verdict"), b.alias("breakdown"))

    dimensions = lambda v: F.array(*[F.struct(F.lit(d).alias("name"), part(v, f"dimensions.{d}").alias("of")) for d in DIMENSIONS])

    def full(v: Column, verdict: Column, score: Column) -> Column:
        cell = lambda x: F.struct(whole(part(x["of"], "score")).alias("score"), said(part(x["of"], "notes"), 80, False).alias("notes"))
        by_name = F.map_from_entries(F.transform(dimensions(v), lambda x: F.struct(x["name"], cell(x))))
        objects = F.filter(listed(part(v, "adjustments")), lambda a: F.coalesce(kind(a) == "object", F.lit(False)))
        changes = F.transform(objects, lambda a: F.struct(said(part(a, "label"), 60, False).alias("label"), whole(part(a, "value")).alias("value")))
        lists = F.struct(clean_list(part(v, "strengths")).alias("s"), clean_list(part(v, "gaps")).alias("g"))
        return T.once(lists, lambda x: row(score, x["s"], x["g"], verdict, F.struct(F.lit(True), whole(part(v, "subtotal")), by_name, changes, x["s"], x["g"]).cast(BREAKDOWN)))

    def made(v: Column) -> Column:
        sound = fits(part(v, "dimensions"), "object") & fits(part(v, "adjustments"), "array", "object", "string")
        sound = sound & F.forall(dimensions(v), lambda x: fits(x["of"], "object"))
        known = F.struct(
            typed(part(v, "location_eligible"), lambda k, t: F.coalesce((k == "boolean") & (t == "false"), F.lit(False))).alias("away"),
            F.when(sound, final_score(part(v, "final_score"))).alias("score"),
            typed(part(v, "verdict"), lambda k, t: F.when(k == "string", T.or_null(F.substring(T.strip(t), 1, 120)))).alias("verdict"),
        )
        return T.once(known, lambda x: F.when(x["away"], row(F.lit(0), texts, texts, x["verdict"], minimal)).when(x["score"].isNotNull(), full(v, x["verdict"], x["score"])))

    return T.once(F.try_parse_json(body), lambda v: F.when(kind(v) == "object", made(v)))


def score_rows(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows (job_id, profile_id, body) as score rows with score_of()'s fields; an answer that no row can be made of goes."""
    out = rows.select("job_id", "profile_id", score_of(F.col(body)).alias("r")).filter("r IS NOT NULL")
    return out.select("job_id", "profile_id", "r.*")


def parse_status(failed: Column, total: Column) -> Column:
    ratio = F.try_divide(failed.cast("double"), total)
    return F.when(ratio > PARSE_FAIL, "hard_fail").when(ratio > PARSE_WARN, "warn").otherwise("ok")


# --- profiles -------------------------------------------------------------------------------------------------------

# Closed vocabularies of a skill graph, and how much of each list is kept.
LEVELS = ("senior", "intermediate", "exposure")
ANCHORS = ("principal", "staff", "senior", "mid", "junior", "unclear")
MOST_SKILLS, MOST_DOMAINS, MOST_OTHERS = 30, 15, 10
NAME_CHARS, EVIDENCE_CHARS, PLACE_CHARS, PHRASE_CHARS = 60, 80, 80, 120
MOST_YEARS = 50


def sane_graph(text: Column) -> Column:
    """A skill graph as struct(skills, domains, seniority_anchor, location, languages, deal_breakers, preferences); null
    where the text is no JSON object.

    The text is parsed once, each part is read by the type it has: a part of another type is empty, an element of a list
    that has no text goes after the list was cut. Levels and the anchor are closed vocabularies in lower case.
    """
    cut = lambda x, chars: F.substring(T.strip(T.or_empty(F.try_variant_get(x, "$", "string"))), 1, chars)
    texts = lambda v, most, chars: F.filter(F.transform(F.slice(listed(v), 1, most), lambda x: cut(x, chars)), lambda s: s != "")
    word = lambda v: typed(v, lambda k, t: F.when(k == "string", F.lower(T.strip(t))))

    def years(v: Column) -> Column:
        n = typed(v, lambda k, t: F.when((k == "number") | ((k == "string") & t.rlike(r"^\s*[+-]?\d+\s*$")), safe_int(T.strip(t))).when(k == "boolean", F.when(t == "true", 1)))
        return F.greatest(F.lit(0), F.least(F.lit(MOST_YEARS), F.coalesce(n, F.lit(0))))

    def skill(v: Column) -> Column:
        return F.struct(said(part(v, "name"), NAME_CHARS).alias("name"), in_enum(word(part(v, "level")), LEVELS, "exposure").alias("level"), years(part(v, "years")).alias("years"), said(part(v, "evidence"), EVIDENCE_CHARS).alias("evidence"))

    def made(v: Column) -> Column:
        objects = F.filter(F.slice(listed(part(v, "skills")), 1, MOST_SKILLS), lambda x: F.coalesce(kind(x) == "object", F.lit(False)))
        place = part(v, "location")
        at = lambda k: F.when(kind(place) == "object", said(part(place, k), PLACE_CHARS)).otherwise("")
        graph = F.struct(
            F.filter(F.transform(objects, skill), lambda s: s["name"] != "").alias("skills"),
            texts(part(v, "domains"), MOST_DOMAINS, NAME_CHARS).alias("domains"),
            in_enum(word(part(v, "seniority_anchor")), ANCHORS, "unclear").alias("seniority_anchor"),
            F.struct(at("city").alias("city"), at("country").alias("country")).alias("location"),
            texts(part(v, "languages"), MOST_OTHERS, NAME_CHARS).alias("languages"),
            texts(part(v, "deal_breakers"), MOST_OTHERS, PHRASE_CHARS).alias("deal_breakers"),
            texts(part(v, "preferences"), MOST_OTHERS, PHRASE_CHARS).alias("preferences"),
        )
        return F.when(kind(v) == "object", graph)

    return T.once(F.try_parse_json(text), made)


def skill_terms(graph: Column, least: int = 3) -> Column:
    return F.transform(F.filter(graph.skills, lambda s: F.length(s["name"]) >= least), lambda s: F.lower(s["name"]))


# Places that are known by name, a word and a place, and two names with a comma between them.
PLACES = r"(Buenos Aires|Rosario|Córdoba|Mendoza|Argentina|CABA|[A-Z][a-z]+,\s*[A-Z][a-zA-Z ]+)"
# An end of a word: letters and digits of any script are in words, whatever \b means to the Java version.
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD_END = f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"
KNOWN_PLACE = f"(?=[A-Z])(?<!{WORD_CHAR}){PLACES}{WORD_END}"
TWO_NAMES = r"([A-Z][a-zA-Z ]{2,}),\s*([A-Z][a-zA-Z ]{2,})"
LINE_ENDS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def profile_location(text: Column, lines: int = 30) -> Column:
    """The first place in the first lines of a profile: known places in any of them come before two names with a comma."""
    head = lambda t: F.slice(F.split(t, LINE_ENDS), 1, lines)
    first = lambda rows, p: F.try_element_at(F.filter(F.transform(rows, lambda s: F.regexp_extract(s, p, 0)), lambda s: s != ""), F.lit(1))
    return T.once(head(text), lambda rows: T.strip(F.coalesce(first(rows, KNOWN_PLACE), first(rows, TWO_NAMES))))


def city_country(place: Column) -> Column:
    """The first and the last part between commas; one part is both."""
    parts = F.transform(F.split(place, ","), T.strip)
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("city"), F.try_element_at(parts, F.lit(-1)).alias("country"))


def payload(graph: Column, text: Column) -> Column:
    """struct(mode, payload): the graph if it is there and not empty, else the text."""
    has = graph.isNotNull() & ~graph.rlike(r"^\s*(\{\s*\})?\s*$")
    return F.struct(F.when(has, "graph").otherwise("text").alias("mode"), F.when(has, graph).otherwise(text).alias("payload"))
