"""Text, money and date expressions: Column to Column, all on built-ins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of the formats that are read.
COMPANY_SUFFIX = r"\s*(inc|llc|ltd|gmbh|corp|co|labs|foundation)\.?$"
REMOTE_HINTS = ("remote", "anywhere", "worldwide", "global")
INJECTION = (
    r"(?i)(?:ignore|disregard|forget)\s+(?:all\s+|the\s+|your\s+|any\s+|these\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?)"
    r"|disregard\s+all|system\s*[:·]|</?system>|###\s*instructions?|<\|im_start\|>\s*system"
)
MONTHLY_RANGE = r"(?i)(\d{3,5})\s*[-–]\s*(\d{3,5})\s*(?:USD|usd)?\s*/?\s*\b(?:mes|month|mo|monthly)\b"
MONTHLY_SINGLE = r"(?i)(\d{3,5})\s*(?:USD|usd)\s*/?\s*\b(?:mes|month|mo|monthly)\b"
HOURLY = r"(?i)\$(\d+)\s*[-–]?\s*\$?(\d*)\s*/\s*\b(?:hour|hr|h)\b"
SALARY_RANGE = r"\$\s*(\d+)\s*([kK])?\s*[-–]\s*\$?\s*(\d+)\s*([kK])?"
TAIL_RANGE = r"\$?([\d,]+)\s*[-–]\s*\$?([\d,]+)\s*USD"
TAIL_FLOOR = r"\$([\d,]+)\s*or\s*more\s*USD?"
ANYWHERE = "Anywhere in the World"
ENTITIES = (("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
WORK_NOTE = r"(?i)\s*[\(\[].*?(remote|hybrid|onsite|full[\s\-]?time|part[\s\-]?time|location).*?[\)\]]"
BADGES = r"(?i)(\s+(remote|hybrid|on[\s\-]?site|full[\s\-]?time|part[\s\-]?time|contract|freelance|internship)(\s+(available|role|only))?\s*)+$"


SPACE = " \t\n\x0b\f\r"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often it is used: the variable of a one-element transform."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalized(c: Column) -> Column:
    """Lower case without company suffix and punctuation; null is empty."""
    bare = F.regexp_replace(strip(F.lower(or_empty(c))), COMPANY_SUFFIX, "")
    return collapsed(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "))


def location_bucket(c: Column) -> Column:
    """any, remote, or the city in 24 characters."""
    city = lambda low: F.substring(collapsed(F.regexp_replace(F.substring_index(low, ",", 1), r"[^\p{L}\p{N}_\s]", " ")), 1, 24)
    named = lambda low: F.coalesce(or_null(city(low)), F.lit("any"))
    return once(strip(F.lower(or_empty(c))), lambda low: F.when(low.rlike("|".join(REMOTE_HINTS)), "remote").otherwise(named(low)))


def dedup_key(title: Column, company: Column, location: Column) -> Column:
    return F.concat_ws("|", normalized(title), normalized(company), location_bucket(location))


def valid_key(key: Column) -> Column:
    """Whether title or company say anything: the part before the last bar is not empty or a bar."""
    return F.coalesce(~F.regexp_replace(key, r"\|[^|]*$", "").isin("", "|"), F.lit(False))


def strip_html(c: Column) -> Column:
    """Tags to spaces, then six entities in their order, then one space for each run of white space."""
    bare = F.regexp_replace(or_empty(c), "<[^>]+>", " ")
    return collapsed(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare))


def strip_html_if_markup(c: Column) -> Column:
    """Only text that begins with a tag is stripped, and entities stay."""
    text = or_empty(c)
    return F.when(text.rlike(r"^\s*<"), collapsed(F.regexp_replace(text, "<[^>]+>", " "))).otherwise(strip(text))


def strip_html_unescaped(c: Column) -> Column:
    """Entities first, then tags."""
    plain = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES[1:] + ENTITIES[:1], or_empty(c))
    return collapsed(F.regexp_replace(plain, "<[^>]+>", " "))


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


def salary_range(c: Column) -> Column:
    """struct(lo, hi) of a text like $50k - $80k; null unless 10k <= lo <= hi <= 2M."""
    part = lambda k: F.regexp_extract(c, SALARY_RANGE, k)
    scaled = lambda v, k: number(part(v)).cast("long") * F.when(part(k) != "", 1000).otherwise(1)
    lo, hi = scaled(1, 2), scaled(3, 4)
    ok = (lo >= 10_000) & (lo <= hi) & (hi <= 2_000_000)
    return F.when(ok, F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))


def currency_kept(c: Column, none_text: bool = False) -> Column:
    """Whether salary fields stay: no currency or US dollars; none_text also takes the word NONE as no currency."""
    return F.upper(strip(or_empty(c))).isin(*(["", "USD"] + ["NONE"] * none_text))


def annualized(lo: Column, hi: Column, most_monthly: int = 10_000) -> Column:
    """struct(lo, hi); both bounds times 12 if the upper one, or else the lower one, looks monthly."""
    factor = F.when(F.coalesce(hi, lo) <= most_monthly, 12).otherwise(1)
    return F.struct((lo * factor).alias("lo"), (hi * factor).alias("hi"))


def tail_salary(c: Column) -> Column:
    """struct(location, lo, hi) of text that ends in a salary."""
    lo, hi = number(F.regexp_extract(c, TAIL_RANGE, 1)), number(F.regexp_extract(c, TAIL_RANGE, 2))
    floor = number(F.regexp_extract(c, TAIL_FLOOR, 1))
    rest = lambda p: F.coalesce(or_null(strip(F.regexp_replace(c, p + r"\s*", ""))), F.lit(ANYWHERE))
    row = lambda place, a, b: F.struct(place.alias("location"), a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    none = F.lit(None).cast("int")
    return (
        F.when((lo >= 1_000) & (lo <= hi) & (hi <= 1_000_000), row(rest(TAIL_RANGE), lo, hi))
        .when((floor >= 1_000) & (floor <= 1_000_000), row(rest(TAIL_FLOOR), floor, floor))
        .otherwise(row(c, none, none))
    )


def clean_title(c: Column) -> Column:
    plain = F.regexp_replace(or_empty(c), r"[\x{10000}-\x{10ffff}]", "")
    return collapsed(F.regexp_replace(F.regexp_replace(plain, WORK_NOTE, ""), BADGES, ""))


def blob(title: Column, company: Column, description: Column, location: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(or_empty(c) for c in (title, company, description, location))))


def inferred_salary(text: Column) -> Column:
    """struct(lo, hi) a year from monthly or hourly pay in a text: a monthly range, a monthly sum, an hourly rate.

    Each pattern runs over the text once; its groups are read from what it found.
    """
    found = lambda p: F.regexp_extract(text, p, 0)
    rate = F.when(F.contains(text, F.lit("$")) & F.contains(text, F.lit("/")), found(HOURLY))
    hits = F.struct(found(MONTHLY_RANGE).alias("range"), found(MONTHLY_SINGLE).alias("single"), rate.alias("rate"))
    part = lambda m, p, k: F.regexp_extract(m, p, k).try_cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    none = F.lit(None).cast("int")

    def pay(m: Column) -> Column:
        low, one, hour = part(m["range"], MONTHLY_RANGE, 1), part(m["single"], MONTHLY_SINGLE, 1), part(m["rate"], HOURLY, 1)
        return (
            F.when(low.isNotNull(), pair(low * 12, part(m["range"], MONTHLY_RANGE, 2) * 12))
            .when(one.isNotNull(), pair(one * 12, one * 12))
            .when((hour > 1) & (hour < 100), pair(hour * 2080, hour * 2080))
            .otherwise(pair(none, none))
        )

    return once(hits, pay)


def redacted(c: Column) -> Column:
    return F.regexp_replace(c, INJECTION, "[redacted]")


def search_term(c: Column) -> Column:
    """A search term without wildcards, brackets and control characters, in 100 characters; empty is null."""
    return or_null(F.substring(strip(F.regexp_replace(c, r"[%_*,()\\.:\"'\x00-\x1f\x7f]", "")), 1, 100))


def thousands(c: Column) -> Column:
    return F.when(c >= 1000, F.concat(F.lit("$"), F.floor(c / 1000 + 0.5).cast("string"), F.lit("k"))).otherwise(F.concat(F.lit("$"), c.cast("string")))


def salary_label(lo: Column, hi: Column) -> Column:
    both = lo.isNotNull() & hi.isNotNull() & (lo != hi)
    return F.when(both, F.concat(thousands(lo), F.lit("–"), thousands(hi))).otherwise(thousands(F.coalesce(lo, hi)))


def usd_label(c: Column) -> Column:
    # Half up on the binary value, as in a script's toFixed; format_string alone rounds the shortest decimal form.
    fixed = lambda d: F.concat(F.lit("$"), F.format_string(f"%.{d}f", F.floor(c.cast("double") * 10**d + 0.5) / 10**d))
    return F.when(c == 0, "$0.00").when(c < 0.01, fixed(4)).when(c < 1, fixed(3)).otherwise(fixed(2))


def age_label(then: Column, now: Column) -> Column:
    half_up = lambda x: F.floor(x + 0.5)
    mins = F.greatest(F.lit(0), half_up((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60))
    hours = half_up(mins / 60)
    days = half_up(hours / 24)
    weeks, months = half_up(days / 7), half_up(days / 30)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return F.when(mins < 1, "just now").when(mins < 60, say(mins, "m")).when(hours < 24, say(hours, "h")).when(days < 7, say(days, "d")).when(weeks < 5, say(weeks, "w")).otherwise(say(months, "mo"))


def bucketed(c: Column, cuts: list[tuple[float, str]], below: str) -> Column:
    """The label of the first cut, from the highest, that the value reaches; null where there is no value."""
    chain = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, label in sorted(cuts, reverse=True):
        chain = chain.when(c >= cut, label)
    return chain.otherwise(below)


def fingerprint(text: Column, chars: int | None = None) -> Column:
    return F.sha2((F.substring(text, 1, chars) if chars else text).cast("binary"), 256)


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f/\\]", "_"), 1, 255)


def token_cost(fresh: Column, write: Column, read: Column, out: Column, price_in: float, price_out: float, write_rate: float, read_rate: float) -> Column:
    """Dollars, exact to six places: tokens times price for a million of them."""
    price = lambda c, p: c.cast("decimal(18,0)") * F.lit(f"{p:.4f}").cast("decimal(10,4)")
    total = price(fresh, price_in) + price(write, price_in * write_rate) + price(read, price_in * read_rate) + price(out, price_out)
    return F.round(total / F.lit(1_000_000).cast("decimal(10,0)"), 6).cast("decimal(18,6)")
