"""Payload formats to raw postings: each reader takes rows (source, url, category, page, body) and gives RAW_POSTING columns.

Read schemas name every alias of a field; nothing is inferred. A body that doesn't parse gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DESCRIPTION_CHARS = 5000
RAW_COLUMNS = ("title", "company", "location", "description", "apply_url", "source_url", "salary_min_usd", "salary_max_usd", "salary_source", "category")


def first(*columns: Column) -> Column:
    """The first of several aliases that is there and not empty."""
    return F.coalesce(*[T.or_null(c) for c in columns])


def _raw(rows: DataFrame, extra: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Raw postings; fields that a format lacks are null, and rows without a title go."""
    none = {c: F.lit(None).cast("int" if c.startswith("salary_m") else "string") for c in RAW_COLUMNS}
    given = none | {"source_url": F.col("url"), "category": F.col("category")} | columns
    out = rows.select("source", *[given[c].alias(c) for c in RAW_COLUMNS], *[given[c].alias(c) for c in extra])
    return out.filter(F.length(F.coalesce("title", F.lit(""))) > 0)


def _each(rows: DataFrame, schema: str, path: Callable[[Column], Column]) -> DataFrame:
    """One row for each job of a JSON body, in the column j; b is the whole body."""
    return rows.withColumn("b", F.from_json("body", schema)).withColumn("j", F.explode(path(F.col("b"))))


def greenhouse(rows: DataFrame) -> DataFrame:
    job = "struct<id:bigint,title:string,location:struct<name:string>,absolute_url:string,content:string>"
    r = _each(rows, f"jobs array<{job}>", lambda b: b.jobs)
    j = F.col("j")
    fallback = F.concat(F.lit("https://boards.greenhouse.io/"), greenhouse_slug(F.col("url")), F.lit("/jobs/"), j["id"].cast("string"))
    body = F.when(T.or_null(j["content"]).isNotNull(), F.substring(T.strip_html(j["content"]), 1, DESCRIPTION_CHARS))
    return _raw(r, title=T.strip(j["title"]), company=F.col("source"), location=j["location"]["name"], description=body, apply_url=first(j["absolute_url"], fallback))


def lever(rows: DataFrame) -> DataFrame:
    job = "struct<text:string,categories:struct<location:string>,hostedUrl:string,applyUrl:string,descriptionPlain:string,description:string,salaryRange:struct<min:double,max:double,currency:string>>"
    r = _each(rows, f"array<{job}>", lambda b: b)
    j = F.col("j")
    keep = T.currency_kept(j["salaryRange"]["currency"])
    lo, hi = (F.when(keep, j["salaryRange"][s]) for s in ("min", "max"))
    paid = (F.coalesce(lo, F.lit(0.0)) != 0) | (F.coalesce(hi, F.lit(0.0)) != 0)
    out = _raw(
        r, title=T.strip(j["text"]), company=F.col("source"), location=j["categories"]["location"], apply_url=first(j["hostedUrl"], j["applyUrl"]),
        description=T.or_null(F.substring(first(j["descriptionPlain"], j["description"]), 1, DESCRIPTION_CHARS)),
        salary_min_usd=lo.cast("int"), salary_max_usd=hi.cast("int"), salary_source=F.when(paid, "listed"),
    )
    return out.filter("apply_url IS NOT NULL")


def ashby(rows: DataFrame) -> DataFrame:
    tier = "struct<currencyCode:string,currency:string,minValue:double,maxValue:double,min:double,max:double>"
    job = f"struct<title:string,jobUrl:string,applyUrl:string,externalLink:string,locationName:string,location:string,descriptionPlain:string,descriptionHtml:string,organization:struct<name:string>,compensationTiers:array<{tier}>>"
    r = _each(rows, f"jobs array<{job}>", lambda b: b.jobs)
    j = F.col("j")
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit(0.0)), b)
    lo, hi = (lambda t: some(t["minValue"], t["min"])), (lambda t: some(t["maxValue"], t["max"]))
    good = F.filter(j["compensationTiers"], lambda t: T.currency_kept(first(t["currencyCode"], t["currency"]), none_text=True) & (lo(t) > 0) & (lo(t) <= hi(t)))
    pay = F.try_element_at(good, F.lit(1))
    body = T.or_null(F.substring(T.strip_html_if_markup(first(j["descriptionPlain"], j["descriptionHtml"])), 1, DESCRIPTION_CHARS))
    out = _raw(
        r, title=T.strip(j["title"]), company=T.strip(first(j["organization"]["name"], F.col("source"))), location=first(j["locationName"], j["location"]),
        description=body, apply_url=first(j["jobUrl"], j["applyUrl"], j["externalLink"]),
        salary_min_usd=lo(pay).cast("int"), salary_max_usd=hi(pay).cast("int"), salary_source=F.when(pay.isNotNull(), "listed"),
    )
    return out.filter("apply_url IS NOT NULL")


WORKDAY_PAGES = 5


def workday(rows: DataFrame) -> DataFrame:
    """The first pages of a board; links are made absolute with its public address."""
    r = _each(rows.filter(F.col("page") < WORKDAY_PAGES), "jobPostings array<struct<title:string,externalPath:string,locationsText:string>>", lambda b: b.jobPostings)
    j = F.col("j")
    slug = workday_slug(F.col("url"))
    base = F.concat(F.lit("https://"), slug["tenant"], F.lit(".wd"), slug["wd"], F.lit(".myworkdayjobs.com/"), slug["site"])
    return _raw(r.filter(T.or_null(j["externalPath"]).isNotNull()), title=T.strip(j["title"]), company=F.col("source"), location=T.or_null(j["locationsText"]), apply_url=F.concat(base, j["externalPath"]))


def bamboohr(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Jobs of the lists with their detail bodies (source, job_id, body); without a detail a row has its title only."""
    r = _each(lists, "result array<struct<id:string,jobOpeningName:string>>", lambda b: b.result)
    opening = F.from_json("body", "result struct<jobOpening:struct<jobOpeningName:string,description:string,jobOpeningShareUrl:string,location:string>>")["result"]["jobOpening"]
    d = details.select(F.col("source").alias("_s"), F.col("job_id").alias("_id"), opening.alias("d")).filter("d IS NOT NULL")
    both = r.join(d, (F.col("source") == F.col("_s")) & (F.col("j.id") == F.col("_id")), "left")
    place = F.col("d.location")
    place = F.when(place.startswith("{"), first(F.get_json_object(place, "$.name"), F.get_json_object(place, "$.city"))).otherwise(T.or_null(place))
    page = F.concat(F.regexp_extract("url", r"^https?://[^/]+", 0), F.lit("/careers/"), F.col("j.id"))
    body = T.or_null(F.substring(T.collapsed(F.regexp_replace("d.description", "<[^>]+>", " ")), 1, DESCRIPTION_CHARS))
    return _raw(both, title=T.strip(F.col("j.jobOpeningName")), company=F.col("source"), location=place, description=body, apply_url=first(F.col("d.jobOpeningShareUrl"), page))


def _items(rows: DataFrame, fields: str) -> DataFrame:
    return rows.withColumn("b", F.from_xml("body", f"channel struct<item:array<struct<{fields}>>>")).withColumn("j", F.explode("b.channel.item"))


def teamtailor(rows: DataFrame) -> DataFrame:
    r = _items(rows, "title:string,link:string,description:string")
    body = T.or_null(F.substring(T.collapsed(F.regexp_replace("j.description", "<[^>]+>", " ")), 1, DESCRIPTION_CHARS))
    return _raw(r, title=T.strip(F.col("j.title")), company=F.col("source"), description=body, apply_url=T.or_null(T.strip(F.col("j.link")))).filter("apply_url IS NOT NULL")


def workable(rows: DataFrame) -> DataFrame:
    job = "struct<title:string,shortlink:string,url:string,application_url:string,shortcode:string,code:string,description:string,city:string,country:string,telecommuting:boolean>"
    r = _each(rows, f"name string, jobs array<{job}>", lambda b: b.jobs)
    j = F.col("j")
    by_code = F.concat(F.lit("https://apply.workable.com/j/"), first(j["shortcode"], j["code"]), F.lit("/"))
    place = T.or_null(F.concat_ws(", ", T.or_null(j["city"]), T.or_null(j["country"])))
    place = F.when(F.coalesce(j["telecommuting"], F.lit(False)), F.when(place.isNull(), "Remote").otherwise(F.concat(F.lit("Remote — "), place))).otherwise(place)
    body = T.or_null(F.substring(T.strip_html_if_markup(j["description"]), 1, DESCRIPTION_CHARS))
    out = _raw(r, title=T.strip(j["title"]), company=T.strip(first(F.col("b.name"), F.col("source"))), location=place, description=body, apply_url=first(j["shortlink"], j["url"], j["application_url"], by_code))
    return out.filter("apply_url IS NOT NULL")


def cryptojobslist(rows: DataFrame) -> DataFrame:
    """A list, an object with jobs or data, or the JSON that a page carries for its scripts."""
    job = (
        "struct<jobTitle:string,title:string,job_title:string,companyName:string,company:string,company_name:string,seoSlug:string,slug:string,companySlug:string,"
        "jobLocation:string,location:string,remote:boolean,tags:array<string>,isActive:boolean,is_active:boolean,active:boolean,filled:boolean,salaryMin:double,salaryMax:double,salaryCurrency:string>"
    )
    blob = T.or_null(F.regexp_extract("body", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1))
    body = F.coalesce(blob, F.col("body"))
    inner = F.from_json(body, f"jobs array<{job}>, data array<{job}>, props struct<pageProps:struct<jobs:array<{job}>>>")
    jobs = F.when(body.rlike(r"^\s*\["), F.from_json(body, f"array<{job}>")).otherwise(F.coalesce(inner["jobs"], inner["data"], inner["props"]["pageProps"]["jobs"]))
    r = rows.withColumn("j", F.explode(jobs))
    j = F.col("j")
    on = F.coalesce(j["isActive"], j["is_active"], j["active"], F.lit(True)) & ~F.coalesce(j["filled"], F.lit(False))
    place = first(j["jobLocation"], j["location"])
    place = F.when(place.startswith("{"), first(*[F.get_json_object(place, f"$.{k}") for k in ("name", "city", "country")])).otherwise(place)
    place = F.coalesce(place, F.when(j["remote"], "Remote"))
    keep = T.currency_kept(j["salaryCurrency"])
    lo, hi = F.when(keep, j["salaryMin"]).cast("int"), F.when(keep, j["salaryMax"]).cast("int")
    firm = T.strip(first(j["companyName"], j["company"], j["company_name"]))
    slug = first(j["seoSlug"], j["slug"], j["companySlug"])
    out = _raw(
        r.filter(on), ("_cjl_company",), title=T.strip(first(j["jobTitle"], j["title"], j["job_title"])), company=firm, location=place,
        description=T.or_null(F.substring(F.array_join(F.coalesce(j["tags"], F.array().cast("array<string>")), ", "), 1, 500)),
        apply_url=F.when(slug.isNotNull(), F.concat(F.regexp_extract("url", r"^https?://[^/]+", 0), F.lit("/jobs/"), slug)).otherwise(F.col("url")),
        salary_min_usd=lo, salary_max_usd=hi, salary_source=F.when((F.coalesce(lo, F.lit(0)) != 0) | (F.coalesce(hi, F.lit(0)) != 0), "listed"), _cjl_company=firm,
    )
    return out.filter(F.length(F.coalesce("company", F.lit(""))) > 0)


def web3_api(rows: DataFrame) -> DataFrame:
    """The first list of jobs inside a mixed list, or of an object's jobs, data or results. Pay is a text, an object or flat fields."""
    v = F.try_parse_json("body")
    parts = F.from_json("body", "array<string>")
    nested = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^\s*\[\s*\{")), F.lit(1))
    flat = F.when(F.try_element_at(parts, F.lit(1)).rlike(r"^\s*\{"), F.col("body"))
    named = F.coalesce(*[F.get_json_object("body", f"$.{k}") for k in ("jobs", "data", "results")])
    jobs = F.from_json(F.when(F.col("body").rlike(r"^\s*\["), F.coalesce(nested, flat)).otherwise(named), "array<string>")
    r = rows.filter(v.isNotNull()).withColumn("j", F.explode(jobs))
    get = lambda k: T.strip(F.get_json_object("j", f"$.{k}"))
    pay = F.get_json_object("j", "$.salary")
    range_ = T.salary_range(pay)
    both = lambda a, b: F.coalesce(F.get_json_object("j", a), F.get_json_object("j", b)).try_cast("int")
    is_text, is_object = pay.isNotNull() & ~pay.startswith("{") & (pay != ""), pay.startswith("{")
    lo = F.when(is_text, range_["lo"]).when(is_object, both("$.salary.min", "$.salary.from")).otherwise(both("$.salary_min", "$.salary_from"))
    hi = F.when(is_text, range_["hi"]).when(is_object, both("$.salary.max", "$.salary.to")).otherwise(both("$.salary_max", "$.salary_to"))
    ok = (lo >= 10_000) & (lo <= hi) & (hi <= 2_000_000)
    return _raw(
        r, ("_discovery_channel",), title=first(get("title"), get("job_title"), get("name")), company=F.coalesce(first(get("company"), get("company_name"), get("employer")), F.lit("Unknown")),
        location=first(get("location"), get("country"), get("city")), apply_url=first(get("apply_url"), get("url"), get("link"), F.col("url")),
        description=T.or_null(F.substring(first(get("description"), get("summary")), 1, DESCRIPTION_CHARS)),
        salary_min_usd=F.when(ok, lo), salary_max_usd=F.when(ok, hi), salary_source=F.when(ok, "listed"), _discovery_channel=F.lit("Web3.career"),
    )


def web3_html(rows: DataFrame) -> DataFrame:
    """Table rows with a job id and at least five cells: title, company, age, location, pay; the link is in the click handler."""
    r = rows.withColumn("tr", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<tr[^>]*data-jobid[^>]*>.*?</tr>"), F.lit(0))))
    r = r.withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))).filter(F.size("cells") >= 5)
    cell = lambda k: T.strip_html(F.get("cells", F.lit(k)))
    link = F.regexp_extract("tr", r"tableTurboRowClick\(event,\s*['\"]([^'\"]+)['\"]\)", 1)
    whole = F.when(link.startswith("/"), F.concat(F.regexp_extract("url", r"^https?://[^/]+", 0), link)).otherwise(T.or_null(link))
    pay = T.salary_range(cell(4))
    return _raw(r, ("_discovery_channel",), title=cell(0), company=F.coalesce(T.or_null(cell(1)), F.lit("Unknown")), location=T.or_null(cell(3)), apply_url=F.coalesce(whole, F.col("url")), salary_min_usd=pay["lo"], salary_max_usd=pay["hi"], salary_source=F.when(pay.isNotNull(), "listed"), _discovery_channel=F.lit("Web3.career"))


# Words that a feed's items are kept for.
WEB3_WORDS = (
    r"(?i)\b(blockchain|crypto|web3|defi|dao|nft|token|ethereum|solana|bitcoin|l2|layer[\s\-]?2|evm|smart[\s\-]?contract|stablecoin|on[\s\-]?chain|"
    r"rollup|zk|zero[\s\-]?knowledge|dex|cefi|wallet|polkadot|cosmos|metaverse|gamefi|depin|rwa)\b"
)
FUNCTION_WORDS = (
    r"(?i)\b(community|growth|marketing|content|brand|social\s*media|partnerships?|ecosystem|devrel|developer\s*relations|developer\s*advocate|"
    r"developer\s*marketing|business\s*development|biz\s*dev|bizdev|ambassador|evangelis[tm]|advocacy|campaign|lifecycle|demand\s*gen|copywriter|"
    r"editorial|comms|communications)\b"
)


def weworkremotely(rows: DataFrame, function_words: str = FUNCTION_WORDS, default_words: str = WEB3_WORDS) -> DataFrame:
    """Items of the feed; rows have a column mode: function, or the default domain words."""
    from ..operators.clean import relevant

    r = _items(rows, "title:string,link:string,description:string,category:string,type:string,region:string,country:string,skills:string")
    j = F.col("j")
    title = T.strip(j["title"])
    hay = F.concat_ws(" ", T.or_empty(title), T.or_empty(T.strip(j["category"])), T.or_empty(T.strip(j["skills"])), F.substring(T.or_empty(j["description"]), 1, 2000))
    kept = r.filter((T.or_empty(title) != "") & (T.or_empty(T.strip(j["link"])) != "") & relevant(F.col("mode"), hay, function_words, default_words))
    two = title.contains(":")
    return _raw(
        kept, ("_job_type",), title=F.when(two, T.strip(F.substr(title, F.instr(title, ":") + 1))).otherwise(title),
        company=F.coalesce(T.or_null(F.when(two, T.strip(F.substring_index(title, ":", 1)))), F.lit("We Work Remotely")),
        location=F.coalesce(first(T.strip(j["region"]), T.strip(j["country"])), F.lit("Remote")), apply_url=T.strip(j["link"]),
        description=T.or_null(F.substring(T.strip_html_unescaped(j["description"]), 1, DESCRIPTION_CHARS)), _job_type=T.or_null(T.strip(j["type"])),
    )


def getonbrd(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with the names of companies (id, name); unknown ones are 'Unknown'. Monthly pay becomes annual."""
    attrs = "struct<title:string,description:string,remote:boolean,countries:array<string>,min_salary:int,max_salary:int,company:struct<data:struct<id:string>>>"
    r = _each(rows, f"data array<struct<attributes:{attrs},links:struct<public_url:string>>>", lambda b: b.data)
    named = companies.select(F.col("id").cast("string").alias("_cid"), F.col("name").alias("_name"))
    r = r.join(named, F.col("j.attributes.company.data.id") == F.col("_cid"), "left")
    a = F.col("j.attributes")
    list_ = F.array_join(F.slice(F.coalesce(a["countries"], F.array().cast("array<string>")), 1, 3), ", ")
    afar = F.when((list_ != "") & ~((F.size(a["countries"]) == 1) & (list_ == "Remote")), F.concat(F.lit("Remote — "), list_)).otherwise("Remote")
    pay = T.annualized(a["min_salary"], a["max_salary"])
    out = _raw(
        r, title=T.strip(a["title"]), company=F.coalesce(T.or_null(T.strip(F.col("_name"))), F.lit("Unknown")),
        location=F.when(F.coalesce(a["remote"], F.lit(False)), afar).otherwise(T.or_null(list_)),
        description=T.or_null(T.strip_html(a["description"])), apply_url=T.or_null(F.col("j.links.public_url")),
        salary_min_usd=pay["lo"], salary_max_usd=pay["hi"], salary_source=F.when((F.coalesce(pay["lo"], F.lit(0)) != 0) | (F.coalesce(pay["hi"], F.lit(0)) != 0), "listed"),
    )
    return out.filter("apply_url IS NOT NULL")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- links of plain pages -------------------------------------------------------------------------------------------

# Parts of a link that tell a job.
JOB_SIGNALS = (
    "/job/", "/jobs/", "/position/", "/role/", "/opening/", "/career/", "/careers/", "/vacancy/", "/apply/", "greenhouse.io/", "lever.co/",
    "ashbyhq.com/", "myworkdayjobs.com/", "breezy.hr/", "smartrecruiters.com/", "workable.com/", "recruitee.com/",
)
LINKS_PER_SOURCE = 50
PLACE_NEAR = r"(?i)remote|on[\s\-]?site|hybrid|buenos aires|latam|americas|global"
NOTE_NEAR = r"""(?is)<(p|span|div)\b[^>]*class=["'][^"']*(?:desc|summary|subtitle|location)[^"']*["'][^>]*>(.*?)</\1>"""
#: Where a link's tag begins, and its address in the rest of that tag.
ANCHOR, HREF = r"(?i)<a(?=\s)", r"""(?i)^[^>]*?\shref=["']([^"']*)["']"""


def joined_url(base: Column, href: Column) -> Column:
    """A link of a page as a whole URL, by RFC 3986: with a scheme, with a host, from the root, from the page's folder, or
    only a query or a fragment; dot segments are resolved."""
    part = lambda k: F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    none = F.array().cast("array<string>")

    def resolved_path(p: Column) -> Column:
        add = lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
        of = lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise(""))
        return T.once(F.aggregate(F.slice(F.split(p, "/"), 2, F.size(F.split(p, "/"))), none, add), of)

    def whole(b: Column) -> Column:
        path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
        folder = F.coalesce(T.or_null(F.regexp_extract(b["path"], "^(.*/)", 1)), F.lit("/"))
        at = T.once(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(folder, p)))
        return (
            F.when(href.startswith("http") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(b["scheme"], href))
            .when(href == "", base)
            .when(href.startswith("?"), F.concat(b["scheme"], F.lit("//"), b["host"], b["path"], href))
            .when(href.startswith("#"), F.concat(b["scheme"], F.lit("//"), b["host"], b["path"], b["query"], href))
            .otherwise(F.concat(b["scheme"], F.lit("//"), b["host"], T.once(at, resolved_path), tail))
        )

    return T.once(F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), part(4).alias("query")), whole)


def harvested(pages: DataFrame, signals: tuple[str, ...] = JOB_SIGNALS, title_ok: Callable[[Column], Column] | None = None, most: int = LINKS_PER_SOURCE) -> DataFrame:
    """Links of pages (source, url, final_url, body) that look like jobs: source, url, title, apply_url, location,
    description, pos.

    A page that was sent to its site's front page gives none. Titles are cleaned; of equal ones in a page, without regard
    to case, the first stays; at most so many of a page are kept, as its source's limit. A link without an end tag ends
    where the next one begins. What stands between a link's
    neighbours is near it: the first text there that names a place is the location, in 120 characters, and the first
    element that is marked as a description is the description, in 500.
    """
    from pyspark.sql import Window

    from ..operators.clean import looks_like_title

    path = lambda c: F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1)
    home = F.coalesce(path(F.col("final_url")).isin("", "/") & ~path(F.col("url")).isin("", "/"), F.lit(False))
    # A piece begins inside a link's tag, and what follows its end tag is near it and near the next link.
    end = lambda piece: F.instr(F.lower(piece), "</a")
    upto = lambda piece: F.when(end(piece) > 0, F.substr(piece, F.lit(1), end(piece) - 1)).otherwise(piece)
    after = lambda piece: F.when(end(piece) > 0, F.substr(piece, end(piece))).otherwise("")
    wanted = "|".join(re.escape(x) for x in signals)

    def links(pieces: Column) -> Column:
        numbered = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p, k: F.struct(p.alias("piece"), k.alias("pos"), F.regexp_extract(p, HREF, 1).alias("href")))
        jobs = F.filter(numbered, lambda x: F.lower(x["href"]).rlike(wanted))
        before = lambda k: F.when(k == 0, F.get(pieces, k)).otherwise(after(F.get(pieces, k)))
        titled = F.transform(jobs, lambda x: F.struct(x["pos"], x["href"], T.clean_title(T.strip_html(F.concat(F.lit("<a"), upto(x["piece"])))).alias("title"), F.concat(before(x["pos"]), F.lit("<a"), x["piece"]).alias("near")))
        return F.filter(titled, lambda x: (title_ok or looks_like_title)(x["title"]))

    r = pages.filter(~home).select("source", "url", F.explode(T.once(F.split("body", ANCHOR, -1), links)).alias("v")).select("source", "url", "v.*")
    texts = F.filter(F.transform(F.split("near", "<[^>]*>"), T.strip), lambda t: t.rlike(PLACE_NEAR))
    note = F.substring(T.or_null(T.strip_html(F.regexp_extract("near", NOTE_NEAR, 2))), 1, 500)
    r = r.select("source", "url", "pos", "title", joined_url(F.col("url"), F.col("href")).alias("apply_url"), F.substring(F.try_element_at(texts, F.lit(1)), 1, 120).alias("location"), note.alias("description"))
    one = F.row_number().over(Window.partitionBy("source", "url", F.lower("title")).orderBy("pos"))
    r = r.withColumn("_n", one).filter("_n = 1")
    return r.withColumn("_k", F.row_number().over(Window.partitionBy("source", "url").orderBy("pos"))).filter(F.col("_k") <= most).select("source", "url", "title", "apply_url", "location", "description", "pos")


# --- routing --------------------------------------------------------------------------------------------------------

NAME = r"[a-zA-Z0-9\-_]+"
# Pages of the bare domain that are no boards.
LEVER_PAGES = (
    "about|blog|customers|pricing|login|contact|careers|platform|product|resources|company|legal|privacy|terms|demo|plans|index|home|features|"
    "integrations|security|partners|press|events|support|help|status|api|developers|docs|solutions|customer-stories|request-demo"
)
GREENHOUSE_FORMS = (
    rf"(?i)https?://(?:job-)?boards(?:-api)?\.greenhouse\.io/({NAME})",
    rf"(?i)https?://jobs\.greenhouse\.io/({NAME})",
    rf"(?i)https?://({NAME})\.greenhouse\.io",
    rf"(?i)https?://(?:job-)?boards(?:-api)?\.eu\.greenhouse\.io/({NAME})",
)
LEVER_FORMS = (
    rf"(?i)https?://jobs\.lever\.co/({NAME})",
    rf"(?i)https?://(?:www\.)?lever\.co/(?!(?:{LEVER_PAGES})(?:[/?#]|$))({NAME})",
    rf"(?i)https?://(?!www\.)({NAME})\.lever\.co",
)
ASHBY_FORM = r"(?i)https?://(?:jobs\.)?ashbyhq\.com/([a-z0-9\-_]+)"
WORKDAY_FORM = r"https?://([a-z0-9\-]+)\.wd(\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([a-zA-Z0-9\-_]+)"
BAMBOO_FORM = r"(?i)https?://([a-z0-9\-]+)\.bamboohr\.com"
TEAMTAILOR_FORM = r"(?i)https?://([a-z0-9\-]+)\.teamtailor\.com"
WORKABLE_FORM = r"(?i)https?://apply\.workable\.com/(?!j/)([a-z0-9][a-z0-9\-_]*)"
GETONBRD_FORM = r"(?i)getonbrd\.com"


def _slug(url: Column, forms: tuple[str, ...]) -> Column:
    return F.coalesce(*[T.or_null(F.regexp_extract(T.or_empty(url), f, 1)) for f in forms])


def greenhouse_slug(url: Column) -> Column:
    return _slug(url, GREENHOUSE_FORMS)


def greenhouse_is_eu(url: Column) -> Column:
    """Whether the board is on the European host: only that form of link fits."""
    return F.coalesce(_slug(url, GREENHOUSE_FORMS[:3]).isNull() & _slug(url, GREENHOUSE_FORMS[3:]).isNotNull(), F.lit(False))


def lever_slug(url: Column) -> Column:
    return F.coalesce(*[T.or_null(F.regexp_extract(T.or_empty(url), f, 1)) for f in LEVER_FORMS])


def workday_slug(url: Column) -> Column:
    part = lambda k: T.or_null(F.regexp_extract(T.or_empty(url), WORKDAY_FORM, k))
    return F.struct(part(1).alias("tenant"), part(2).alias("wd"), part(3).alias("site"))


def board_slug(url: Column, ashby_name: Column | None = None, workable_name: Column | None = None) -> Column:
    """Slugs by format; a name that the catalog gives wins for two of them."""
    given = lambda name, other: F.coalesce(T.or_null(F.lower(T.strip(name))), other) if name is not None else other
    return F.struct(
        greenhouse_slug(url).alias("greenhouse"), lever_slug(url).alias("lever"), given(ashby_name, _slug(url, (ASHBY_FORM,))).alias("ashby"),
        workday_slug(url)["tenant"].alias("workday"), _slug(url, (BAMBOO_FORM,)).alias("bamboohr"), _slug(url, (TEAMTAILOR_FORM,)).alias("teamtailor"),
        given(workable_name, F.lower(_slug(url, (WORKABLE_FORM,)))).alias("workable"),
    )


def parser(url: Column, ashby_name: Column | None = None, workable_name: Column | None = None) -> Column:
    """The format of a source, the first that fits; null without a url."""
    s = board_slug(url, ashby_name, workable_name)
    chain = F.when(s["greenhouse"].isNotNull(), "greenhouse")
    for name in ("lever", "ashby", "workday", "bamboohr", "teamtailor", "workable"):
        chain = chain.when(s[name].isNotNull(), name)
    low = F.lower(T.or_empty(url))
    for name, host in (("cryptojobslist", "cryptojobslist.com"), ("web3career", "web3.career"), ("weworkremotely", "weworkremotely.com"), ("getonbrd", "getonbrd.com")):
        chain = chain.when(low.contains(host), name)
    return chain.when(low != "", "generic")


def catalog(rows: DataFrame, group_of: dict[str, int]) -> DataFrame:
    """Flat sources of a nested catalog (groups: map of name to a struct with a list of sources), with their super-group."""
    from ..operators.clean import is_feed

    flat = rows.select(F.explode("groups").alias("v2_group", "g")).select("v2_group", F.explode("g.sources").alias("s")).select("v2_group", "s.*")
    number = F.create_map(*[F.lit(x) for kv in group_of.items() for x in kv])
    return flat.withColumn("super_group", F.try_element_at(number, F.col("v2_group"))).filter(F.col("super_group").isNotNull() & ~is_feed(F.col("category"), F.col("name")))


CATALOG = "groups map<string,struct<sources:array<struct<name:string,url:string,category:string>>>>, metadata struct<cjl_boost_companies:array<string>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogs in files, one JSON object a file over several lines: groups and metadata, with the file. A file that isn't
    one fails with its name, as a run without its sources would look like one in which all of them had gone."""
    raw = spark.read.schema(f"{CATALOG}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.select("groups", "metadata", "_corrupt", F.col("_metadata.file_path").alias("file"))
    wrong = F.col("_corrupt").isNotNull() | F.col("groups").isNull()
    said = F.raise_error(F.concat(F.lit("not a catalog: "), F.col("file")))
    return rows.withColumn("groups", F.when(wrong, said.cast(raw.schema["groups"].dataType)).otherwise(F.col("groups"))).drop("_corrupt")


def boost_list(catalogs: DataFrame) -> DataFrame:
    """company: the names that catalogs boost."""
    return catalogs.select(F.explode("metadata.cjl_boost_companies").alias("company")).distinct()


# --- crawled pages --------------------------------------------------------------------------------------------------

# What tells a hosting product in a page, the first match of each.
SIGNATURES = {
    "greenhouse": r"(?i)boards\.greenhouse\.io/(?:embed/)?[a-z0-9_-]+|boards-api\.greenhouse\.io|job-board\.greenhouse\.io/[a-z0-9_-]+",
    "lever": r"(?i)jobs\.lever\.co/[a-z0-9_-]+|api\.lever\.co/v0/postings/[a-z0-9_-]+",
    "ashby": r"(?i)jobs\.ashbyhq\.com/[a-z0-9_-]+|api\.ashbyhq\.com/posting-api",
    "workable": r"(?i)apply\.workable\.com/[a-z0-9_-]+",
    "workday": r"(?i)[a-z0-9_-]+\.wd[0-9]+\.myworkdayjobs\.com",
    "bamboohr": r"(?i)[a-z0-9_-]+\.bamboohr\.com/careers",
    "teamtailor": r"(?i)[a-z0-9_-]+\.teamtailor\.com",
    "smartrecruiters": r"(?i)smartrecruiters\.com/[A-Za-z0-9_-]+",
    "jazzhr": r"(?i)[a-z0-9_-]+\.applytojob\.com",
    "recruitee": r"(?i)[a-z0-9_-]+\.recruitee\.com",
    "personio": r"(?i)[a-z0-9_-]+\.jobs\.personio\.(?:com|de)",
    "notion": r"(?i)notion\.site/[a-z0-9-]+|[a-z0-9_-]+\.notion\.site",
    "pinpoint": r"(?i)app\.pinpointhq\.com|[a-z0-9_-]+\.pinpointhq\.com",
    "breezy": r"(?i)[a-z0-9_-]+\.breezy\.hr",
    "wellfound": r"(?i)wellfound\.com/jobs|angel\.co/",
}


def fingerprints(pages: DataFrame, signatures: dict[str, str] | None = None) -> DataFrame:
    """For each company of pages (company, url, body): name and samples (url -> match) of each product it shows."""
    sigs = signatures or SIGNATURES
    each = F.array(*[F.struct(F.lit(n).alias("product"), F.substring(F.regexp_extract("body", p, 0), 1, 80).alias("sample")) for n, p in sigs.items()])
    hits = pages.select("company", "url", F.explode(F.filter(each, lambda s: s.sample != "")).alias("s")).select("company", "url", "s.*")
    return hits.groupBy("company", "product").agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", "url", "sample"))).alias("samples"))


#: Products whose boards can't be read.
NOT_ACTIONABLE = ("notion", "wellfound")


def probed(pages: DataFrame, signatures: dict[str, str] | None = None) -> DataFrame:
    """One row for each company of pages (company, url, status, body): fetched_ok, and hits, a map of each product it shows
    to the samples of its pages in the order of their urls.

    Pages that failed (no status, or 400 and above) show nothing; a company without any hit has an empty map.
    """
    ok = pages.filter(F.coalesce(F.col("status") < 400, F.lit(False)))
    companies = pages.groupBy("company").agg(F.coalesce(F.max(F.col("status") < 400), F.lit(False)).alias("fetched_ok"))
    hits = fingerprints(ok, signatures).groupBy("company").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product", "samples")))).alias("hits"))
    none = F.create_map().cast("map<string,array<string>>")
    return companies.join(hits, companies.company.eqNullSafe(hits.company), "left").select(companies.company, "fetched_ok", F.coalesce("hits", none).alias("hits"))


def actionable(companies: DataFrame, without: tuple[str, ...] = NOT_ACTIONABLE) -> DataFrame:
    """What can be acted on of probed(): company, product and the first sample, but for products that can't be read."""
    left = F.map_filter("hits", lambda product, samples: ~product.isin(*without))
    return companies.select("company", F.explode(left).alias("product", "samples")).select("company", "product", F.get("samples", F.lit(0)).alias("sample"))


SUFFIXES = ("-labs", "labs", "-foundation", "foundation", "-network", "network", "-finance", "finance", "-protocol", "protocol", "-xyz", "-io", "-inc")


def slug_variants(name: Column) -> Column:
    """Candidate slugs of a company, likely ones first."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(T.strip(F.lower(name)), r"[.\s]+", "-"), "-+", "-"), "^-+|-+$", "")
    more = [F.concat(base, F.lit(form)) for s in SUFFIXES for form in dict.fromkeys((s.replace("-", ""), s))]
    return F.filter(F.array_distinct(F.array(base, *more, F.replace(base, F.lit("-"), F.lit("")))), lambda v: v != "")


def resolved(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """The first candidate of each company (name) that boards (slug, ats) has; companies without one have nulls."""
    tries = companies.select("name", F.posexplode(slug_variants(F.col("name"))).alias("rank", "slug"))
    hit = tries.join(boards, "slug").groupBy("name").agg(F.min_by(F.struct("slug", "ats"), F.struct("rank", "ats")).alias("b"))
    return companies.select("name").join(hit, "name", "left").select("name", "b.slug", "b.ats")
