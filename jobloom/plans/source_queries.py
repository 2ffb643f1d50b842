"""Queries of payload readers, routing, crawled pages and model responses. Payloads are built from the given tables, so
what a reader should find is known."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, enrich
from ..sources import payloads as P
from . import bindings as B
from . import sql as S
from .registry import query
from .state_queries import shared_folder

BOARD = "https://boards.greenhouse.io/acme"
LINE = "split_part(text, chr(10), 1)"
TITLE = S.strip(LINE)


def _docs(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "n_chars", F.col("source").alias("firm"), F.substring_index("text", "\n", 1).alias("line"), F.col("text"))


def _wrapped(rows, body, url: str, page=None):
    return rows.select(F.col("firm").alias("source"), F.lit(url).alias("url"), F.lit("Board").alias("category"), (page if page is not None else F.lit(0)).alias("page"), body.alias("body"))


def _json(*fields):
    return F.to_json(F.struct(*fields))


def _link(prefix: str):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"))


@query(f"SELECT source AS company, {TITLE} AS title, 'City ' || (doc_id % 9) AS location, substr({S.strip_html('text')}, 1, 5000) AS description, CASE WHEN doc_id % 4 = 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || doc_id ELSE 'https://x/' || doc_id END AS apply_url FROM documents WHERE {TITLE} <> ''")
def s5_greenhouse(spark, sf_dir):
    job = F.struct(F.col("doc_id").alias("id"), F.col("line").alias("title"), F.struct(F.concat(F.lit("City "), (F.col("doc_id") % 9).cast("string")).alias("name")).alias("location"), F.when(F.col("doc_id") % 4 != 0, _link("https://x/")).alias("absolute_url"), F.col("text").alias("content"))
    raw = _wrapped(_docs(spark, sf_dir), _json(F.array(job).alias("jobs")), BOARD)
    return P.greenhouse(raw).select("company", "title", "location", "description", "apply_url")


@query(f"SELECT source AS company, {TITLE} AS title, 'https://jobs.lever.co/x/' || doc_id AS apply_url, CASE WHEN doc_id % 3 <> 1 THEN CAST(40000 + doc_id AS INT) END AS salary_min_usd, CASE WHEN doc_id % 3 <> 1 THEN 'listed' END AS salary_source, {S.capped('text')} AS description FROM documents WHERE {TITLE} <> ''")
def s6_lever(spark, sf_dir):
    i = F.col("doc_id")
    pay = F.struct((40000 + i).cast("double").alias("min"), (50000 + i).cast("double").alias("max"), F.when(i % 3 == 0, "usd").when(i % 3 == 1, "GBP").alias("currency"))
    post = F.struct(F.col("line").alias("text"), F.struct(F.col("lang").alias("location")).alias("categories"), _link("https://jobs.lever.co/x/").alias("hostedUrl"), F.col("text").alias("descriptionPlain"), pay.alias("salaryRange"))
    raw = _wrapped(_docs(spark, sf_dir), F.to_json(F.array(post)), "https://jobs.lever.co/x")
    return P.lever(raw).select("company", "title", "apply_url", "salary_min_usd", "salary_source", "description")


@query(f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'Org ' || doc_id % 7 ELSE source END AS company, {TITLE} AS title, CAST(60000 + doc_id AS INT) AS salary_min_usd, CAST(90000 + doc_id AS INT) AS salary_max_usd, CASE WHEN doc_id % 2 = 0 THEN {S.capped(S.tags_gone("'<p>' || text"))} ELSE {S.capped(S.strip_html_if_markup('text'))} END AS description FROM documents WHERE {TITLE} <> ''")
def s7_ashby(spark, sf_dir):
    i = F.col("doc_id")
    tier = lambda cur, lo: F.struct(F.lit(cur).alias("currencyCode"), lo.cast("double").alias("minValue"), (lo + 30000).cast("double").alias("maxValue"))
    org = F.when(i % 2 == 0, F.struct(F.concat(F.lit("Org "), (i % 7).cast("string")).alias("name")))
    job = F.struct(F.col("line").alias("title"), _link("https://jobs.ashbyhq.com/x/").alias("jobUrl"), F.when(i % 2 != 0, F.col("text")).alias("descriptionPlain"), F.concat(F.lit("<p>"), "text").alias("descriptionHtml"), org.alias("organization"), F.array(tier("EUR", i), tier("None", i + 60000)).alias("compensationTiers"))
    raw = _wrapped(_docs(spark, sf_dir), _json(F.array(job).alias("jobs")), "https://jobs.ashbyhq.com/x")
    return P.ashby(raw).select("company", "title", "salary_min_usd", "salary_max_usd", "description")


@query(f"SELECT {TITLE} AS title, 'https://acme.wd5.myworkdayjobs.com/Careers/job/' || doc_id AS apply_url, lang AS location FROM documents WHERE doc_id % 7 < 5 AND {TITLE} <> ''")
def s8_workday(spark, sf_dir):
    post = F.struct(F.col("line").alias("title"), _link("/job/").alias("externalPath"), F.col("lang").alias("locationsText"))
    raw = _wrapped(_docs(spark, sf_dir), _json(F.array(post).alias("jobPostings")), "https://acme.wd5.myworkdayjobs.com/en-US/Careers", F.col("doc_id") % 7)
    return P.workday(raw).select("title", "apply_url", "location")


@query(f"SELECT {TITLE} AS title, CASE WHEN doc_id % 3 <> 0 THEN 'City ' || doc_id % 5 END AS location, CASE WHEN doc_id % 3 <> 0 THEN 'https://share/' || doc_id ELSE 'https://acme.bamboohr.com/careers/' || doc_id END AS apply_url, CASE WHEN doc_id % 3 <> 0 THEN {S.capped(S.tags_gone('text'))} END AS description FROM documents WHERE {TITLE} <> ''")
def s9_bamboohr(spark, sf_dir):
    d = _docs(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    lists = _wrapped(d, _json(F.array(F.struct(i.alias("id"), F.col("line").alias("jobOpeningName"))).alias("result")), "https://acme.bamboohr.com/careers/list")
    place = F.struct(F.concat(F.lit("City "), (F.col("doc_id") % 5).cast("string")).alias("name"))
    opening = F.struct(F.struct(F.col("line").alias("jobOpeningName"), F.col("text").alias("description"), _link("https://share/").alias("jobOpeningShareUrl"), place.alias("location")).alias("jobOpening"))
    details = d.select(F.col("firm").alias("source"), i.alias("job_id"), F.when(F.col("doc_id") % 3 != 0, _json(opening.alias("result"))).otherwise("not found").alias("body"))
    return P.bamboohr(lists, details).select("title", "location", "apply_url", "description")


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, c):
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


@query(f"SELECT source AS company, {TITLE} AS title, 'https://acme.teamtailor.com/jobs/' || doc_id AS apply_url, {S.capped(S.tags_gone('text'))} AS description FROM documents WHERE {TITLE} <> ''")
def s10_teamtailor_rss(spark, sf_dir):
    item = _tag("item", F.concat(_tag("title", _xml(F.col("line"))), _tag("link", _link("https://acme.teamtailor.com/jobs/")), _tag("description", _xml(F.col("text")))))
    raw = _wrapped(_docs(spark, sf_dir), _tag("rss", _tag("channel", item)), "https://acme.teamtailor.com")
    return P.teamtailor(raw).select("company", "title", "apply_url", "description")


@query(f"SELECT 'Account' AS company, {TITLE} AS title, CASE WHEN doc_id % 2 = 0 THEN 'Remote — ' ELSE '' END || 'Rome, Italy' AS location, CASE WHEN doc_id % 3 = 0 THEN 'https://apply.workable.com/j/c' || doc_id || '/' ELSE 'https://w/' || doc_id END AS apply_url, {S.capped(S.strip_html_if_markup('text'))} AS description FROM documents WHERE {TITLE} <> ''")
def s11_workable(spark, sf_dir):
    i = F.col("doc_id")
    job = F.struct(F.col("line").alias("title"), F.when(i % 3 != 0, _link("https://w/")).alias("url"), _link("c").alias("shortcode"), F.col("text").alias("description"), F.lit("Rome").alias("city"), F.lit("Italy").alias("country"), (i % 2 == 0).alias("telecommuting"))
    raw = _wrapped(_docs(spark, sf_dir), _json(F.lit("Account").alias("name"), F.array(job).alias("jobs")), "https://apply.workable.com/acme")
    return P.workable(raw).select("company", "title", "location", "apply_url", "description")


@query(f"SELECT source AS company, {TITLE} AS title, 'https://cryptojobslist.com/jobs/s' || doc_id AS apply_url, CASE WHEN doc_id % 2 = 0 THEN 'Remote' ELSE 'Lisbon' END AS location, {S.capped("replace(text, ' ', ', ')", 500)} AS description FROM documents WHERE doc_id % 10 <> 0 AND {TITLE} <> ''")
def s12_cryptojobslist(spark, sf_dir):
    i = F.col("doc_id")
    job = F.struct(F.col("line").alias("jobTitle"), F.col("firm").alias("company_name"), _link("s").alias("seoSlug"), F.when(i % 2 != 0, F.struct(F.lit("Lisbon").alias("city"))).alias("jobLocation"), F.lit(True).alias("remote"), F.split("text", " ").alias("tags"), F.when(i % 10 == 0, False).alias("is_active"))
    jobs = F.array(job)
    blob = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), _json(F.struct(F.struct(jobs.alias("jobs")).alias("pageProps")).alias("props")), F.lit("</script></html>"))
    # A text that closes a script would end the blob early, so the slash is escaped as pages do.
    body = F.when(i % 4 == 0, F.to_json(jobs)).when(i % 4 == 1, _json(jobs.alias("jobs"))).when(i % 4 == 2, _json(jobs.alias("data"))).otherwise(blob)
    raw = _wrapped(_docs(spark, sf_dir), body, "https://cryptojobslist.com/feed")
    return P.cryptojobslist(raw).select("company", "title", "apply_url", "location", "description")


@query(f"SELECT source AS company, {TITLE} AS title, CAST(CASE doc_id % 3 WHEN 0 THEN 50000 WHEN 1 THEN 60000 + doc_id ELSE 70000 END AS INT) AS salary_min_usd, {S.capped(S.strip('text'))} AS description FROM documents WHERE {TITLE} <> ''")
def s13_web3_api(spark, sf_dir):
    i = F.col("doc_id")
    base = lambda *pay: F.to_json(F.struct(F.col("line").alias("title"), F.col("firm").alias("company"), _link("https://web3.career/").alias("apply_url"), F.col("text").alias("description"), *pay))
    job = F.when(i % 3 == 0, base(F.lit("$50k - $80k").alias("salary"))).when(i % 3 == 1, base(F.struct((60000 + i).alias("min"), F.lit(999999).alias("max")).alias("salary"))).otherwise(base(F.lit(70000).alias("salary_min"), F.lit(80000).alias("salary_max")))
    body = F.concat(F.lit('["meta", {"page": 1}, ['), job, F.lit("]]"))
    return P.web3_api(_wrapped(_docs(spark, sf_dir), body, "https://web3.career/api/v1")).select("company", "title", "salary_min_usd", "description")


CELLED = S.collapsed(LINE)


@query(f"SELECT source AS company, {CELLED} AS title, 'https://web3.career/j/' || doc_id AS apply_url, 60000 AS salary_min_usd FROM documents WHERE {CELLED} <> ''")
def s14_web3_html(spark, sf_dir):
    cell = lambda c: _tag("td", c)
    link = F.concat(F.lit("tableTurboRowClick(event, '/j/"), F.col("doc_id").cast("string"), F.lit("')"))
    row = F.concat(F.lit('<tr data-jobid="1" onclick="'), link, F.lit('">'), cell(_xml(F.col("line"))), cell(F.col("firm")), cell(F.lit("2d")), cell(F.col("lang")), cell(F.lit("$60k - $90k")), cell(_xml(F.col("text"))), F.lit("</tr>"))
    raw = _wrapped(_docs(spark, sf_dir), F.concat(F.lit("<table>"), row, F.lit("</table>")), "https://web3.career/jobs")
    return P.web3_html(raw).select("company", "title", "apply_url", "salary_min_usd")


@query(f"SELECT source AS company, {TITLE} AS title, CASE doc_id % 3 WHEN 0 THEN 'Europe' WHEN 1 THEN 'Peru' ELSE 'Remote' END AS location, {S.capped(S.strip_html_unescaped('text'))} AS description FROM documents WHERE CASE WHEN doc_id % 2 = 0 THEN true ELSE source IN ('src1', 'src3') END AND {TITLE} <> ''")
def s15_wwr_rss(spark, sf_dir):
    i = F.col("doc_id")
    item = F.concat(_tag("title", F.concat(F.col("firm"), F.lit(": "), _xml(F.col("line")))), _tag("link", _link("https://weworkremotely.com/")), _tag("description", _xml(F.col("text"))), F.when(i % 3 == 0, "<region>Europe</region>").when(i % 3 == 1, "<country>Peru</country>").otherwise(""))
    raw = _wrapped(_docs(spark, sf_dir), _tag("rss", _tag("channel", _tag("item", item))), "https://weworkremotely.com/x").withColumn("mode", F.when(F.substring_index(F.regexp_extract("body", r"weworkremotely.com/(\d+)", 1), ".", 1).cast("long") % 2 == 0, "function").otherwise("default"))
    return P.weworkremotely(raw, r"src\d", r"src[13]:").select("company", "title", "location", "description")


@query(f"SELECT coalesce(s_name, 'Unknown') AS company, {TITLE} AS title, CASE WHEN doc_id % 2 = 0 THEN 'Remote — Chile, Peru' ELSE 'Chile, Peru' END AS location, CAST(CASE WHEN doc_id % 8000 <= 10000 THEN doc_id % 8000 * 12 ELSE doc_id % 8000 END AS INT) AS salary_max_usd, nullif({S.strip_html('text')}, '') AS description FROM documents LEFT JOIN supplier ON s_suppkey = doc_id % 150 WHERE {TITLE} <> ''")
def s16_getonbrd(spark, sf_dir):
    i = F.col("doc_id")
    attrs = F.struct(F.col("line").alias("title"), F.col("text").alias("description"), (i % 2 == 0).alias("remote"), F.array(F.lit("Chile"), F.lit("Peru")).alias("countries"), (i % 8000).alias("max_salary"), F.struct(F.struct((i % 150).cast("string").alias("id")).alias("data")).alias("company"))
    body = _json(F.array(F.struct(attrs.alias("attributes"), F.struct(_link("https://www.getonbrd.com/").alias("public_url")).alias("links"))).alias("data"))
    companies = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return P.getonbrd(_wrapped(_docs(spark, sf_dir), body, "https://www.getonbrd.com/api"), companies).select("company", "title", "location", "salary_max_usd", "description")


#: Links that are put after each page's own html: text, href, what they become on a page of https://{host}/careers/list?x=1.
LINKS = (
    ("Growth Manager {n}", "https://jobs.lever.co/acme/{n}", "https://jobs.lever.co/acme/{n}"),
    ("Content Lead {n} (Remote)", "/jobs/{n}?a=b", "https://{host}/jobs/{n}?a=b"),
    ("Data Engineer {n} Full-Time", "apply/position/{n}#top", "https://{host}/careers/apply/position/{n}#top"),
    ("Sales Director {n}", "../role/./{n}/", "https://{host}/role/{n}/"),
    ("Legal Counsel {n}", "//careers.example.com/job/{n}", "https://careers.example.com/job/{n}"),
    ("Product Designer {n}", "?from=/jobs/&id={n}", "https://{host}/careers/list?from=/jobs/&id={n}"),
    ("GROWTH MANAGER {n}", "/jobs/twice/{n}", None),
    ("Read more about Engineer {n}", "/jobs/more/{n}", None),
    ("Careers", "/careers/", None),
    ("Community Manager {n}", "/blog/{n}", None),
)
CLEANED = ("Growth Manager {n}", "Content Lead {n}", "Data Engineer {n}", "Sales Director {n}", "Legal Counsel {n}", "Product Designer {n}")
NEAR = ("On-site, {lang}", "Hybrid in Latam")


def _found(k: int) -> str:
    """SQL of the row that the k-th link gives."""
    text = lambda t: S.lit(t).replace("{n}", "' || page_id || '").replace("{host}", "' || host || '")
    place = S.lit(f"Place {k}: remote") if k % 2 else "NULL"
    note = S.lit(f"About & no. {k}") if k % 3 == 0 else "NULL"
    return f"SELECT page_id, {text(CLEANED[k])} AS title, {text(LINKS[k][2])} AS apply_url, {place} AS location, {note} AS description FROM p"


@query("WITH p AS (SELECT page_id, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM pages WHERE page_id % 10 <> 0) " + " UNION ALL ".join(_found(k) for k in range(len(CLEANED))))
def s17_link_harvest(spark, sf_dir):
    """Each page's own links, none of which is a job, and then a list of links of all forms; every tenth page was sent to
    its site's front page."""
    n, host = F.col("page_id").cast("string"), F.regexp_extract("url", "//([^/?#]+)", 1)
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), n), F.lit("{host}"), host)
    row = lambda k, text, href: F.concat(
        F.lit("<li>"), F.lit(f"<i>Place {k}: remote</i>" if k % 2 else ""), F.lit(f'<p class="job-desc">About &amp; <b>no. {k}</b></p>' if k % 3 == 0 else ""), F.lit('<a class="x" href="'), filled(href), F.lit('">'), filled(text), F.lit('</a></li><a href="#">next</a>')
    )
    body = F.concat(F.col("html"), F.lit('<a href="#">start</a>'), *[row(k, text, href) for k, (text, href, _) in enumerate(LINKS)])
    url = F.concat(F.lit("https://"), host, F.lit("/careers/list?x=1"))
    final = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("https://"), host, F.lit("/"))).otherwise(url)
    pages = B.table(spark, sf_dir, "pages").select(n.alias("source"), url.alias("url"), final.alias("final_url"), body.alias("body"))
    return P.harvested(pages).select(F.col("source").cast("long").alias("page_id"), "title", "apply_url", "location", "description")


@query(f"SELECT source AS company, {TITLE} AS title, CAST(NULL AS VARCHAR) AS _job_type, {S.capped(S.strip_html('text'))} AS description FROM documents WHERE {TITLE} <> '' UNION ALL SELECT source, {TITLE}, 'listed', {S.capped('text')} FROM documents WHERE {TITLE} <> ''")
def s18_union_formats(spark, sf_dir):
    d = _docs(spark, sf_dir)
    green = P.greenhouse(_wrapped(d, _json(F.array(F.struct(F.col("line").alias("title"), F.col("text").alias("content"))).alias("jobs")), BOARD))
    lev = P.lever(_wrapped(d, F.to_json(F.array(F.struct(F.col("line").alias("text"), F.lit("https://h").alias("hostedUrl"), F.col("text").alias("descriptionPlain")))), "https://jobs.lever.co/x")).withColumn("_job_type", F.lit("listed"))
    return P.union(green, lev).select("company", "title", "_job_type", "description")


GROUPS = {"group_1": 1, "group_2": 1, "group_3": 1, "group_4": 2, "group_5": 2}


@query("SELECT 'group_' || (c_nationkey % 6 + 1) AS v2_group, c_name || s AS name, CASE WHEN c_nationkey % 6 < 3 THEN 1 ELSE 2 END AS super_group FROM customer, (SELECT unnest(['', ' Labs']) AS s) WHERE c_custkey % 6 <> 0 AND c_nationkey % 6 < 5")
def s1_source_catalog(spark, sf_dir):
    """A catalog for each customer: one group with two sources."""
    kind = F.when(F.col("c_custkey") % 6 == 0, "X_Feed").otherwise("Board").alias("category")
    source = lambda s: F.struct(F.concat(F.col("c_name"), F.lit(s)).alias("name"), kind)
    group = F.concat(F.lit("group_"), (F.col("c_nationkey") % 6 + 1).cast("string"))
    whole = B.table(spark, sf_dir, "customer").select(F.create_map(group, F.struct(F.array(source(""), source(" Labs")).alias("sources"))).alias("groups"))
    return P.catalog(whole, GROUPS).select("v2_group", "name", "super_group")


@query("SELECT 'group_' || (n_nationkey % 6 + 1) AS v2_group, c_name AS name, 'https://b/' || c_custkey AS url, CASE WHEN n_nationkey % 6 < 3 THEN 1 ELSE 2 END AS super_group FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 6 < 5 AND c_custkey % 6 <> 0 UNION ALL SELECT NULL, n_name, NULL, NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def s1_catalog_files(spark, sf_dir):
    """A catalog file for each nation, over several lines, written and read back: its customers as sources, and its name on
    the boost list."""
    kind = F.when(F.col("c_custkey") % 6 == 0, "X_Feed").otherwise("Board")
    source = F.struct(F.col("c_name").alias("name"), F.concat(F.lit("https://b/"), F.col("c_custkey").cast("string")).alias("url"), kind.alias("category"))
    c = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    each = c.groupBy("n_nationkey", "n_name").agg(F.collect_list(source).alias("sources"))
    group = F.concat(F.lit("group_"), (F.col("n_nationkey") % 6 + 1).cast("string"))
    body = F.to_json(F.struct(F.create_map(group, F.struct("sources")).alias("groups"), F.struct(F.array("n_name").alias("cjl_boost_companies")).alias("metadata")), {"pretty": "true"})
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex[:12]}"
    each.select("n_nationkey", body.alias("value")).write.partitionBy("n_nationkey").text(path)
    whole = P.read_catalog(spark, path)
    boosted = P.boost_list(whole).select(F.lit(None).cast("string").alias("v2_group"), F.col("company").alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("super_group"))
    return P.catalog(whole, GROUPS).select("v2_group", "name", "url", "super_group").unionByName(boosted)


FED = "CASE event_type WHEN 'error' THEN 'X_Feed' ELSE event_type END AS category, CASE WHEN user_id % 10 = 0 THEN 'X: @' || user_id ELSE 'u' || user_id END AS name"


@query(f"SELECT event_id FROM (SELECT event_id, {FED} FROM events) WHERE category <> 'X_Feed' AND NOT starts_with(lower(name), 'x: @')")
def s2_feed_exclusion(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").selectExpr("event_id", *FED.replace(" AS category, ", " AS category\n").split("\n"))
    return e.filter(~clean.is_feed(F.col("category"), F.col("name"))).select("event_id")


def _dealt(spark, sf_dir):
    """Customers dealt to all tasks: their file may be a single part, and what is done for a row of it takes long."""
    return B.table(spark, sf_dir, "customer").repartition("c_custkey")


FORMS = {
    "greenhouse": "https://boards.greenhouse.io/{s}", "lever": "https://jobs.lever.co/{s}", "ashby": "https://jobs.ashbyhq.com/{s}", "workday": "https://{s}.wd5.myworkdayjobs.com/en-US/Site",
    "bamboohr": "https://{s}.bamboohr.com/jobs", "teamtailor": "https://{s}.teamtailor.com", "workable": "https://apply.workable.com/{s}/", "cryptojobslist": "https://cryptojobslist.com/{s}",
    "web3career": "https://web3.career/{s}", "weworkremotely": "https://weworkremotely.com/{s}", "getonbrd": "https://www.getonbrd.com/{s}", "generic": "https://{s}.example.com",
}
FIRM_SLUG = "lower(replace(replace(c_name, '#', '-'), '_', '-'))"


@query("SELECT c_custkey AS id, f.name AS parser FROM customer, (SELECT unnest([" + ", ".join(f"{{'name': '{k}'}}" for k in FORMS) + "]) AS f)")
def s3_format_routing(spark, sf_dir):
    urls = F.array(*[F.replace(F.lit(u), F.lit("{s}"), F.expr(FIRM_SLUG)) for u in FORMS.values()])
    return _dealt(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.explode(urls).alias("u")).select("id", P.parser(F.col("u")).alias("parser"))


SLUGS = {
    "https://boards.greenhouse.io/{s}": "{s}", "https://boards.eu.greenhouse.io/{s}": "{s}", "https://boards-api.greenhouse.io/{s}/x": "{s}", "https://jobs.lever.co/{s}": "{s}",
    "https://lever.co/{s}-x": "{s}-x", "https://www.lever.co/pricing": None, "https://apply.workable.com/j/{s}": None, "https://apply.workable.com/{s}": "{s}", "https://{s}.teamtailor.com/jobs": "{s}",
}


def _filled(t: str | None) -> str:
    return "NULL" if t is None else "'" + t.replace("{s}", f"' || {FIRM_SLUG} || '") + "'"


@query("SELECT id, form, slug FROM (SELECT c_custkey AS id, unnest([" + ", ".join(f"{{'form': {k}, 'slug': {_filled(v)}}}" for k, v in enumerate(SLUGS.values())) + "], recursive := true) FROM customer)")
def s4_board_slug(spark, sf_dir):
    urls = F.array(*[F.struct(F.lit(k).alias("form"), F.replace(F.lit(u), F.lit("{s}"), F.expr(FIRM_SLUG)).alias("u")) for k, u in enumerate(SLUGS)])
    n = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(urls).alias("v")).select("id", "v.*")
    s = P.board_slug(F.col("u"))
    return n.select("id", "form", F.coalesce(s["greenhouse"], s["lever"], s["ashby"], s["workable"], s["teamtailor"]).alias("slug"))


SIGNS = {"org": r"example\.org[/a-z]*", "net": r"example\.net[/a-z]*", "title": "<h1>", "copy": "&copy; [a-z.]+"}


@query("SELECT host, product, array_to_string(list_sort(list(url || ' -> ' || sample)), '; ') AS samples FROM (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, url, s.product, substr(s.sample, 1, 80) AS sample FROM (SELECT url, unnest([" + ", ".join(f"{{'product': '{k}', 'sample': regexp_extract(html, {S.lit(p)}, 0)}}" for k, p in SIGNS.items()) + "]) AS s FROM pages)) WHERE sample <> '' GROUP BY host, product")
def s22_fingerprint(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("company"), "url", F.col("html").alias("body"))
    return P.fingerprints(pages, SIGNS).select(F.col("company").alias("host"), "product", F.array_join("samples", "; ").alias("samples"))


#: Some products of a company's pages; the second of each three pages failed.
PROBED = "probed AS (SELECT url, html, regexp_extract(url, '//([^/]+)', 1) AS company, CASE page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS status FROM pages)"
HITS = "hits AS (SELECT company, url, s.product, substr(s.sample, 1, 80) AS sample FROM (SELECT company, url, unnest([" + ", ".join(f"{{'product': '{k}', 'sample': regexp_extract(html, {S.lit(p)}, 0)}}" for k, p in SIGNS.items()) + "]) AS s FROM probed WHERE status < 400) WHERE s.sample <> '')"
SAMPLES = "array_to_string(list_sort(list(url || ' -> ' || sample)), '; ')"


def _probed(spark, sf_dir):
    k = F.col("page_id") % 3
    pages = B.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("company"), "url", F.when(k == 0, 200).when(k == 1, 404).alias("status"), F.col("html").alias("body"))
    return P.probed(pages, SIGNS)


@query(B.with_tables(f"SELECT p.company, p.fetched_ok, coalesce(h.hits, '') AS hits FROM (SELECT company, coalesce(bool_or(status < 400), false) AS fetched_ok FROM probed GROUP BY company) p LEFT JOIN (SELECT company, string_agg(product || ': ' || samples, ' | ' ORDER BY product) AS hits FROM (SELECT company, product, {SAMPLES} AS samples FROM hits GROUP BY ALL) GROUP BY company) h USING (company)", PROBED, HITS))
def s22_rollup(spark, sf_dir):
    """Each company with a map of products to samples, companies without hits or fetched pages included."""
    said = F.transform(F.array_sort(F.map_entries("hits")), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], "; ")))
    return _probed(spark, sf_dir).select("company", "fetched_ok", F.array_join(said, " | ").alias("hits"))


@query(B.with_tables("SELECT company, product, min(url || ' -> ' || sample) AS sample FROM hits WHERE product NOT IN ('copy', 'title') GROUP BY ALL", PROBED, HITS))
def s22_actionable(spark, sf_dir):
    return P.actionable(_probed(spark, sf_dir), ("copy", "title"))


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN lower(replace(s_name, ' ', '-')) || '-labs' WHEN s_suppkey % 3 = 1 THEN lower(replace(s_name, ' ', '-')) || 'network' END AS slug, CASE WHEN s_suppkey % 3 = 0 THEN 'lever' WHEN s_suppkey % 3 = 1 THEN 'ashby' END AS ats FROM supplier")
def s23_slug_resolution(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    base = F.lower(F.replace("s_name", F.lit(" "), F.lit("-")))
    k = F.col("s_suppkey") % 3
    ending = F.when(k == 0, "-labs").when(k == 1, "network").otherwise("-elsewhere")
    boards = s.select(F.concat(base, ending).alias("slug"), F.when(k == 0, "lever").otherwise("ashby").alias("ats"))
    boards = boards.unionByName(boards.select(F.concat("slug", F.lit("-inc")).alias("slug"), F.lit("late").alias("ats")))
    return P.resolved(s.select(F.col("s_name").alias("name")), boards)


# --- requests and responses -----------------------------------------------------------------------------------------


@query(B.with_tables("SELECT 'classify-' || id AS custom_id, 'Title: ' || coalesce(nullif(substr(t, 1, 500), ''), '(none)') || chr(10) || 'Company: ' || company || chr(10) || 'Location: ' || coalesce(location, '(none)') || chr(10) || 'Description: ' || coalesce(nullif(substr(d, 1, 2000), ''), '(none)') AS user FROM (SELECT *, "
    + S.sub("title", T.INJECTION, "[redacted]") + " AS t, " + S.sub("description", T.INJECTION, "[redacted]") + " AS d FROM postings)", B.POSTINGS))
def x24_requests(spark, sf_dir):
    return enrich.requests(B.postings(spark, sf_dir), "classify", "small", "You sort postings.", 2000, 300, True).select("custom_id", "user")




def _responses(spark, sf_dir):
    """Answers in the ways models give them: bare, fenced, within prose, and broken off; every ninth conversation failed."""
    t = F.col("turn")
    obj = F.to_json(F.struct(F.concat(F.lit("braces } in { text "), t.cast("string")).alias("note"), (t % 2 == 0).alias("eligible"), F.col("role").alias("reason"), (t * 17).alias("final_score"), F.lit("Marketing").alias("function_category"), (t * 40000).alias("salary_min_usd"), F.when(t % 3 == 0, 30000).alias("salary_max_usd"), (t / 3.0).alias("function_confidence"), F.array(F.lit(" a "), F.lit(""), F.col("role")).alias("strengths")))
    text = F.when(t % 4 == 0, obj).when(t % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(t % 4 == 2, F.concat(F.lit("Here it is: "), obj, F.lit(" Hope it helps."))).otherwise(F.substr(obj, F.lit(1), F.length(obj) - 5))
    rows = B.table(spark, sf_dir, "conversations").select("conv_id", t.alias("turn"), "role", F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string")).alias("custom_id"), F.when(F.col("conv_id") % 9 == 0, "errored").otherwise("succeeded").alias("outcome"), text.alias("answer"), (F.length("text")).cast("long").alias("input_tokens"))
    return rows.withColumn("body", enrich.json_object(F.col("answer")))


OK = "turn % 4 <> 3"


@query(f"SELECT conv_id, turn, {OK} AS parsed, CASE WHEN {OK} THEN 'braces }} in {{ text ' || turn END AS note, CASE WHEN {OK} THEN role END AS reason, CASE WHEN {OK} THEN CAST(turn * 17 AS VARCHAR) END AS score, CASE WHEN {OK} THEN ' a ||' || role END AS strengths FROM conversations")
def x25_lenient_json(spark, sf_dir):
    """The object of each answer, read back value by value."""
    b = F.col("body")
    strengths = F.array_join(F.from_json(enrich.get(b, "strengths"), "array<string>"), "|")
    return _responses(spark, sf_dir).select("conv_id", "turn", b.isNotNull().alias("parsed"), enrich.get(b, "note").alias("note"), enrich.get(b, "reason").alias("reason"), enrich.get(b, "final_score").alias("score"), strengths.alias("strengths"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind, CASE WHEN CAST(trunc(value) AS BIGINT) BETWEEN 1 AND 2000000 THEN CAST(trunc(value) AS INT) END AS salary, round_even(greatest(0.0, least(1.0, value / 100)), 2) AS confidence, CAST(greatest(0, least(100, trunc(value))) AS INT) AS score FROM events")
def x26_clamps(spark, sf_dir):
    v = F.col("value").cast("string")
    return B.table(spark, sf_dir, "events").select("event_id", enrich.in_enum(F.col("event_type"), ("click", "view"), "other").alias("kind"), enrich.clamped_salary(v).alias("salary"), enrich.clamped_confidence((F.col("value") / 100).cast("string")).alias("confidence"), enrich.clamped_score(v).alias("score"))


PAY = "CASE WHEN turn * 40000 BETWEEN 1 AND 2000000 AND turn % 2 = 0 THEN turn * 40000 END AS lo, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 30000 END AS hi"


@query(f"SELECT conv_id, turn, 'Marketing' AS function_category, 'Unspecified' AS seniority, CAST(CASE WHEN lo > hi THEN hi ELSE lo END AS INT) AS salary_min_usd, CAST(CASE WHEN lo > hi THEN lo ELSE hi END AS INT) AS salary_max_usd FROM (SELECT conv_id, turn, {PAY} FROM conversations WHERE {OK})")
def x27_classify_patch(spark, sf_dir):
    r = _responses(spark, sf_dir).filter("body IS NOT NULL").withColumn("id", F.struct("conv_id", "turn")).withColumn("salary_source", F.when(F.col("turn") % 2 != 0, "listed"))
    return enrich.classify_patch(r).select("id.conv_id", "id.turn", "function_category", "seniority", "salary_min_usd", "salary_max_usd")


@query(f"SELECT conv_id, turn, NOT ({OK} AND conv_id % 9 <> 0 AND turn % 2 <> 0) AS passed, CASE WHEN {OK} AND conv_id % 9 <> 0 AND turn % 2 <> 0 THEN role END AS reason FROM conversations")
def x28_geo_decision(spark, sf_dir):
    return _responses(spark, sf_dir).withColumn("g", enrich.geo_decision(F.col("outcome"), F.col("body"))).select("conv_id", "turn", "g.passed", "g.reason")


#: Answers to score requests, with values of wrong types, as text that both sides read alike.
ANSWER = """'{"location_eligible": ' || CASE WHEN turn % 5 = 4 THEN 'false' ELSE 'true' END || ', "final_score": ' || CASE turn % 4 WHEN 0 THEN CAST(turn * 17 AS STRING) WHEN 1 THEN '" ' || CAST(turn * 9 AS STRING) || '"' WHEN 2 THEN CAST(turn AS STRING) || '.7' ELSE '"high"' END
  || ', "verdict": "' || CASE WHEN turn % 2 = 0 THEN '  fits ' || role ELSE ' ' END || ' ", "subtotal": "' || CAST(turn AS STRING) || '.9", "dimensions": ' || CASE WHEN conv_id % 10 = 3 THEN '"none"' ELSE '{"skill_match": {"score": ' || CAST(turn * 3 AS STRING) || ', "notes": "' || repeat('n', CAST(75 + turn AS INT)) || '"}, "geography": {"score": true}, "seniority": null}' END
  || ', "adjustments": [{"label": "' || role || '", "value": "-' || CAST(turn AS STRING) || '"}, "odd", {"value": 2.9}], "strengths": [" a ", "", 7, "' || role || '", "late"], "gaps": "none"}'"""
AWAY = "turn % 5 = 4"
BUILT = f"({AWAY} OR turn % 4 <> 3 AND conv_id % 10 <> 3)"


def _answers(spark, sf_dir):
    rows = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("custom_id"), F.when(F.col("conv_id") % 9 == 0, "errored").otherwise("succeeded").alias("outcome"), F.expr(ANSWER).alias("answer"))
    broken = F.col("conv_id") % 7 == 5
    return rows.withColumn("body", enrich.json_object(F.when(broken, F.expr("left(answer, 40)")).otherwise(F.concat(F.lit("```json\n"), "answer", F.lit("\n```")))))


@query(f"""SELECT conv_id AS job_id, turn AS profile_id, CAST(CASE WHEN {AWAY} THEN 0 ELSE least(100, CASE turn % 4 WHEN 0 THEN turn * 17 WHEN 1 THEN turn * 9 ELSE turn END) END AS INT) AS match_score,
  CASE WHEN turn % 2 = 0 THEN 'fits ' || role END AS verdict, NOT ({AWAY}) AS eligible, CASE WHEN NOT {AWAY} THEN CAST(turn AS INT) END AS subtotal,
  CASE WHEN NOT {AWAY} THEN 'skill_match ' || turn * 3 || ' ' || repeat('n', CAST(least(80, 75 + turn) AS INT)) || ', industry_fit 0 , title_alignment 0 , seniority 0 , requirements 0 , geography 0 ' END AS dimensions,
  CASE WHEN NOT {AWAY} THEN role || ' ' || CASE WHEN turn = 0 THEN '0' ELSE '-' || turn END || ',  2' END AS adjustments, CASE WHEN {AWAY} THEN '' ELSE 'a|' || role END AS strengths, 0 AS gaps
  FROM conversations WHERE conv_id % 7 <> 5 AND {BUILT}""")
def x29_score_row(spark, sf_dir):
    r = _answers(spark, sf_dir).select(F.col("conv_id").alias("job_id"), F.col("turn").alias("profile_id"), "body")
    b = F.col("breakdown")
    cell = lambda d: F.concat_ws(" ", F.lit(d), b["dimensions"][d]["score"].cast("string"), b["dimensions"][d]["notes"])
    dims = F.when(b["dimensions"].isNotNull(), F.concat_ws(", ", *[cell(d) for d in enrich.DIMENSIONS]))
    changes = F.array_join(F.transform(b["adjustments"], lambda a: F.concat_ws(" ", a["label"], a["value"].cast("string"))), ", ")
    return enrich.score_rows(r).select(
        "job_id", "profile_id", "match_score", "verdict", b["location_eligible"].alias("eligible"), b["subtotal"].alias("subtotal"), dims.alias("dimensions"),
        changes.alias("adjustments"), F.array_join("strengths", "|").alias("strengths"), F.size("gaps").alias("gaps"),
    )


#: Every answer of a first turn comes twice, once as a failed one; requests of odd conversations were never sent.
SAID = f"CASE WHEN conv_id % 9 = 0 THEN 'errored' WHEN conv_id % 2 = 1 THEN 'unknown_id' WHEN conv_id % 7 = 5 THEN 'json_failed' WHEN NOT {BUILT} THEN 'build_failed' ELSE 'ok' END"


@query("SELECT role, " + ", ".join(f"count(*) FILTER (said = '{k}') AS {k}" for k in ("errored", "unknown_id", "json_failed", "build_failed", "ok")) + f", count(*) FILTER (turn = 0) AS repeated, count(*) FILTER (said IN ('unknown_id', 'json_failed', 'build_failed')) AS parse_failed FROM (SELECT *, {SAID} AS said FROM conversations) GROUP BY role")
def a15_write_back(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    twice = rows.unionByName(rows.filter("turn = 0").withColumns({"outcome": F.lit("expired"), "body": F.lit(None).cast("string")}))
    sent = rows.filter("conv_id % 2 = 0").select("custom_id")
    return enrich.write_back(twice, sent, "role")


@query("SELECT conv_id, turn, conv_id % 2 = 0 AS known FROM conversations")
def j4_match_responses(spark, sf_dir):
    r = _responses(spark, sf_dir).select("conv_id", "turn", "custom_id")
    sent = F.when(F.col("conv_id") % 2 == 0, F.col("custom_id")).otherwise(F.concat(F.lit("other-"), "custom_id"))
    return enrich.matched(r, r.select(sent.alias("custom_id"))).select("conv_id", "turn", "known")


OUTCOMES = f"count(*) FILTER (conv_id % 9 = 0) AS errored, count(*) FILTER (conv_id % 9 <> 0 AND NOT {OK}) AS json_failed, count(*) FILTER (conv_id % 9 <> 0 AND {OK}) AS ok, count(*) AS total"


def _outcomes(spark, sf_dir):
    return enrich.outcomes(_responses(spark, sf_dir), "role")


@query(f"SELECT role, {OUTCOMES} FROM conversations GROUP BY role")
def a15_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(f"SELECT role, CASE WHEN json_failed * 1.0 / total > 0.2 THEN 'hard_fail' WHEN json_failed * 1.0 / total > 0.05 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT role, {OUTCOMES} FROM conversations GROUP BY role)")
def a16_parse_status(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("role", enrich.parse_status(F.col("json_failed"), F.col("total")).alias("status"))


@query("SELECT conv_id % 9 = 0 AS errored, CAST(sum(length(text)) AS BIGINT) AS input_tokens FROM conversations GROUP BY 1")
def a17_usage(spark, sf_dir):
    return enrich.usage(_responses(spark, sf_dir))


@query(f"SELECT coalesce(reason, 'pass') AS reason, count(*) AS n FROM (SELECT CASE WHEN {OK} AND conv_id % 9 <> 0 AND turn % 2 <> 0 THEN role END AS reason FROM conversations) GROUP BY 1")
def a20_reason_buckets(spark, sf_dir):
    g = enrich.geo_decision(F.col("outcome"), F.col("body"))
    return _responses(spark, sf_dir).groupBy(F.coalesce(g["reason"], F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


#: Skill graphs with values of wrong types, as text that both sides read alike.
GRAPH_TEXT = """'{"skills": [{"name": " ' || c_mktsegment || ' ", "level": "SENIOR ", "years": "' || CAST(c_custkey % 80 AS STRING) || '", "evidence": "' || repeat('e', CAST(c_custkey % 100 AS INT)) || '"}, {"name": "Go", "level": "guru", "years": 3.9}, "odd", {"name": " ", "years": 1}, {"name": 7, "years": "2.5", "level": null}], "domains": '
  || CASE WHEN c_custkey % 3 = 0 THEN '"retail"' ELSE '["retail", " ", 5, "' || repeat('d', 70) || '", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13"]' END || ', "seniority_anchor": ' || CASE WHEN c_custkey % 2 = 0 THEN '" Staff"' ELSE '"wizard"' END
  || ', "location": ' || CASE WHEN c_custkey % 4 = 0 THEN '["Lima"]' ELSE '{"city": " C' || CAST(c_nationkey AS STRING) || ' "}' END || ', "languages": ["en: native"], "preferences": {"a": 1}, "deal_breakers": [" ' || repeat('b', CAST(c_custkey % 200 AS INT)) || '"]}'"""
REAL = "c_custkey % 5 > 1"


def _graphs(spark, sf_dir):
    k = F.col("c_custkey")
    return _dealt(spark, sf_dir).select(k.alias("id"), F.col("c_name").alias("text"), F.when(k % 5 == 0, "{}").when(k % 5 == 1, None).otherwise(F.expr(GRAPH_TEXT)).alias("graph"))


@query(f"""SELECT c_custkey AS id, CASE WHEN {REAL} THEN c_mktsegment || ':senior:' || least(50, c_custkey % 80) || ':' || repeat('e', CAST(least(80, c_custkey % 100) AS INT)) || ',Go:exposure:3:,7:exposure:0:' ELSE '' END AS skills,
  CASE WHEN {REAL} AND c_custkey % 3 <> 0 THEN 'retail|5|' || repeat('d', 60) || '|1|2|3|4|5|6|7|8|9|10|11' ELSE '' END AS domains,
  CASE WHEN {REAL} AND c_custkey % 2 = 0 THEN 'staff' ELSE 'unclear' END AS anchor, CASE WHEN {REAL} AND c_custkey % 4 <> 0 THEN 'C' || c_nationkey ELSE '' END AS city, '' AS country,
  CASE WHEN {REAL} THEN 'en: native' ELSE '' END AS languages, '' AS preferences, CASE WHEN {REAL} THEN repeat('b', CAST(least(120, c_custkey % 200) AS INT)) ELSE '' END AS deal_breakers
  FROM customer WHERE c_custkey % 5 <> 1""")
def x30_graph_sanitize(spark, sf_dir):
    # Not a filter: it would be pushed below the projection, and each graph read twice.
    there = F.filter(F.array(enrich.sane_graph(F.col("graph"))), lambda g: g.isNotNull())
    g = _graphs(spark, sf_dir).select("id", F.explode(there).alias("g")).select("id", "g.*")
    skills = F.array_join(F.transform("skills", lambda s: F.concat_ws(":", s["name"], s.level, s.years.cast("string"), s.evidence)), ",")
    joined = lambda c: F.array_join(c, "|").alias(c)
    return g.select("id", skills.alias("skills"), joined("domains"), F.col("seniority_anchor").alias("anchor"), "location.city", "location.country", joined("languages"), joined("preferences"), joined("deal_breakers"))


@query(f"SELECT c_custkey AS id, CASE WHEN {REAL} THEN lower(c_mktsegment) ELSE '' END AS terms FROM customer")
def x31_skill_terms(spark, sf_dir):
    """Terms of all customers; without a graph there are none."""
    g = _graphs(spark, sf_dir).select("id", enrich.sane_graph(F.col("graph")).alias("g"))
    return g.select("id", F.coalesce(F.array_join(enrich.skill_terms(F.col("g")), ","), F.lit("")).alias("terms"))


#: Some texts get a line with a place: late, after another kind of place, or not at all.
RESUME = "CASE doc_id % 4 WHEN 0 THEN 'x' || chr(10) || 'Based near La Plata, Buenos Aires Province. ' || chr(10) || text WHEN 1 THEN 'from new YORK CITY, USA today' || chr(10) || text WHEN 2 THEN 'at Lima,  Peru' || chr(10) || 'Rosario' || chr(10) || text ELSE text END"
HEAD = f"list_slice(string_split_regex(t, {S.lit(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'x0b' + chr(92) + 'f' + chr(92) + 'x1c-' + chr(92) + 'x1e' + chr(92) + 'x{85}' + chr(92) + 'x{2028}' + chr(92) + 'x{2029}]')}), 1, 30)"


def _first_in_head(p: str, line: str = "s") -> str:
    return f"list_filter(list_transform(h, lambda s: regexp_extract({line}, {S.lit(p)}, 0)), lambda s: s <> '')[1]"


#: To the oracle's boundary of words only ASCII is in words: other letters and digits are put between zeros, and taken out of a place again.
FLANKED = r"regexp_replace(s, '([^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}])', '0\10', 'g')"
KNOWN = f"replace({_first_in_head(r'\b' + enrich.PLACES.replace('ó', '0ó0') + r'\b', FLANKED)}, '0ó0', 'ó')"


@query(
    f"WITH r AS (SELECT doc_id, {RESUME} AS t FROM documents), s AS (SELECT doc_id, {HEAD} AS h FROM r), p AS (SELECT doc_id, {S.strip(f'coalesce({KNOWN}, {_first_in_head(enrich.TWO_NAMES)})')} AS place FROM s) "
    f"SELECT doc_id, place, {S.strip('string_split(place, chr(44))[1]')} AS city, {S.strip('string_split(place, chr(44))[-1]')} AS country FROM p"
)
def x32_profile_location(spark, sf_dir):
    rows = B.table(spark, sf_dir, "documents").select("doc_id", enrich.profile_location(F.expr(RESUME.replace("chr(10)", "'\\n'"))).alias("place"))
    return rows.withColumn("p", enrich.city_country(F.col("place"))).select("doc_id", "place", "p.city", "p.country")


@query(f"SELECT c_custkey AS id, CASE WHEN {REAL} THEN 'graph' ELSE 'text' END AS mode, CASE WHEN {REAL} THEN NULL ELSE c_name END AS text FROM customer")
def x33_payload_choice(spark, sf_dir):
    p = _graphs(spark, sf_dir).withColumn("p", enrich.payload(F.col("graph"), F.col("text")))
    return p.select("id", "p.mode", F.when(F.col("p.mode") == "text", F.col("p.payload")).alias("text"))
