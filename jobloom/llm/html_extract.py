"""Main text of web pages by site template removal.

Every element's subtree gets a hash of its tags and texts. Spark counts on how many different pages of a host, and in how
many different parents, each subtree occurs; subtrees that recur across many of them are the host's template and are
deleted, together with elements that are page furniture by their tag, role or class. Copies of a page count once. Running
text of an article (paragraphs, headings, quotes, items, parts of lines) is never template by itself, however often it
recurs; containers in an article are, as anything is outside of one. What is left of the article is written block by block.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import same, stored

#: A subtree is template if it is on so many pages of its host, and on this share of them.
LEAST_PAGES = 10
LEAST_SHARE = 0.3
#: On small hosts a block is template from fewer pages on, if on nearly all of them.
SMALL_PAGES, SMALL_SHARE = 3, 0.8

#: HTML's own tags and common names of page furniture.
FURNITURE_TAGS = frozenset("head nav footer aside form script style noscript iframe object svg canvas template button select textarea input dialog menu".split())
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes svg".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are template in an article, too, where they recur.
CONTAINERS = frozenset("address aside center details dir div dl fieldset footer form header menu nav ol section table ul".split())
LOOSE_TAGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup td th li dt dd figcaption summary".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
LISTS = frozenset("ul ol dl table menu article main section div body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Furniture that stays where it holds the page's main text, furniture that stays where it holds a main element, and never.
WRAPPER, PART, NEVER = 1, 2, 3
NEVER_TAGS = FURNITURE_TAGS - frozenset("nav footer aside form menu dialog".split())
#: A wrapper without article or main stays from this share of the page's text on.
WRAPPER_SHARE = 0.8
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe social share sharing comment comments disqus replies related recommended".split()
)
FURNITURE_COMPOUNDS = frozenset(
    "site-header page-header site-footer page-footer main-footer site-nav main-nav top-nav nav-bar nav-menu main-menu site-menu side-bar left-sidebar right-sidebar sidebar-left sidebar-right cookie-banner cookie-notice cookie-bar cookie-consent consent-banner gdpr-banner ad-banner ad-container ad-slot ad-unit ad-wrapper ad-box share-bar share-buttons share-links social-bar social-buttons social-icons social-links social-share related-articles related-links related-posts related-stories comment-form comment-list comment-section comments-area comments-section disqus-thread newsletter-box newsletter-form newsletter-signup popup-overlay modal-dialog promo-box sponsored-content breadcrumb-trail".split()
)
MAIN_TAGS = frozenset(("article", "main"))

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
BREAK = None


def furniture_kind(tag: str, attributes: str, in_main: bool) -> int:
    """0 or the kind of furniture: by tag, by role, or by a whole class or id. Ids of headings and paragraphs are anchors."""
    if tag in NEVER_TAGS:
        return NEVER
    if tag == "form" or tag == "header" and not in_main:
        return WRAPPER
    if tag in FURNITURE_TAGS:
        return PART
    if not attributes or tag in MAIN_TAGS or tag in ("html", "body"):
        return 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, tokens = name.lower(), value.strip("\"'").lower().replace("_", "-").split()
        if name == "role":
            if FURNITURE_ROLES.intersection(tokens):
                return WRAPPER
        elif (name == "class" or tag != "p" and tag not in HEADINGS) and any(t in FURNITURE_WORDS or t in FURNITURE_COMPOUNDS for t in tokens):
            return WRAPPER
    return 0


class Page:
    """One page's blocks, with the hash and the place of each subtree that may be template. Takes time in proportion to the
    page: places of open elements are kept by tag, and it is parsed anew at most once for each way in which furniture may
    hold the main text."""

    def __init__(self, page: str):
        #: Elements, by their number, that would be furniture but hold the page's main text.
        self.kept: set[int] = set()
        self.parse(page)
        while more := self.holders():
            self.kept |= more
            self.parse(page)

    def parse(self, page: str) -> None:
        #: Furniture, but that in NEVER: number, kind, that around it, depth, own characters, whether it holds main and article.
        self.furniture: list[dict] = []
        #: Open articles inside furniture, as [furniture, whether they have text], and how deep the first with text would come up.
        self.hidden: list[list] = []
        self.shallowest: int | None = None
        self.elements = 0
        self.tokens: list[str | None] = []
        #: Subtrees that may be template: hash, first token, token after the last.
        self.spans: list[tuple[int, int, int]] = []
        #: A subtree's hash, its weight (2 for blocks, 1 for parts of them) and its parent's hash.
        self.parents: set[tuple[int, int, int]] = set()
        self.mains: list[tuple[int, int]] = []
        #: Open elements: tag, depth and worst kind of furniture, the innermost one, first token, child hashes, hashes and
        #: weights of child elements.
        self.stack: list[tuple] = [("", 0, 0, None, 0, [], [])]
        #: Places in the stack of open elements by tag, and of those that end the reach of an implied end tag.
        self.where: dict[str, list[int]] = defaultdict(list)
        self.lists: list[int] = []
        at, find = 0, _TAG.search
        while m := find(page, at):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self.close(tag)
                continue
            self.open(tag, attributes)
            if tag in RAW_TAGS:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
        if at < len(page):
            self.text(page[at:])
        while len(self.stack) > 1:
            self.pop()
        self.parents.update((*x, 0) for x in self.stack[0][6])

    def text(self, raw: str) -> None:
        _, depth, kind, inner, _, children, _ = self.stack[-1]
        if depth:
            if kind != NEVER:
                size = len("".join(raw.split()))
                inner["own"] += size
                if size and self.hidden and self.hidden[-1][0] is inner:
                    self.hidden[-1][1] = True
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self.tokens.append(text)
        if words := text.split():
            children.append(" ".join(words).encode("utf-8", "surrogatepass"))

    def in_main(self) -> bool:
        return any(self.where[t] for t in MAIN_TAGS)

    def pop(self) -> None:
        tag, depth, kind, inner, first, children, names = self.stack.pop()
        if tag:
            self.where[tag].pop()
            if tag in LISTS:
                self.lists.pop()
        if depth:
            if tag == "article" and kind != NEVER:
                around, filled = self.hidden.pop()
                if filled and around["open"] and (self.shallowest is None or around["depth"] < self.shallowest):
                    self.shallowest = around["depth"]
            return
        if tag in BLOCK_TAGS:
            self.tokens.append(BREAK)
        if children:
            name = xxhash.xxh3_64_intdigest(b"\x00".join([tag.encode(), *children])) - 2**63
            self.parents.update((*x, name) for x in names)
            self.stack[-1][5].append(name.to_bytes(8, "little", signed=True))
            if tag in CONTAINERS or not self.in_main():
                self.spans.append((name, first, len(self.tokens)))
                self.stack[-1][6].append((name, 2 if tag in BLOCK_TAGS and tag not in LOOSE_TAGS else 1))
        if tag in MAIN_TAGS and not self.in_main():
            self.mains.append((first, len(self.tokens)))

    def open(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag in BLOCK_TAGS and self.where["p"]:
            self.close("p")
        ends = max((self.where[t][-1] for t in CLOSED_BY.get(tag, ()) if self.where[t]), default=0)
        if ends > (self.lists[-1] if self.lists else 0):
            while len(stack) > ends:
                self.pop()
        _, depth, worst, inner, *_ = stack[-1]
        if tag in VOID_TAGS:
            if not depth:
                self.tokens.append(BREAK if tag in BLOCK_TAGS else " ")
            return
        self.elements += 1
        kind = 0 if self.elements in self.kept else furniture_kind(tag, attributes, self.in_main())
        if depth and worst != NEVER and tag in MAIN_TAGS:
            around, what = inner, "main" if tag == "main" else "article"
            while around and not around[what]:
                around[what] = True
                around = around["around"]
        if kind and worst != NEVER:
            deep = inner["depth"] + 1 if inner else 1
            inner = {"number": self.elements, "kind": kind, "around": inner, "depth": deep, "own": 0, "main": False, "article": False, "open": kind == WRAPPER and (not inner or inner["open"])}
            self.furniture.append(inner)
        depth, worst = depth + (kind > 0), max(kind, worst)
        if depth and tag == "article" and worst != NEVER:
            self.hidden.append([inner, False])
        if not depth and tag in BLOCK_TAGS:
            self.tokens.append(BREAK)
        self.where[tag].append(len(stack))
        if tag in LISTS:
            self.lists.append(len(stack))
        stack.append((tag, depth, worst, inner, len(self.tokens), [], []))

    def holders(self) -> set[int]:
        """Furniture that holds the page's main text: main, the only articles, or most of a page that has neither.

        main is brought up through all furniture around it; articles through wrappers only, as far as the first with text
        needs it.
        """
        loose = [x for x in self.furniture if x["kind"] != NEVER]
        if found := {x["number"] for x in loose if x["main"]}:
            return found
        if not loose or any(not self.blank(a, b) for a, b in self.mains):
            return set()
        if found := {x["number"] for x in loose if x["article"] and x["open"] and (self.shallowest is None or x["depth"] <= self.shallowest)}:
            return found
        outer = [x for x in self.furniture if x["depth"] == 1]
        size = sum(len("".join(t.split())) for t in self.tokens if t) + sum(x["own"] for x in outer)
        return {x["number"] for x in outer if x["kind"] == WRAPPER and x["own"] and x["own"] >= size * WRAPPER_SHARE}

    def close(self, tag: str) -> None:
        if self.where[tag]:
            at = self.where[tag][-1]
            while len(self.stack) > at:
                self.pop()

    def main_text(self, dead: frozenset[int] = frozenset()) -> str:
        """The blocks of the article, or of the whole page where no article has text, without dead subtrees.

        A subtree that holds all of that text is not deleted. Where the dead subtrees together hold all of it, or more
        than half of an article, they are the page's content and stay.
        """
        parts = [(a, b) for a, b in self.mains if not self.blank(a, b)]
        whole = self.blocks([t for a, b in parts for t in [*self.tokens[a:b], BREAK]]) if parts else self.blocks(self.tokens)
        if not whole or not dead:
            return whole
        filled = [k for a, b in parts or [(0, len(self.tokens))] for k in range(a, b) if not self.blank(k, k + 1)]
        tokens, end = list(self.tokens), 0
        # Subtrees by their first token, the largest first: what lies in one that is gone is passed over.
        for name, a, b in sorted(self.spans, key=lambda x: (x[1], -x[2])):
            if b > end and name in dead and (a > filled[0] or b <= filled[-1]):
                tokens[a:b] = [BREAK] * (b - a)
                end = b
        left = self.blocks([t for a, b in parts or [(0, len(tokens))] for t in [*tokens[a:b], BREAK]])
        return left if left and not (parts and 2 * len(left) < len(whole)) else whole

    def blank(self, first: int, last: int) -> bool:
        return not any(t and not t.isspace() for t in self.tokens[first:last])

    @staticmethod
    def blocks(tokens: list[str | None]) -> str:
        out, part = [], []
        for t in [*tokens, BREAK]:
            if t is not BREAK:
                part.append(t)
            elif part:
                if words := "".join(part).split():
                    out.append(" ".join(words))
                part = []
        return "\n".join(out)


#: A page's row, its host, the hash of its text, one of its subtrees and that one's weight and parent; mark 0 is the page itself.
MARKS = pa.schema([("page_id", pa.int64()), ("key", pa.int64()), ("host", pa.string()), ("content", pa.int64()), ("mark", pa.int64()), ("weight", pa.int64()), ("parent", pa.int64())])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, key, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(html or "")
            content = xxhash.xxh3_64_intdigest(page.main_text().encode("utf-8", "replace")) - 2**63
            rows += [(page_id, key, host, content, *mark) for mark in [*page.parents, (0, 0, 0)]]
        columns = zip(*rows, strict=True) if rows else [()] * len(MARKS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, MARKS.types, strict=True)], schema=MARKS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dead = [frozenset(x or ()) for x in batch.column(2).to_pylist()]
        texts = [Page(p or "").main_text(d).encode("utf-8", "replace").decode() for p, d in zip(batch.column(3).to_pylist(), dead, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html gives an empty text. A page whose url is null or has no host is a host of its own. Rows that
    repeat page_id, url and html give equal rows; null ids are kept. Other columns are not read, and an empty table
    gives no rows. Texts are whole, however long. Pages of a host with the same text, under one url or several, count as
    one page when its template is looked for.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Rows are told apart by page_id and key, so it takes two pages of one id for their hashes to meet.
    keyed = pages.withColumn("key", F.xxhash64("url", "html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.coalesce(F.nullif(host, F.lit("")), F.concat_ws(" ", F.lit(""), F.col("page_id").cast("string"), F.col("key").cast("string")))
    marks = keyed.select("page_id", "key", host.alias("host"), "html").mapInArrow(_marks, "page_id long, key long, host string, content long, mark long, weight long, parent long")
    marks = stored(marks, "marks")
    counts = marks.groupBy("host", "mark").agg(F.count_distinct("content").alias("contents"), F.count_distinct("parent").alias("parents"), F.max("weight").alias("weight"))
    # A part of a larger subtree that recurs has that one parent only, and goes or stays with it.
    counts = counts.select("host", "mark", "weight", F.when(F.col("mark") == 0, F.col("contents")).otherwise(F.least("contents", "parents")).alias("n"))
    counts = stored(counts.filter((F.col("mark") == 0) | (F.col("n") >= min(least_pages, SMALL_PAGES))), "subtrees")
    totals = counts.filter("mark = 0").select("host", F.col("n").alias("pages"))
    n = F.col("n")
    small = (n >= SMALL_PAGES) & (F.col("weight") > 1) & (n >= F.col("pages") * SMALL_SHARE)
    often = (n >= least_pages) & (n >= F.col("pages") * least_share)
    template = stored(counts.filter("mark <> 0").join(totals, "host").filter(often | small).select("host", "mark"), "template")
    dead = marks.join(template, ["host", "mark"]).groupBy(F.col("page_id").alias("p"), F.col("key").alias("k")).agg(F.collect_set("mark").alias("dead"))
    whole = keyed.join(stored(dead, "dead"), same(F.col("page_id"), F.col("p")) & (F.col("key") == F.col("k")), "left").select("page_id", "url", "dead", "html")
    return whole.mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
