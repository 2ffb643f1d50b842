"""The engine's expressions as SQL text, for the oracle."""

from __future__ import annotations

from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(by)}, 'g')"


def strip(c: str) -> str:
    return sub(c, r"^\s+|\s+$", "")


def collapsed(c: str) -> str:
    return strip(sub(c, r"\s+", " "))


def normalized(c: str) -> str:
    return collapsed(sub(sub(strip(f"lower(coalesce({c}, ''))"), T.COMPANY_SUFFIX, ""), r"[^\p{L}\p{N}_\s]", " "))


def bucket(c: str) -> str:
    low = strip(f"lower(coalesce({c}, ''))")
    cut = f"substr({collapsed(sub(f'split_part({low}, {lit(",")}, 1)', r'[^\p{L}\p{N}_\s]', ' '))}, 1, 24)"
    return f"CASE WHEN {low} = '' THEN 'any' WHEN regexp_matches({low}, {lit('|'.join(T.REMOTE_HINTS))}) THEN 'remote' WHEN {cut} = '' THEN 'any' ELSE {cut} END"


def key(title: str, company: str, location: str) -> str:
    return f"{normalized(title)} || '|' || {normalized(company)} || '|' || {bucket(location)}"


def valid_key(c: str) -> str:
    return f"coalesce({sub(c, r'\|[^|]*$', '')} NOT IN ('', '|'), false)"


def blob(*columns: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce({c}, '')" for c in columns) + ")"


def hits(text: str, terms) -> str:
    """The number of terms that a text contains."""
    return "(" + " + ".join(f"CAST(contains({text}, {lit(t)}) AS INT)" for t in terms) + ")" if terms else "0"


def first_hit(text: str, terms) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {lit(t)}) THEN {lit(t)}" for t in terms) + " END"


def extract(c: str, pattern: str, k: int) -> str:
    return f"regexp_extract({c}, {lit(pattern)}, {k})"


def strip_html(c: str) -> str:
    text = sub(f"coalesce({c}, '')", "<[^>]+>", " ")
    for a, b in T.ENTITIES:
        text = f"replace({text}, {lit(a)}, {lit(b)})"
    return collapsed(text)


def tags_gone(c: str) -> str:
    return collapsed(sub(f"coalesce({c}, '')", "<[^>]+>", " "))


def strip_html_if_markup(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {lit(r'^\s*<')}) THEN {tags_gone(c)} ELSE {strip(c)} END"


def strip_html_unescaped(c: str) -> str:
    text = c
    for a, b in T.ENTITIES[1:] + T.ENTITIES[:1]:
        text = f"replace({text}, {lit(a)}, {lit(b)})"
    return tags_gone(text)


def capped(c: str, chars: int = 5000) -> str:
    return f"nullif(substr({c}, 1, {chars}), '')"


BLOB = blob("title", "company", "description", "location")
