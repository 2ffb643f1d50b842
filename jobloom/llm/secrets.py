"""Secret scans with a randomness test battery, with DataFrame operations only.

Fixed patterns give the base spans. Beyond them, every long run of key characters, and every long segment of it between
slashes and equals signs, is tested: its encoding is inferred from its alphabet, and chi-squared uniformity, runs and
serial-correlation tests say whether it fits random symbols of that encoding. How much less likely it is as ordinary text
(words, paths, names with numbers: characters that mostly stay in their class) gives each run a p-value of its own: a
likelihood ratio of 2^b comes up in ordinary text with a probability of at most 2^-b. How often ordinary text changes its
class of characters is measured, for each encoding, on the runs that the tests reject. Within classes of length and
encoding the Benjamini-Hochberg rule takes the runs that are reported, so a certain run stays whatever else its class holds.
Runs that meet a base span are neither counted nor reported.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ._common import digest, stored

#: Fixed patterns: kind, expression, smallest length of the match or of the value in its last group.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

#: Runs that are tested, and the length classes by their smallest length.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = (20, 28, 40, 56, 80, 120)
#: Alphabets by encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Each test's |z| must stay under this.
MOST_Z = 3.0
#: Largest expected share of false discoveries in a class of lengths.
FALSE_SHARE = 0.05
#: Segments of a run.
SEGMENT = r"[A-Za-z0-9+_-]{20,}"
#: Ordinary text before anything is measured: chances of a character to stay in its class, and the same after a separator;
#: they count as so many characters.
STAY, STAY_APART, PRIOR_CHARS = 0.85, 0.15, 1000
#: Whole bits that p-values are counted by, at most.
MOST_BITS = 200


KINDS = ("assign", "access", "hex", "random")


def running(values: Column, of: Callable[[Column, Column], Column], start: int) -> Column:
    """The running of(total, value) of an array of whole numbers.

    An array is copied for each number added to it, so it is cut into as many pieces as each has numbers: a long array
    costs little more than its length.
    """
    none = F.array().cast("array<int>")
    scan = lambda a: F.aggregate(a, none, lambda done, v: F.concat(done, F.array(of(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(start)), v).cast("int"))))

    def cut(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        pieces = F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1)
        return F.when(F.size(x) > 0, F.transform(pieces, lambda c: scan(F.slice(x, c * width + 1, width)))).otherwise(F.array().cast("array<array<int>>"))

    def joined(pieces: Column) -> Column:
        before = scan(F.transform(pieces, lambda p: F.element_at(p, -1)))
        return once(before, lambda b: F.flatten(F.transform(pieces, lambda p, k: F.transform(p, lambda v: of(F.coalesce(F.get(b, k - 1), F.lit(start)), v).cast("int")))))

    return once(once(values, cut), joined)


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, as an array of (start, stop, match), code points from 0.

    Splitting at the pattern gives the text between matches, so lengths add up to places.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def placed(x: Column) -> Column:
        stops = running(F.transform(x["hits"], lambda h, k: F.get(x["gaps"], k) + F.length(h)), lambda total, v: total + v, 0)
        return F.zip_with(x["hits"], stops, lambda h, stop: F.struct((stop - F.length(h)).alias("start"), stop.alias("stop"), h.alias("match")))

    return once(F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)


def apart(tested: Column, base: Column) -> Column:
    """Those of tested that meet none of base.

    In the order of their starts, a span meets an earlier base span if the largest stop so far is beyond its start, and a
    later one if the next base span starts before its stop.
    """
    of = lambda spans, kind, t: F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(kind).alias("kind"), s.stop.alias("stop"), t(s).alias("t")))
    far = 2**31 - 1

    def kept(x: Column) -> Column:
        stops = running(F.transform(x, lambda s: F.when(s.kind == 0, s.stop).otherwise(-1)), lambda most, v: F.greatest(most, v), -1)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s.kind == 0, s.start).otherwise(far))), lambda least, v: F.least(least, v), far))
        free = lambda b: F.filter(x, lambda s, k: (s.kind == 1) & (F.get(b["stops"], k) <= s.start) & (F.get(b["starts"], k) >= s.stop))
        return once(F.struct(stops.alias("stops"), starts.alias("starts")), lambda b: F.transform(free(b), lambda s: s.t))

    none = F.get(F.slice(tested, 1, 0), F.lit(0))
    both = F.array_sort(F.concat(of(base, 0, lambda s: none), of(tested, 1, lambda s: s)))
    return F.when((F.size(base) == 0) | (F.size(tested) == 0), tested).otherwise(once(both, kept))


def outermost(hits: Column) -> Column:
    """Those of hits, no two of which are the same span, that lie in no other: the earlier ones, of those with one start
    the longer first, end before they do."""

    def kept(x: Column) -> Column:
        ends = running(F.transform(x, lambda s: s.stop), lambda most, v: F.greatest(most, v), -1)
        return once(ends, lambda e: F.filter(x, lambda s, k: F.coalesce(F.get(e, k - 1), F.lit(-1)) < s.stop))

    ordered = F.array_sort(F.transform(hits, lambda s: F.struct(s.start.alias("start"), (-s.stop).alias("back"), s.stop.alias("stop"))))
    return F.when(F.size(hits) < 2, ordered).otherwise(once(ordered, kept))


def base_spans(text: Column) -> list[Column]:
    """Spans by kind: assign, access, hex."""
    assign = F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_replace(s.match, ASSIGN_HEAD, "")) >= ASSIGN_CHARS)
    # A run of these characters is one match, so asking for its length in the pattern gives the same matches.
    access = found(text, ACCESS.replace("+", f"{{{ACCESS_CHARS - 4},}}"))
    return [assign, access, found(text, HEX.replace("+", f"{{{HEX_CHARS},}}"))]


def looks_random(token: Column, alphabet: str) -> Column:
    """Whether chi-squared uniformity, runs and serial correlation of the token fit uniform independent symbols."""
    k, half = len(alphabet), len(alphabet) // 2
    n = F.length(token).cast("double")
    counts = [(F.length(token) - F.length(F.replace(token, F.lit(c), F.lit("")))).cast("double") for c in alphabet]
    chi = sum((c * c for c in counts[1:]), counts[0] * counts[0]) * k / n - n
    # Wilson and Hilferty: the cube root of chi-squared by its degrees of freedom is nearly normal.
    d = float(k - 1)
    chi_z = (F.cbrt(F.greatest(chi, F.lit(0.0)) / d) - (1 - 2 / (9 * d))) / (2 / (9 * d)) ** 0.5
    bits = F.translate(token, alphabet, "0" * half + "1" * (k - half))
    ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    mean = 2 * ones * (n - ones) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.length(F.regexp_replace(bits, "0+|1+", "x")).cast("double")
    runs_z = F.when(spread > 0, (runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(99.0))
    state = "struct<before:double,total:double>"

    def add(a: Column, c: Column) -> Column:
        v = F.position(c, F.lit(alphabet)).cast("double") - (k + 1) / 2
        return F.struct(v.alias("before"), (a.total + a.before * v).alias("total")).cast(state)

    serial = F.aggregate(F.split(token, ""), F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("total")).cast(state), add).total
    serial_z = serial / ((k * k - 1) / 12 * F.sqrt(n - 1))
    return (F.abs(chi_z) <= MOST_Z) & (F.abs(runs_z) <= MOST_Z) & (F.abs(serial_z) <= MOST_Z)


def shape(token: Column) -> list[Column]:
    """What ordinary text is told by: characters, those of each kind, and changes from one class to another."""
    of = lambda chars: F.length(token) - F.length(F.regexp_replace(token, f"[{chars}]+", ""))
    return [
        F.length(token).alias("n"),
        of("A-Za-z").alias("letters"),
        of("0-9").alias("digits"),
        F.length(F.regexp_replace(token, "[a-z]+|[A-Z]+|[0-9]+|[+/]+", "x")).alias("runs"),
        F.regexp_count(token, F.lit("[+/](?=[A-Za-z0-9])")).alias("left"),
        F.regexp_count(token, F.lit("[+/](?=[+/])")).alias("double"),
    ]


def tested(text: Column) -> Column:
    """Runs of key characters and their segments as an array of (start, stop, size, code, ordinary, random, and shape()):
    the places of their length's class and of their encoding, and whether the battery takes them for random symbols of
    that encoding. Lower-case words are ordinary text."""

    def test(s: Column) -> Column:
        token = F.translate(F.regexp_replace(s.match, "=+$", ""), "-_=", "+/")
        code = F.when(token.rlike("^[0-9a-f]+$"), 0).when(token.rlike("^[0-9A-F]+$"), 1).when(token.rlike("^[A-Z2-7]+$"), 2).otherwise(3)
        random = F.lit(False)
        for k, alphabet in reversed(list(enumerate(ALPHABETS.values()))):
            random = F.when(code == k, looks_random(token, alphabet)).otherwise(random)
        size = sum(((F.length(s.match) >= c).cast("int") for c in CLASSES[1:]), F.lit(0))
        ordinary = (F.length(token) < CLASSES[0]) | s.match.rlike("^[a-z]+$")
        named = [s.start.alias("start"), s.stop.alias("stop"), size.alias("size"), code.alias("code"), ordinary.alias("ordinary")]
        return F.struct(*named, F.when(ordinary, F.lit(False)).otherwise(random).alias("random"), *shape(token))

    def with_segments(s: Column) -> Column:
        moved = lambda g: F.struct((s.start + g.start).alias("start"), (s.start + g.stop).alias("stop"), g.match.alias("match"))
        # A segment that is the whole run is there already.
        parts = lambda: F.filter(found(s.match, SEGMENT), lambda g: F.length(g.match) < F.length(s.match))
        return F.when(s.match.rlike("/|=[^=]"), F.concat(F.array(s), F.transform(parts(), moved))).otherwise(F.array(s))

    return F.transform(F.flatten(F.transform(found(text, RUN), with_segments)), test)


def background(rows: DataFrame) -> list[tuple[float, float]]:
    """For each encoding, the chances of ordinary text to stay in a class of characters, and to stay with separators, as
    measured on the runs that the battery rejects. One row for each encoding comes to the driver."""
    t = rows.select(F.explode("tested").alias("t")).filter("NOT t.random AND NOT t.ordinary").select("t.*")
    sums = t.groupBy("code").agg(F.sum(F.col("n") - F.col("runs") - F.col("double")).alias("stay"), F.sum(F.col("runs") - 1 - F.col("left")).alias("change"), F.sum("double").alias("double"), F.sum("left").alias("left"))
    by = {r.code: r for r in sums.collect()}
    share = lambda yes, no, prior: (yes + prior * PRIOR_CHARS) / (yes + no + PRIOR_CHARS)
    return [(share(r.stay, r.change, STAY), share(r.double, r.left, STAY_APART)) if (r := by.get(code)) else (STAY, STAY_APART) for code in range(len(ALPHABETS))]


def text_bits(t: Column, rates: list[tuple[float, float]]) -> Column:
    """log2 of how much likelier a tested run is as random symbols than as ordinary text, in whole bits up to MOST_BITS;
    0 for runs that the battery rejects."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), t.code + 1)
    stay, stay_apart = of([log2(a) for a, _ in rates]), of([log2(b) for _, b in rates])
    change, change_apart = of([log2((1 - a) / 3) for a, _ in rates]), of([log2((1 - b) / 3) for _, b in rates])
    text = (t.n - t.runs - t.double) * stay + t.double * stay_apart + (t.runs - 1 - t.left) * change + t.left * change_apart
    text = text - 2 - t.letters * log2(26) - t.digits * log2(10) - (t.n - t.letters - t.digits)
    bits = F.floor(-of([log2(len(a)) for a in ALPHABETS.values()]) * t.n - text).cast("int")
    return F.when(t.random, F.greatest(F.lit(0), F.least(F.lit(MOST_BITS), bits))).otherwise(0)


def least_bits(rows: DataFrame, rates: list[tuple[float, float]]) -> dict[tuple[int, int], int]:
    """The bits from which on a class of lengths and encodings reports spans, by the Benjamini-Hochberg rule over all of its
    runs; runs that the battery rejects have a p-value of 1. At most MOST_BITS counts for each class come to the driver."""
    each = rows.select(F.explode("tested").alias("t")).groupBy("t.size", "t.code", text_bits(F.col("t"), rates).alias("bits")).agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in {(r["size"], r.code) for r in each}:
        counts = {r.bits: r.n for r in each if (r["size"], r.code) == kind}
        total, hits = sum(counts.values()), 0
        for b in sorted((b for b in counts if b), reverse=True):
            hits += counts[b]
            if 2.0**-b <= FALSE_SHARE * hits / total:
                out[kind] = b
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, spans_by_kind: array of (start, kind, stop), by start and
    then kind, places in code points and stop exclusive.

    A null text is empty and has no spans; a null doc_id is kept; repeated rows are scanned alike; other columns are
    not read; an empty table gives no rows. Spans of the battery that meet a base span are left to it, and segments of a
    run to the run where that is reported.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of_kind = lambda spans, no: F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(no).alias("kind"), s.stop.alias("stop")))
    base = F.array_sort(F.concat(*[of_kind(spans, no) for no, spans in enumerate(base_spans(text))]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"), tested(text).alias("tested"))
    rows = stored(rows.withColumn("tested", apart(F.col("tested"), F.col("base"))), "scanned")
    rates = background(rows)
    least = least_bits(rows, rates)
    lowest = F.array(*[F.lit(least.get((size, code), MOST_BITS + 1)) for size in range(len(CLASSES)) for code in range(len(ALPHABETS))])
    rows = rows.withColumn("hits", F.filter("tested", lambda t: t.random & (text_bits(t, rates) >= F.element_at(lowest, t["size"] * len(ALPHABETS) + t.code + 1))))
    rows = rows.withColumn("more", F.transform(outermost(F.col("hits")), lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind"), t.stop.alias("stop"))))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.stop.cast("string"))), ",")


def digests(scan: DataFrame) -> DataFrame:
    count = lambda no: F.size(F.filter("base", lambda s: s.kind == no)).cast("long")
    return scan.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest(listed("base")).alias("base_sha256"), listed("spans").alias("spans"))
