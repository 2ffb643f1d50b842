"""Rule scoring of postings with an explainable breakdown (gate, six dimensions, salary band, total)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import SALARY_BAND, SALARY_PENALTY

# The default keyword lists.
EXCLUSIONS = ("intern", "internship", "unpaid", "volunteer", "senior sales", "outside sales", "door-to-door")
PRIMARY_ROLES = (
    "community manager", "head of community", "community lead", "discord manager", "discord lead", "community operations",
    "community ops", "community strategy", "growth manager", "growth lead", "head of growth", "growth marketing",
    "growth strategy", "growth operations", "user acquisition", "marketing manager", "marketing lead", "head of marketing",
    "brand manager", "brand lead", "head of brand", "brand strategy", "social media manager", "content manager",
    "content lead", "head of content", "content strategy", "kol manager", "kol lead", "partnerships manager",
    "partnership manager", "ecosystem manager", "ecosystem lead", "head of ecosystem", "business development manager",
    "bd manager", "bd lead", "developer relations", "devrel", "developer advocate", "developer experience",
    "developer marketing", "head of devrel", "chief of staff",
)
SECONDARY_ROLES = (
    "community", "growth", "marketing", "content", "partnerships", "ambassador", "evangelist", "advocate", "ecosystem",
    "discord", "moderator", "moderation", "acquisition", "retention", "activation", "brand", "creative", "editorial",
    "copywriter", "bizdev", "biz dev", "advocacy", "evangelism", "operations",
)
TITLE_PENALTIES = ("engineer", "solidity", "rust developer", "backend developer", "smart contract", "senior full stack", "devops", "sre")
VERTICAL_BOOST = (
    "defi", "rwa", "oracle", "cex", "dex", "layer 1", "layer 2", "l1", "l2", "stablecoin", "blockchain", "web3", "crypto",
    "onchain", "on-chain", "fintech", "payments", "neobank", "banking", "lending", "remittance", "trading platform",
    "brokerage", "artificial intelligence", "machine learning", "ai startup", "ai-powered", "generative ai", "llm",
    "ai platform", "saas", "b2b", "developer tools", "devtools", "api platform", "developer platform",
    "infrastructure platform", "gaming", "video game", "game studio", "gamedev",
)
STAGE_BOOST = (
    "series b", "series c", "profitable", "revenue positive", "top 100", "top 50", "top 20", "backed by", "a16z", "paradigm",
    "sequoia", "pantera", "multicoin", "accel", "y combinator", "lightspeed", "tiger global", "greylock", "benchmark",
    "khosla", "index ventures", "insight partners", "bessemer", "general catalyst", "founders fund",
)
STAGE_NEUTRAL = ("series a", "growing", "funded", "bootstrapped")
STAGE_PENALTY = ("pre-seed", "no funding")
GEO_BOOST = ("remote-first", "latam-friendly", "americas timezone", "latam", "latin america", "south america", "argentina")
GEO_PENALTY = ("on-site only", "asia-only", "europe-only")
CLARITY_BOOST = ("salary range", "compensation range", "team size", "reports to", "kpi", "okr", "responsibilities", "what you'll do")
CLARITY_PENALTY = ("competitive salary", "attractive package")


@dataclass(frozen=True)
class ScoreConfig:
    exclusions: tuple[str, ...] = EXCLUSIONS
    primary: tuple[str, ...] = PRIMARY_ROLES
    secondary: tuple[str, ...] = SECONDARY_ROLES
    title_penalties: tuple[str, ...] = TITLE_PENALTIES
    vertical_boost: tuple[str, ...] = VERTICAL_BOOST
    vertical_penalty: tuple[str, ...] = ()
    tier_scores: dict[int, int] = field(default_factory=lambda: {3: 100, 2: 70, 1: 40})
    tier_default: int = 20
    stage_boost: tuple[str, ...] = STAGE_BOOST
    stage_neutral: tuple[str, ...] = STAGE_NEUTRAL
    stage_penalty: tuple[str, ...] = STAGE_PENALTY
    geo_boost: tuple[str, ...] = GEO_BOOST
    geo_penalty: tuple[str, ...] = GEO_PENALTY
    clarity_boost: tuple[str, ...] = CLARITY_BOOST
    clarity_penalty: tuple[str, ...] = CLARITY_PENALTY
    band: tuple[int, int] = SALARY_BAND
    penalty: int = SALARY_PENALTY


#: Dimension weights, in the order in which they are added up.
WEIGHTS = {"role_fit": 0.30, "vertical_fit": 0.20, "channel_mix": 0.15, "team_stage": 0.15, "geo_timezone": 0.10, "metrics_clarity": 0.10}


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that a text contains, in the order of the list."""
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def first_hit(text: Column, terms: tuple[str, ...]) -> Column:
    return F.try_element_at(hits(text, terms), F.lit(1))


def gate(title: Column, config: ScoreConfig) -> Column:
    """The reason why a title is excluded, or null."""
    return F.concat(F.lit("title-excluded: "), first_hit(F.lower(T.or_empty(title)), config.exclusions))


def _between(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def _signed(sign: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(sign), t))


def _found(text: str, **lists: tuple[str, ...]) -> Column:
    """struct of the terms of each list that a text contains."""
    return F.struct(*[hits(F.col(text), terms).alias(name) for name, terms in lists.items()])


def _dimension(score: Column, reasons: list[Column]) -> Column:
    return F.struct(score.cast("int").alias("score"), F.filter(F.concat(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def role_fit(c: ScoreConfig) -> Column:
    primary, secondary = first_hit(F.col("_title"), c.primary), first_hit(F.col("_title"), c.secondary)
    bad = hits(F.col("_title"), c.title_penalties)
    score = F.when(primary.isNotNull(), 100).when(secondary.isNotNull(), 60).otherwise(0)
    why = F.when(primary.isNotNull(), F.concat(F.lit("primary: "), primary)).otherwise(F.concat(F.lit("secondary: "), secondary))
    return _dimension(_between(score - 30 * F.size(bad)), [F.array(why), _signed("-penalty: ", bad)])


def vertical_fit(c: ScoreConfig) -> Column:
    def rated(h: Column) -> Column:
        n, bad = F.size(h.up), h.down
        score = F.when(n > 0, F.least(F.lit(100), 60 + 10 * n)).otherwise(50) - 20 * F.size(bad)
        return _dimension(_between(score), [F.array(F.when(n > 0, F.concat(F.lit("+boost x"), n.cast("string")))), _signed("-penalty: ", bad)])

    return T.once(_found("_blob", up=c.vertical_boost, down=c.vertical_penalty), rated)


def channel_mix(c: ScoreConfig) -> Column:
    tier = F.coalesce("source_tier", F.lit(0))
    score = reduce(lambda chain, kv: chain.when(tier == kv[0], kv[1]), c.tier_scores.items(), F.when(F.lit(False), 0)).otherwise(c.tier_default)
    return _dimension(score, [F.array(F.concat(F.lit("tier="), tier.cast("string")))])


def team_stage(c: ScoreConfig) -> Column:
    def rated(h: Column) -> Column:
        score = F.greatest(F.lit(0), F.least(F.lit(100), 50 + 20 * F.size(h.up) + 5 * F.size(h.even)) - 20 * F.size(h.down))
        return _dimension(score, [_signed("+", h.up), _signed("-", h.down)])

    return T.once(_found("_blob", up=c.stage_boost, even=c.stage_neutral, down=c.stage_penalty), rated)


def geo_timezone(c: ScoreConfig) -> Column:
    def rated(h: Column) -> Column:
        up = F.try_element_at(h.up, F.lit(1))
        score = F.greatest(F.lit(0), F.when(F.size(h.up) > 0, 65).otherwise(50) - 25 * F.size(h.down))
        return _dimension(score, [F.array(F.concat(F.lit("+"), up)), _signed("-", h.down)])

    return T.once(_found("_blob", up=c.geo_boost, down=c.geo_penalty), rated)


def metrics_clarity(c: ScoreConfig) -> Column:
    listed = (F.coalesce("salary_min_usd", F.lit(0)) != 0) & (F.coalesce("salary_max_usd", F.lit(0)) != 0)

    def rated(h: Column) -> Column:
        score = F.greatest(F.lit(0), F.least(F.lit(100), 30 + 15 * F.size(h.up)) - 10 * F.size(h.down))
        score = F.least(F.lit(100), score + F.when(listed, 20).otherwise(0))
        return _dimension(score, [_signed("+", h.up), _signed("-", h.down), F.array(F.when(listed, F.lit("+salary listed")))])

    return T.once(_found("_blob", up=c.clarity_boost, down=c.clarity_penalty), rated)


#: Dimensions by name, in order; a new one is a function of the config that gives a struct (score, reasons).
DIMENSIONS: dict[str, Callable[[ScoreConfig], Column]] = {
    "role_fit": role_fit, "vertical_fit": vertical_fit, "channel_mix": channel_mix,
    "team_stage": team_stage, "geo_timezone": geo_timezone, "metrics_clarity": metrics_clarity,
}


def band_penalty(c: ScoreConfig) -> Column:
    """struct(value, reason): listed pay, or else pay inferred from the text, that is wholly outside the band."""
    listed = [F.when(F.col(x) > 0, F.col(x)) for x in ("salary_min_usd", "salary_max_usd")]
    guess = F.when(F.coalesce(*listed).isNull(), T.inferred_salary(F.col("_blob")))
    out = lambda word, side, v: F.struct(F.lit(-c.penalty).alias("value"), F.concat(F.lit(f"-{c.penalty} {word}-band: {side}="), v.cast("string")).alias("reason"))
    none = F.struct(F.lit(0).alias("value"), F.lit(None).cast("string").alias("reason"))

    def judged(g: Column) -> Column:
        lo, hi = F.coalesce(listed[0], g["lo"]), F.coalesce(listed[1], g["hi"])
        top, bottom = F.coalesce(hi, lo), F.coalesce(lo, hi)
        return F.when(top < c.band[0], out("below", "max", top)).when(bottom > c.band[1], out("above", "min", bottom)).otherwise(none)

    return T.once(guess, judged)


def prepared(postings: DataFrame) -> DataFrame:
    """_title and _blob, once for all dimensions."""
    return postings.withColumn("_title", F.lower(T.or_empty(F.col("title")))).withColumn("_blob", T.blob(*(F.col(c) for c in ("title", "company", "description", "location"))))


def scored(postings: DataFrame, config: ScoreConfig | None = None) -> DataFrame:
    """postings with score_total and score_breakdown (gate_failed, dimensions, adjustments, total).

    Gated rows stay, with a total of 0 and null dimensions.
    """
    c = config or ScoreConfig()
    rows = prepared(postings).withColumn("_gate", gate(F.col("title"), c)).withColumn("_band", band_penalty(c))
    rows = rows.withColumns({f"_{name}": make(c) for name, make in DIMENSIONS.items()})
    added = reduce(lambda a, name: a + F.col(f"_{name}.score") * F.lit(WEIGHTS[name]), DIMENSIONS, F.lit(0.0))
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(added + F.col("_band.value"), 0).cast("int")))
    rows = rows.withColumn("score_total", F.when(F.col("_gate").isNotNull(), 0).otherwise(total))
    each = F.struct(*[F.struct(F.col(f"_{n}.score").alias("score"), F.lit(WEIGHTS[n]).alias("weight"), F.col(f"_{n}.reasons").alias("reasons")).alias(n) for n in DIMENSIONS])
    band = F.array(F.struct(F.lit("salary band").alias("label"), F.col("_band.value").alias("value"), F.col("_band.reason").alias("reason")))
    breakdown = F.struct(
        F.col("_gate").alias("gate_failed"),
        F.when(F.col("_gate").isNull(), each).alias("dimensions"),
        F.when(F.col("_gate").isNull() & (F.col("_band.value") != 0), band).otherwise(F.array().cast("array<struct<label:string,value:int,reason:string>>")).alias("adjustments"),
        F.col("score_total").alias("total"),
    )
    return rows.withColumn("score_breakdown", breakdown).drop("_title", "_blob", "_gate", "_band", *[f"_{n}" for n in DIMENSIONS])
