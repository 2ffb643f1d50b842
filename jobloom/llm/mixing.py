"""Mixing sources to target weights with a low-discrepancy schedule.

Slot k of the schedule has the point frac(k / golden ratio). Cumulative target weights map the point to a source, so
every stretch of the schedule holds the sources in nearly their target shares. The r-th slot of a source takes the r-th
block of a fixed number of words of that source's documents, which stand in an order shuffled by hash, twice over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix
from ._common import forget, keyed, stored
from .prefix import buckets_for, running_total

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each 100 words of the input.
TOTAL_PERCENT = 150
#: A source gives at most this many times its size.
MOST_REPEATS = 2
BLOCK_WORDS = 1024
#: Cells that points and cumulative weights are joined by, at least.
CELLS = 1024
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """One row for each source: source, source_no, source_size, target.

    Sources share the total by weight. A target stops at most times the source's size; what is above is shared again by
    weight among the others until none is above. With sources by rising size for weight that level is the largest
    quotient of what the earlier ones leave and the weight of the others.
    """
    by_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    numbered = prefix.ranked(by_source, [F.col("source").isNull(), F.col("source")], {"before": F.lit(1)}, "numbered", prefix.ONE_TASK)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    weighed = numbered.select("source", (F.col("before") + 1).alias("source_no"), "source_size", weight.alias("w"), (F.col("source_size") * most).alias("most"))
    rising = prefix.ranked(weighed, [F.col("most") / F.col("w"), F.col("source_no")], {"most_before": F.col("most"), "w_before": F.col("w")}, "rising", prefix.ONE_TASK)
    forget(by_source, numbered)
    size, w = (x or 0 for x in rising.agg(F.sum("source_size"), F.sum("w")).first())
    level = rising.agg(F.max((F.lit(size * percent / 100) - F.col("most_before")) / (F.lit(w) - F.col("w_before")))).first()[0]
    return rising.select("source", "source_no", "source_size", F.least(F.col("most").cast("double"), F.col("w") * F.lit(level or 0.0)).alias("target"))


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: slot, source_no, block (rank of the slot in its source), words.

    A source's slots beyond its target are void; those it lacks come after the others. goals is what targets() returns.
    """
    goals = goals.withColumn("goal", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("goal") / block_words).cast("long"))
    total, words, sources = (x or 0 for x in goals.agg(F.sum("blocks"), F.sum("goal"), F.max("source_no")).first())
    # As many cells as sources, so that a cell has one or two of them, or many that share its few points.
    many = max(CELLS, sources)
    bounds = prefix.ranked(goals.select("source_no", "goal", "blocks"), [F.col("source_no")], {"before": F.col("goal")}, "bounds", prefix.ONE_TASK).filter("blocks > 0")
    bounds = bounds.withColumns({"low": F.col("before") / max(1, words), "high": (F.col("before") + F.col("goal")) / max(1, words)}).drop("before")
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * many), F.least(F.floor(F.col("high") * many), F.lit(many - 1)))))
    width = max(1, buckets_for(total))
    points = goals.sparkSession.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / width).alias("stretch"), ((F.col("id") + 0.5) * GOLDEN % 1).alias("point"))
    hit = points.withColumn("cell", F.floor(F.col("point") * many)).join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    numbered = running_total(hit.select("slot", "stretch", "source_no", "goal", "blocks"), ["source_no"], "stretch", ["slot"], F.lit(1), "block")
    # Two uses: the slots themselves and how many each source has.
    numbered = stored(numbered.select("slot", "source_no", "goal", "blocks", "block"), "slots")
    got = numbered.groupBy("source_no").agg(F.count("*").alias("got"))
    lack = goals.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < blocks")
    more = lack.select(F.lit(total).alias("slot"), "source_no", "goal", "blocks", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
    # Late slots go block by block, one for each source that lacks it.
    slots = numbered.filter("block < blocks").unionByName(more.withColumn("slot", F.col("slot") + F.col("block") * sources + F.col("source_no") - 1))
    return slots.select("slot", "source_no", "block", F.least(F.lit(block_words), F.col("goal") - F.col("block") * block_words).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix itself: slot, source, block, doc_id, begin (a place in the source, passes one after another) and words: what
    each slot of the schedule holds of each document, in the order of slot and begin. Options and rows are as of mixed()."""
    parts, _ = _parts(docs, weights, percent, most, block_words, seed, None)
    return parts.filter("words > 0").select("slot", "source", "block", "doc_id", F.greatest("at", F.col("block") * block_words).alias("begin"), "words")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 7, key: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, first_slot (of
    the mix that holds some of it, null for none) and pieces (that slots hold of it).

    size counts words; a null text has none and is never taken. A null source is a source of its own, after the others.
    Documents stand by hash of doc_id, ties by doc_id and size, so reruns agree; a null doc_id is a value like any
    other, and repeated rows are each taken for themselves. Other columns are not read, but for key, if one is named: a
    number of each row, which breaks ties and is given back. An empty table gives no rows.
    """
    parts, empty = _parts(docs, weights, percent, most, block_words, seed, key)
    taken = parts.groupBy("key", "doc_id", "source", "size", "source_size", "target", "start").agg(
        F.sum("words").cast("long").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"), F.count_if(F.col("words") > 0).alias("pieces")
    )
    out = taken.drop("start").unionByName(empty)
    return out if key else out.drop("key")


def _parts(docs: DataFrame, weights: tuple[int, ...], percent: int, most: int, block_words: int, seed: int, key: str | None) -> tuple[DataFrame, DataFrame]:
    """What each slot takes of each document (words, 0 for none), and the documents without words."""
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (F.col(key) if key else F.lit(0)).cast("long").alias("key")), "sized")
    goals = targets(sized, weights, percent, most)
    slots = schedule(goals, block_words)
    shuffled = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("place", shuffled).withColumn("bucket", F.pmod("place", F.lit(buckets_for(sized.count()))))
    empty = rows.filter("size = 0").select("key", "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("pieces"))
    placed = running_total(rows.filter("size > 0"), ["source_no"], "bucket", ["place", "doc_id", "size", "key"], F.col("size"), "start")
    passes = placed.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.col("start") + p * F.col("source_size"))))
    parts = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    met = parts.join(slots, ["source_no", "block"], "left")
    begin = F.col("block") * block_words
    inside = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), begin + F.coalesce("words", F.lit(0))) - F.greatest(F.col("at"), begin))
    return met.withColumn("words", inside), empty


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each as often as the mix takes it, to the nearest whole number; all columns stay.

    Rows are told apart by keys of their own, so ids may be null or repeat; they stand by a hash of doc_id and text.
    """
    rows = keyed(docs)
    taken = mixed(rows.select(F.col("name").alias("doc_id"), "row.text", "row.source", "key"), key="key", **options)
    times = taken.select("key", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("times")).filter("times > 0")
    return rows.join(times, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
