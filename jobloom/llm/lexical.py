"""Exact ranked lexical search by dense blocked matrix products.

Items are gathered into groups of a bounded vocabulary, and a group's items into blocks, each with a compact vocabulary of
its own terms. Documents are read once a group for their counts of the group's terms. A task then takes a tile of
documents at a time, spreads its impacts over a dense float64 matrix of a tile of terms, and multiplies it with the weights
of a block of items. All factors are whole numbers and a tile of terms is so narrow that no sum reaches 2**53, so products
are exact; sums of several tiles are added as 64-bit integers. Of each product only scores that can still be among an
item's best are looked at, ties included, and a task keeps an item's best between tiles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, chunks, forget, stored, text_bytes

TOP = 10
#: Terms of a group of items, at most, but for one item that has more of its own.
GROUP_TERMS = 1 << 16
#: Items in a block, documents and terms in a tile.
BLOCK_ITEMS, TILE_DOCS, TILE_TERMS = 64, 512, 4096
#: No impact reaches this, as 1000 * tf is less than what it is divided by; no weight does, for any 64-bit count.
IMPACT, WEIGHT = 1_000_000, 1 << 16
#: Bytes that end a term: all of ASCII but digits and letters.
GAP = np.ones(256, dtype=bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NO_ID = np.iinfo(np.int64).max


def exact_width(weight: int = WEIGHT, impact: int = IMPACT) -> int:
    """So many terms can be summed up in float64 without a sum that reaches 2**53."""
    return (2**53 - 1) // (weight * impact)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, with repeats; of letters, only A-Z are lower-cased."""
    return _TERM.findall(text.translate(LOWER.tobytes()))


@dataclass
class Group:
    """A group of items: its vocabulary and, for each block of items, which terms they have (positions in the vocabulary)."""

    vocabulary: dict[bytes, int]
    items: list[list[np.ndarray]] = field(default_factory=list)
    #: Numbers of the blocks' items.
    numbers: list[np.ndarray] = field(default_factory=list)


def items_of(benchmark: DataFrame) -> DataFrame:
    """number, item_id, terms: one row for each item, rows of one item_id together; items without terms are left out."""
    fold = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(fold, F.lit(TERM), F.lit(0))).alias("term"))
    rows = each.distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    return stored(rows.select(F.monotonically_increasing_id().alias("number"), "item_id", "terms"), "items")


def groups_of(items: DataFrame, most: int = GROUP_TERMS, block: int = BLOCK_ITEMS) -> Iterator[Group]:
    """The items in groups of so many terms at most; the driver holds one group at a time, read row by row."""

    def group(rows: list) -> Group:
        vocabulary: dict[bytes, int] = {}
        made = Group(vocabulary)
        for first in range(0, len(rows), block):
            part = rows[first : first + block]
            made.items.append([np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r.terms], np.int64) for r in part])
            made.numbers.append(np.array([r.number for r in part], np.int64))
        return made

    rows, held = [], 0
    for row in items.select("number", "terms").toLocalIterator():
        if rows and held + len(row.terms) > most:
            yield group(rows)
            rows, held = [], 0
        rows.append(row)
        held += len(row.terms)
    if rows:
        yield group(rows)


COUNTS = "doc_id long, n long, ids binary, tfs binary"


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs (32-bit positions of the vocabulary's terms in the text, and how often
    each occurs), for each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for first, last in chunks(at):
                ids, n, which, often = [], [], [], []
                for k in range(first, last):
                    terms = terms_of(data[at[k] : at[k + 1]].tobytes())
                    if not terms:
                        continue
                    hits = np.fromiter((x for x in map(known.get, terms) if x is not None), np.int64)
                    term, tf = np.unique(hits, return_counts=True)
                    ids.append(batch.column(0)[k].as_py())
                    n.append(len(terms))
                    which.append(term.astype(np.uint32).tobytes())
                    often.append(tf.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(which, pa.binary()), pa.array(often, pa.binary())], ["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTS)


def document_frequencies(counts: DataFrame) -> DataFrame:
    """term and df, summed up in the tasks that read first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            more = np.bincount(ids, minlength=len(sums))
            more[: len(sums)] += sums
            sums = more
        term = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(sums[term], pa.int64())], ["term", "df"])

    return counts.select("ids").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def lengths(n: list[int], documents: int, total: int) -> np.ndarray:
    """The weight of each document's length; whole numbers of any size."""
    return np.array([100 - 90 + (90 * x * documents) // total for x in n], dtype=np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The best documents of each item of a block so far: the k-th score and its id decide what may still come in."""

    def __init__(self, items: int, k: int):
        self.k, self.item, self.score, self.doc = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.floor, self.last = np.zeros(items, np.int64), np.full(items, NO_ID)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: one row an item, one column a document. Of equal scores the smaller ids come in."""
        item, at = np.nonzero(scores >= np.maximum(self.floor, 1)[:, None])
        score, doc = scores[item, at], docs[at]
        able = (score > self.floor[item]) | (doc < self.last[item])
        item, score, doc = (np.concatenate(x) for x in ((self.item, item[able]), (self.score, score[able]), (self.doc, doc[able])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = np.flatnonzero(rank == self.k - 1)
        self.floor[item[full]], self.last[item[full]] = score[full], doc[full]


def tiles(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids, lengths, and the row, term and tf of each count, for so many documents at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, docs):
            part = batch.slice(first, docs)
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = part.column(2).to_pylist()
            row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
            yield ids, part.column(1).to_pylist(), row, np.frombuffer(b"".join(raw), np.uint32).astype(np.int64), np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint32)


def compact(items: list[np.ndarray], w: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tiles of a block: sorted terms, and the dense weights of items by terms. Terms of weight 0 add nothing."""
    terms = np.unique(np.concatenate(items))
    terms = terms[w[terms] > 0]
    out = []
    for first in range(0, len(terms), most):
        tile = terms[first : first + most]
        dense = np.zeros((len(items), len(tile)))
        for k, own in enumerate(items):
            hit = own[np.isin(own, tile)]
            dense[k, np.searchsorted(tile, hit)] = w[hit]
        out.append((tile, dense))
    return out


def top_documents(docs: DataFrame, benchmark: DataFrame, top: int = TOP, group_terms: int = GROUP_TERMS, block_items: int = BLOCK_ITEMS, tile_docs: int = TILE_DOCS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item of benchmark (item_id, text) its so many highest scores above 0.

    Documents are rows of docs (doc_id, text); a text without terms, or null, is no document. Equal scores go by doc_id,
    a null one last; repeated rows are documents of their own. Rows of benchmark with one item_id, null included, are one
    item, and a term counts once; an item that matches nothing has no rows, and so has everything where a table is empty.
    Other columns are not read.
    """
    width = min(tile_terms, exact_width())
    items = items_of(benchmark)
    found = None
    for group in groups_of(items, group_terms, block_items):
        part = _group_top(docs, group, top, tile_docs, width)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "number long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(items.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _group_top(docs: DataFrame, group: Group, top: int, tile_docs: int, width: int) -> DataFrame:
    """number, doc_id, score: what each task found best for each item of a group."""
    counts = stored(counted(docs, group.vocabulary), "counts")
    documents, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(group.vocabulary), np.int64)
    for row in document_frequencies(counts).toLocalIterator():
        df[row.term] = row.df
    w = weights(df, documents)
    plan = [(numbers, compact(items, w, width)) for numbers, items in zip(group.numbers, group.items, strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    size = len(group.vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        best = [Best(len(numbers), top) for numbers, _ in blocks]
        place = np.full(size, -1)
        for ids, n, row, term, tf in tiles(batches, tile_docs):
            impact = impacts(tf, lengths(n, documents, total)[row])
            for (numbers, parts), kept in zip(blocks, best, strict=True):
                scores = np.zeros((len(numbers), len(ids)), np.int64)
                for tile, weight in parts:
                    place[tile] = np.arange(len(tile))
                    at = place[term]
                    place[tile] = -1
                    own = at >= 0
                    dense = np.zeros((len(ids), len(tile)))
                    dense[row[own], at[own]] = impact[own]
                    scores += (weight @ dense.T).astype(np.int64)
                kept.add(scores, ids)
        for (numbers, _), kept in zip(blocks, best, strict=True):
            doc = pa.array(kept.doc, mask=kept.doc == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[kept.item]), doc, pa.array(kept.score)], ["number", "doc_id", "score"])

    out = stored(counts.mapInArrow(search, "number long, doc_id long, score long"), "best")
    forget(counts)
    return out


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
k AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM k),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM k) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, total GROUP BY term, docs),
s AS (SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 90 + (90 * f.n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), total GROUP BY q.item_id, f.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
