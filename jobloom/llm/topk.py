"""Exact top-k search by inner product with vector-approximation files.

Components are integers, floor(64 * x). Distinct vectors lie in blocks; a block's approximation file holds each component
as a cell of a grid of its dimension, in one byte, and the exact vectors stay where they are. Spark pairs blocks of
queries with groups of approximation files; a task scans the files of its group one after another, bounds every score from
below and above, and carries each query's k-th best lower bound from file to file. The bounds of all groups together give
the floor that a candidate's upper bound must reach. Then exact vectors are read in the order of their upper bounds: first
as many as are wanted, and then those whose bound still reaches the k-th score, until the k-th score is certain.

Vectors that are equal are one candidate with its smallest ids, so ties by the thousand are no candidates by the thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

SCALE = 64
#: Cells of each dimension; a cell is one byte.
CELLS = 64
#: Vectors in a block, and blocks that one task scans after another.
BLOCK_ROWS, GROUP_BLOCKS = 4096, 16
#: Bytes of a block of queries, at most, and queries that are multiplied with a file at once. A file goes to every block
#: of queries, so blocks are as large as a task can hold.
QUERY_BYTES, TILE_QUERIES = 64 << 20, 2048


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and q, the integer components; without vectors that are null or hold null or non-finite components."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    sound = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(sound & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("q"))


def distinct_vectors(q: DataFrame, most: int) -> DataFrame:
    """vid, q and ids: each distinct vector with its smallest ids, so many at most, and how often each id has it.

    The limit by rank holds within the tasks that read, before anything is shuffled.
    """
    counted = q.groupBy("q", "vec_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("vec_id"))
    least = counted.withColumn("rank", rank).filter(F.col("rank") <= most)
    return least.groupBy("q").agg(F.collect_list(F.struct("vec_id", "n")).alias("ids")).select(F.monotonically_increasing_id().alias("vid"), "q", "ids")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if column.iloc[0].size else np.zeros((len(column), 0), np.int64)


def _file(rows: pd.DataFrame) -> pd.DataFrame:
    """The approximation file of a block: the cell of each component, and each dimension's least value and cell width."""
    x = _matrix(rows.q)
    low = x.min(axis=0)
    width = np.maximum(-(-(x.max(axis=0) - low + 1) // CELLS), 1)
    cell = ((x - low) // width).astype(np.uint8)
    part = [rows.vid.to_numpy(np.int64).tobytes(), cell.tobytes(), low.tobytes(), width.tobytes()]
    return pd.DataFrame({"dim": [x.shape[1]], "block": [rows.block.iloc[0]], **{k: [v] for k, v in zip(("ids", "data", "low", "width"), part, strict=True)}})


def _exact(rows: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(rows.q)
    return pd.DataFrame({"dim": [x.shape[1]], "block": [rows.block.iloc[0]], "ids": [rows.vid.to_numpy(np.int64).tobytes()], "data": [x.tobytes()], "low": [b""], "width": [b""]})


FILES = "dim int, block long, ids binary, data binary, low binary, width binary"


def blocks(q: DataFrame, rows: int, make) -> DataFrame:
    """One row for each block of so many vectors (vid, q) of one dimension, dealt by hash of vid."""
    sizes = q.groupBy(F.size("q").alias("dim")).count()
    dealt = q.withColumn("dim", F.size("q")).join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vid"), F.ceil(F.col("count") / rows)).cast("long"))
    return dealt.select("dim", "block", "vid", "q").groupBy("dim", "block").applyInPandas(make, FILES)


def bounds(queries: np.ndarray, cell: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the score of each query with the middle of each vector's cells, and how far twice a score can be from it."""
    middle = 2 * (low + cell.astype(np.int64) * width) + width - 1
    largest = 2 * float(np.abs(queries).max(initial=0)) * float(np.abs(middle).max(initial=0) + width.max(initial=0)) * max(1, len(low))
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.object_
    return queries.astype(kind) @ middle.T.astype(kind), np.abs(queries).astype(kind) @ (width - 1).astype(kind)


class Scan:
    """The scan of files for one block of queries; best holds the largest lower bounds of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.best = ids, queries, np.full((len(ids), k), -np.inf, dtype=object if queries.dtype == object else np.float64)

    def read(self, vids: np.ndarray, cell: np.ndarray, low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """query, vid, lower and upper bound (twice the score) of those whose upper bound reaches the floor so far, for
        some of the queries at a time."""
        for first in range(0, len(self.ids), TILE_QUERIES):
            own = slice(first, first + TILE_QUERIES)
            middle, reach = bounds(self.queries[own], cell, low, width)
            k = self.best.shape[1]
            lower = middle - reach[:, None]
            top = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:] if lower.shape[1] > k else lower
            both = np.concatenate([self.best[own], top.astype(self.best.dtype)], axis=1)
            self.best[own] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            upper = middle + reach[:, None]
            i, j = np.nonzero(upper >= self.best[own].min(axis=1)[:, None])
            yield self.ids[own][i], vids[j], lower[i, j].astype(np.int64), upper[i, j].astype(np.int64)


def _scanned(k: int):
    """Rows (dim, qb, vg, block, ids, data, low, width) come by (dim, qb, vg): a block of queries and then files. Files
    whose block of queries is empty, so that no row of it comes, are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = own = None
        for batch in batches:
            for row in batch.to_pylist():
                ids, group = np.frombuffer(row["ids"], np.int64), (row["dim"], row["qb"], row["vg"])
                if row["block"] < 0:
                    own = group
                    scan = Scan(ids, np.frombuffer(row["data"], np.int64).reshape(len(ids), row["dim"]), k)
                elif own == group:
                    cell = np.frombuffer(row["data"], np.uint8).reshape(len(ids), row["dim"])
                    for found in scan.read(ids, cell, np.frombuffer(row["low"], np.int64), np.frombuffer(row["width"], np.int64)):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vid", "lower", "upper"])

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, vid and the score of pairs (query_id, vid, q, x) of vectors of one length each."""
    for batch in batches:
        q, x = batch.column(2), batch.column(3)
        at, values = q.offsets.to_numpy(), (q.values.to_numpy(), x.values.to_numpy())
        base = x.offsets.to_numpy()[0]
        parts = values[0][at[0] : at[-1]] * values[1][base : base + at[-1] - at[0]]
        sums = np.concatenate([[0], np.cumsum(parts)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]])], ["query_id", "vid", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k best rows of vectors for each row of queries (both: vec_id, embedding), but for the query's own id:
    query_id, rank from 1, vec_id, score; ties go to the smaller vec_id.

    Rows with a null id, and vectors that are null or hold null or non-finite components, take no part; vectors are
    compared with those of the same dimension. Rows that repeat an id are candidates each for themselves; of queries that
    repeat an id the smallest vector counts. Scores are exact while they are below 2**62. Fewer than k candidates give
    fewer rows, and an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    # One more than k vectors, as the query's own may be among them.
    most = k + 1
    x = stored(distinct_vectors(quantised(vectors), most), "vectors")
    q = stored(quantised(queries).groupBy(F.col("vec_id").alias("vid")).agg(F.min("q").alias("q")), "queries")
    files = stored(blocks(x.select("vid", "q"), BLOCK_ROWS, _file), "files")
    # Enough blocks of queries for all cores; more than QUERY_BYTES are never in one.
    many, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    each = max(1, min(QUERY_BYTES // (8 * max(1, dim)), -(-many // spark.sparkContext.defaultParallelism)))
    asked = stored(blocks(q, each, _exact), "asked")
    count = lambda d, name, n: d.groupBy("dim").agg(F.floor(F.max("block") / n).alias(name))
    every = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), F.col(last)))
    names = ["dim", "qb", "vg", "block", "ids", "data", "low", "width"]
    left = asked.join(count(files, "last", GROUP_BLOCKS), "dim").withColumn("vg", every("last")).withColumn("qb", F.col("block")).withColumn("block", F.lit(-1).cast("long"))
    right = files.join(count(asked, "last", 1), "dim").withColumn("qb", every("last")).withColumn("vg", F.floor(F.col("block") / GROUP_BLOCKS))
    pairs = left.select(*names).unionByName(right.select(*names)).repartition("dim", "qb", "vg").sortWithinPartitions("dim", "qb", "vg", "block")
    near = stored(pairs.mapInArrow(_scanned(most), "query_id long, vid long, lower long, upper long"), "near")

    by_query = lambda *order: Window.partitionBy("query_id").orderBy(*order)
    floors = near.withColumn("rank", F.row_number().over(by_query(F.col("lower").desc(), "vid"))).filter(F.col("rank") == most).select("query_id", F.col("lower").alias("floor"))
    able = near.join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    able = stored(able.withColumn("rank", F.row_number().over(by_query(F.col("upper").desc(), "vid"))).select("query_id", "vid", "upper", "rank"), "able")

    def read(wanted: DataFrame) -> DataFrame:
        both = wanted.select("query_id", "vid").join(q.select(F.col("vid").alias("query_id"), F.col("q").alias("a")), "query_id").join(x.select("vid", F.col("q").alias("b")), "vid")
        return both.select("query_id", "vid", "a", "b").mapInArrow(_scores, "query_id long, vid long, score long")

    first = stored(read(able.filter(F.col("rank") <= most)), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"))
    rest = able.filter(F.col("rank") > most).join(kth, "query_id").filter(F.col("upper") >= 2 * F.col("least"))
    scored = first.unionByName(read(rest)).join(x.select("vid", "ids"), "vid").select("query_id", "score", F.explode("ids").alias("i"))
    rows = scored.filter(F.col("i.vec_id") != F.col("query_id")).select("query_id", "score", "i.vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("i.n"), F.lit(k)))))
    rank = F.row_number().over(by_query(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def queries_of(vectors: DataFrame, every: int = 20) -> DataFrame:
    return vectors.filter(F.col("vec_id") % every == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
