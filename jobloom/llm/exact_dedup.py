"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer name by sorting the distinct
blocks of each partition; then adjacent names are paired and the pairs named in the same way, until one name is left for each text. Two
texts have the same last name exactly when they are equal, as a name stands for one sequence of bytes.

A block that occurs once in the whole corpus can't be in two texts, so its text is alone and leaves before the naming:
hashes of all blocks are counted first, and only texts whose every block hash occurs again are named by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, keyed, only, same, stored

#: Bytes of a block.
BLOCK_BYTES = 4096


def _lowered(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and normalised bytes; bytes.lower() changes A-Z only."""
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
        yield doc_id, (text or b"").lower()


def _hash_blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sha, whole, blocks = [], [], [], []
            for doc_id, text in _lowered(batch):
                ids.append(doc_id)
                sha.append(hashlib.sha256(text).hexdigest())
                whole.append(xxhash.xxh3_64_intdigest(text) - 2**63)
                blocks.append([xxhash.xxh3_64_intdigest(text[k : k + size], seed=1) - 2**63 for k in range(0, max(1, len(text)), size)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sha), pa.array(whole, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], ["doc_id", "text_sha256", "whole", "blocks"])

    return run


def _cut_blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole, pos, block, held = [], [], [], [], 0
            names = ["doc_id", "whole", "pos", "block"]
            pack = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole, pa.int64()), pa.array(pos, pa.int64()), pa.array(block, pa.binary())], names)  # noqa: B023, E731
            for doc_id, text in _lowered(batch):
                key = xxhash.xxh3_64_intdigest(text) - 2**63
                for k in range(0, max(1, len(text)), size):
                    ids.append(doc_id)
                    whole.append(key)
                    pos.append(k // size)
                    block.append(text[k : k + size])
                held += len(text)
                if held > 4 << 20:
                    yield pack()
                    ids, whole, pos, block, held = [], [], [], [], 0
            yield pack()

    return run


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Integer names: a partition's number and the rank in its sorted order. Equal keys are in one partition."""
    return stored(distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A null text is empty, and all empty texts are equal. Columns beside doc_id and text are not read. Rows that repeat
    both doc_id and text count in group_size and are kept or dropped together. A null doc_id is a row of its own group
    of texts and stays only where no other row has that text. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_hash_blocks(block_bytes), "doc_id long, text_sha256 string, whole long, blocks array<long>"), "rows")
    blocks = rows.select("doc_id", "whole", F.size("blocks").alias("n"), F.explode("blocks").alias("h"))
    again = stored(blocks.groupBy("h").count().filter("count > 1").select("h"), "again")
    open_rows = blocks.join(again, "h", "left_semi").groupBy("doc_id", "whole", "n").count().filter("count >= n")
    # Rows that repeat an id and a text count more than n blocks; they share one key below, so the key is enough.
    keys = stored(open_rows.select("doc_id", "whole", "n"), "open").alias("k")

    texts = docs.alias("d").join(keys.select("doc_id").distinct().alias("i"), same(F.col("d.doc_id"), F.col("i.doc_id")), "left_semi")
    cut = texts.mapInArrow(_cut_blocks(block_bytes), "doc_id long, whole long, pos long, block binary")
    names = _named(cut.groupBy("block").agg(F.count("*").alias("n")).select("block"), "block")
    level = stored(cut.join(names, "block").select("doc_id", "whole", "pos", "name").distinct(), "level")
    forget(names, again)
    longest = keys.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        half = F.floor(F.col("pos") / 2).cast("long")
        pairs = level.groupBy("doc_id", "whole", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = _named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b"), "a", "b")
        before, level = level, stored(pairs.join(names, ["a", "b"]).select("doc_id", "whole", "pos", "name"), "level")
        forget(before, names)
        longest = (longest + 1) // 2

    identity = level.select("doc_id", "whole", "name").alias("v")
    r = rows.select("doc_id", "whole").alias("r")
    counted = r.join(identity, same(F.col("r.doc_id"), F.col("v.doc_id")) & (F.col("r.whole") == F.col("v.whole"))).select("r.doc_id", "r.whole", "name")
    groups = stored(counted.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    shared = stored(level.join(groups, "name").select("doc_id", "whole", "keep_id", "group_size"), "shared").alias("s")
    out = rows.alias("r").join(shared, same(F.col("r.doc_id"), F.col("s.doc_id")) & (F.col("r.whole") == F.col("s.whole")), "left")
    keep = F.coalesce(F.col("s.keep_id"), F.col("r.doc_id"))
    return out.select(
        F.col("r.doc_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce(F.col("s.group_size"), F.lit(1)).cast("long").alias("group_size"),
        same(F.col("r.doc_id"), keep).alias("kept"),
        F.col("r.text_sha256").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with one row for each text, the one with the largest doc_id; all columns stay.

    A null doc_id comes after all others. Rows are told apart by keys of their own, so ids may be null or repeat.
    """
    rows = keyed(docs)
    groups = exact_groups(rows.select(F.col("key").alias("doc_id"), "row.text"), block_bytes).filter("group_size > 1")
    best = F.max(F.struct("doc_id", "name", "key"))["key"]
    return only(rows, groups.select(F.col("doc_id").alias("key"), F.col("keep_id").alias("of")), best)


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
