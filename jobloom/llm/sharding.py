"""Shards of documents along a Hilbert curve, so that files can be pruned by several columns.

Each metadata dimension becomes a cell number of a few bits, the cells of a row become its place on the Hilbert curve, and
rows sorted by that place are cut into runs. Neighbours on the curve are neighbours in every dimension, so a run holds a
small box of values, and a query that asks for some values reads few files, whichever dimensions it names.

Sorting and running totals are a range partitioning of narrow rows (`prefix.ranked`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix
from ._common import forget, keyed, stored

SHARDS = 8
#: Bits of a cell: so many cells, as a power of two, in each dimension.
BITS = 5


def value_cells(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """value and cell: each value of a column, null too, with the cell that the middle of its rows falls into when all
    rows stand by value, null last. Cells of frequent values are far apart, rare neighbours share one."""
    counts = stored(rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("many")), "values")
    total = counts.agg(F.sum("many")).first()[0] or 1
    placed = prefix.ranked(counts, [F.col("value").isNull(), F.col("value")], {"ahead": F.col("many")}, "cells", prefix.ONE_TASK)
    forget(counts)
    return placed.select("value", F.expr(f"(2 * ahead + many) * {1 << bits} div (2 * {total})").cast("int").alias("cell"))


def size_cell(size: Column, bits: int = BITS) -> Column:
    """The octave of a positive number: its length in binary digits."""
    return F.least(F.length(F.bin(size)), F.lit((1 << bits) - 1)).cast("int")


def hilbert(rows: DataFrame, cells: list[str], name: str, bits: int = BITS) -> DataFrame:
    """rows with the place of their cells on the Hilbert curve of that many dimensions, a long.

    By bits from the highest: a set bit of a dimension mirrors the lower bits of the first one, an unset one exchanges
    them with it. A Gray code then undoes what each dimension did to the later ones, and the bits are woven together.
    """
    axes = [f"_x{k}" for k in range(len(cells))]
    rows = rows.withColumns({x: F.col(c).cast("long") for x, c in zip(axes, cells, strict=True)})
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1).cast("long")
        for x in axes:
            on = F.getbit(x, F.lit(level)) == 1
            swap = F.col(axes[0]).bitwiseXOR(F.col(x)).bitwiseAND(low)
            # The first dimension exchanged with itself stays as it is.
            first = F.when(on, F.col(axes[0]).bitwiseXOR(low)).otherwise(F.col(axes[0]).bitwiseXOR(swap))
            rows = rows.withColumns({axes[0]: first} | ({x: F.when(on, F.col(x)).otherwise(F.col(x).bitwiseXOR(swap))} if x != axes[0] else {}))
    for x, y in zip(axes, axes[1:], strict=False):
        rows = rows.withColumn(y, F.col(y).bitwiseXOR(F.col(x)))
    flips = [F.when(F.getbit(axes[-1], F.lit(level)) == 1, F.lit((1 << level) - 1)).otherwise(F.lit(0)).cast("long") for level in range(1, bits)]
    rows = rows.withColumn("_flip", reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0).cast("long")))
    woven = [F.shiftleft(F.getbit(F.col(x).bitwiseXOR(F.col("_flip")), F.lit(level)).cast("long"), len(axes) * level + len(axes) - 1 - k) for level in range(bits) for k, x in enumerate(axes)]
    return rows.withColumn(name, reduce(lambda a, b: a + b, woven)).drop(*axes, "_flip")


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "bytes", bits: int = BITS) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): doc_id, key (a number of the row within docs), size,
    text_crc32, lang, source, law, place (on the curve), shard, slot (from 0 within the shard), grown_shard (null).

    Dimensions are source, lang and the octave of the size in bytes, which is that of the text (null: none) plus 1. Rows
    of one place stand by source, lang, size, checksum and doc_id, null first, so equal texts of a place are together.
    By law `bytes` a row is in the shard where the middle of its bytes falls, so every cut is at most half a document off
    its place; by law `rows` counts differ by one at most. Equal rows may stand either way round. Few or no rows leave
    shards empty. Nothing else of docs is read.
    """
    return _placed(docs, F.monotonically_increasing_id(), shards, law, bits)


def _placed(docs: DataFrame, key: Column, shards: int, law: str, bits: int) -> DataFrame:
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law: {law}")
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    plain = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    sizes = rows = stored(plain, "sizes")
    for c in ("source", "lang"):
        cells = value_cells(rows, c, bits).withColumnRenamed("cell", f"{c}_cell")
        rows = rows.join(cells, F.col(c).eqNullSafe(F.col("value"))).drop("value")
    rows = hilbert(rows.withColumn("size_cell", size_cell(F.col("size"), bits)), ["source_cell", "lang_cell", "size_cell"], "place", bits)
    rows = rows.drop("source_cell", "lang_cell", "size_cell")
    order = [F.col(c) for c in ("place", "source", "lang", "size", "text_crc32", "doc_id")]
    placed = prefix.ranked(rows, order, {"rank": F.lit(1), "start": F.col("size")}, "placed")
    whole = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(1)).alias("total")).first()
    forget(sizes)
    cut = f"(2 * start + size) * {shards} div (2 * {whole['total']})" if law == "bytes" else f"rank * {shards} div {max(1, whole['n'])}"
    out = placed.withColumn("shard", F.expr(cut).cast("int"))
    # One row a shard.
    first = out.groupBy("shard").agg(F.min("rank").alias("first"))
    slots = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return slots.select("doc_id", "key", "size", "text_crc32", "source", "lang", F.lit(law).alias("law"), "place", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def box(column: str) -> list[Column]:
    """The least and the largest value of a column, and how many nulls it has."""
    return [F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max"), F.count_if(F.col(column).isNull()).alias(f"{column}_nulls")]


def boxes(rows: DataFrame, by: str = "shard") -> DataFrame:
    """What a reader prunes by: for each shard its rows, bytes and the range of each dimension."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[c for d in ("source", "lang", "size") for c in box(d)])


def shards_for(boxes_: DataFrame, **wanted: tuple) -> DataFrame:
    """The rows of boxes() that can hold a row with every wanted column within (least, largest)."""
    for c, (low, high) in wanted.items():
        boxes_ = boxes_.filter((F.col(f"{c}_min") <= high) & (F.col(f"{c}_max") >= low))
    return boxes_


def write_shards(docs: DataFrame, path: str, files: int = 4, **options) -> DataFrame:
    """Writes docs, all columns, as Parquet under path/shard=K, up to so many files a shard, each one a run of the curve;
    gives boxes() of the shards.

    Texts are shuffled once, by shard and run; rows are sorted within a file, so row groups can be skipped, too.
    """
    rows = keyed(docs)
    where = _placed(rows.select("row.doc_id", "row.text", "row.source", "row.lang", "key"), F.col("key"), **({"shards": SHARDS, "law": "bytes", "bits": BITS} | options))
    where = stored(where, "places")
    many = where.groupBy("shard").agg(F.count("*").alias("many"))
    run = F.expr(f"slot * {files} div many").alias("run")
    at = where.join(many, "shard").select("key", "shard", "slot", run)
    out = rows.join(at, "key").select("row.*", F.col("shard").alias("shard"), F.col("run").alias("_run"), F.col("slot").alias("_slot"))
    spread = out.repartition(max(1, options.get("shards", SHARDS) * files), "shard", "_run").sortWithinPartitions("shard", "_run", "_slot")
    spread.drop("_run", "_slot").write.partitionBy("shard").parquet(path)
    return boxes(where)


def _sql_hilbert(source: str, cells: list[str], bits: int) -> str:
    """source (a subquery) with the column place, one subquery a step."""
    n = len(cells)
    sql = f"SELECT *, {', '.join(f'CAST({c} AS BIGINT) AS x{k}' for k, c in enumerate(cells))} FROM ({source})"
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(n):
            on = f"(x{k} >> {level}) & 1 = 1"
            swap = f"(xor(x0, x{k}) & {low})"
            put = [f"CASE WHEN {on} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0"] + ([f"CASE WHEN {on} THEN x{k} ELSE xor(x{k}, {swap}) END AS x{k}"] if k else [])
            sql = f"SELECT * REPLACE ({', '.join(put)}) FROM ({sql})"
    for k in range(1, n):
        sql = f"SELECT * REPLACE (xor(x{k}, x{k - 1}) AS x{k}) FROM ({sql})"
    flip = "0"
    for level in range(1, bits):
        flip = f"xor({flip}, CASE WHEN (x{n - 1} >> {level}) & 1 = 1 THEN {(1 << level) - 1} ELSE 0 END)"
    sql = f"SELECT *, CAST({flip} AS BIGINT) AS flip FROM ({sql})"
    woven = " + ".join(f"(((xor(x{k}, flip) >> {level}) & 1) << {n * level + n - 1 - k})" for level in range(bits) for k in range(n))
    return f"SELECT *, {woven} AS place FROM ({sql})"


def _sql_cells(column: str, bits: int) -> str:
    return f"""SELECT {column}, CAST((2 * (sum(many) OVER (ORDER BY {column} NULLS LAST ROWS UNBOUNDED PRECEDING) - many) + many) * {1 << bits} // (2 * sum(many) OVER ()) AS INT) AS {column}_cell
    FROM (SELECT {column}, count(*) AS many FROM documents GROUP BY {column})"""


#: A byte's checksum follows from its eight bits; a text's from its bytes, one after another.
_CRC_TABLE = """SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))"""
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE_SQL = f"""WITH crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, source, lang, coalesce(strlen(text), 0) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
s AS (SELECT doc_id, source, lang, size, CAST({_CRC} AS BIGINT) AS text_crc32 FROM d, crc),
sc AS ({_sql_cells('source', BITS)}), lc AS ({_sql_cells('lang', BITS)}),
c AS (SELECT s.*, source_cell, lang_cell, CAST(least(length(bin(size)), {(1 << BITS) - 1}) AS INT) AS size_cell FROM s JOIN sc ON s.source IS NOT DISTINCT FROM sc.source JOIN lc ON s.lang IS NOT DISTINCT FROM lc.lang),
h AS ({_sql_hilbert('SELECT * FROM c', ['source_cell', 'lang_cell', 'size_cell'], BITS)}),
r AS (SELECT *, sum(size) OVER (ORDER BY place, source NULLS FIRST, lang NULLS FIRST, size, text_crc32, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM h),
p AS (SELECT *, CAST((2 * start + size) * {SHARDS} // (2 * total) AS INT) AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p"""
