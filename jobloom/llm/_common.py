"""Shared helpers: tables, scratch tables in the shared folder, and byte-level access to Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
WORD_GAP = np.zeros(256, dtype=bool)
WORD_GAP[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Folders of the tables that stored() wrote.
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="jobloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/jobloom-{uuid.uuid4().hex[:12]}/{name}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that stored() wrote, once nothing reads them any more."""
    for table in tables:
        if path := _paths.pop(table, None) if table is not None else None:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def keyed(docs: DataFrame) -> DataFrame:
    """key, name, row: docs with a key of its own for each row, written once, so decisions can be carried by it.

    name is a hash of doc_id and text, the same in each run; row holds all columns, whatever their names.
    """
    name = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(docs.select(F.monotonically_increasing_id().alias("key"), name.alias("name"), F.struct("*").alias("row")), "keyed")


def only(rows: DataFrame, groups: DataFrame, best) -> DataFrame:
    """The rows of keyed() that come first in their group, or are in none; all columns of docs.

    groups (key, of): the groups, rows of none may lack. best makes an aggregate of key out of the columns key, name and doc_id.
    """
    groups = stored(groups, "groups")
    ids = rows.select("key", "name", F.col("row.doc_id").cast("long").alias("doc_id"))
    first = groups.join(ids, "key").groupBy("of").agg(best.alias("key")).select("key")
    gone = stored(groups.select("key").join(first, "key", "left_anti"), "gone")
    forget(groups)
    return rows.join(gone, "key", "left_anti").select("row.*")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without a copy; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
