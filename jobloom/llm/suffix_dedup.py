"""Removal of repeated passages by two-stage suffix sorting.

A window is a run of WINDOW bytes. Equal windows have equal anchors, so the contexts of one anchor hash hold every
window that could repeat there, and groups of contexts can be sorted apart from each other, whichever documents they
come from. Contexts that are equal as a whole are settled by their names. The distinct contexts of a group are joined,
and their suffix array is built in two stages: suffixes smaller than their successors are sorted directly, all others
are put in place by one scan over the buckets of first bytes; windows whose neighbours in the array share a common
prefix of WINDOW bytes repeat.

A group with very many distinct contexts (a short passage with other neighbours in every document) is not sorted in one
task: its contexts are split by the distance of their windows to the anchor, and the parts grouped anew by the bytes that
all windows of a part have in common. Only where a part is still in a very large group are its few windows, which differ
in their outermost bytes, counted one by one by name; that is exact too and spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, stored, text_bytes
from .anchors import contexts

WINDOW = 200
#: Bytes of text that are looked at together, and of contexts that are sorted together.
PIECE, SORTED_TOGETHER = 1 << 20, 1 << 18
#: Distinct contexts of a group that is sorted in one task.
GROUP_CONTEXTS = 256
#: Windows of a part of a context.
PART = 16


def suffix_order(text: bytes, depth: int) -> list[int]:
    """The suffixes of text in the order of their first depth bytes, or further."""
    a = np.frombuffer(text, np.uint8)
    n = len(a)
    if not n:
        return []
    # Whether each suffix is smaller than its successor: told by the next byte that differs.
    change = np.append(np.flatnonzero(a[1:] != a[:-1]), n - 1)
    at = change[np.searchsorted(change, np.arange(n))]
    rises = np.append(a, 0).astype(np.int16)[at] < np.append(a, 0)[at + 1]
    rises[at == n - 1] = False
    direct = np.flatnonzero(rises).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    total, risen = np.bincount(a, minlength=256), np.bincount(a[rises], minlength=256)
    begin = np.cumsum(total) - total
    order = np.full(n, -1, dtype=np.int64)
    first = a[direct] if direct else a[:0]
    order[np.arange(len(direct)) + (np.cumsum(total - risen))[first]] = direct
    # Induction: the successor's place fixes the place of each larger suffix in its bucket.
    sa, front, byte, up = order.tolist(), begin.tolist(), a.tolist(), rises.tolist()
    up.append(True)
    c = byte[-1]
    sa[front[c]] = n - 1
    front[c] += 1
    for i in range(n):
        j = sa[i] - 1
        if not up[j]:
            c = byte[j]
            sa[front[c]] = j
            front[c] += 1
    return sa


def common_prefixes(text: bytes, order: np.ndarray, depth: int, step: int = 4096) -> np.ndarray:
    """The bytes that each suffix has in common with the next one in the order, depth at most; all have so many bytes."""
    if len(order) < 2:
        return np.zeros(0, np.int64)
    heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), depth)
    out = []
    for k in range(0, len(order) - 1, step):
        part = heads[order[k : k + step + 1]]
        differ = part[1:] != part[:-1]
        out.append(np.where(differ.any(axis=1), differ.argmax(axis=1), depth))
    return np.concatenate(out)


def repeated(group: list[tuple[bytes, int]], window: int) -> list[np.ndarray]:
    """For each (context, count of windows): which of its windows occur elsewhere among the contexts."""
    text = b"\xff".join(c for c, _ in group)
    begin = np.cumsum([0, *(len(c) + 1 for c, _ in group[:-1])])
    starts = np.zeros(len(text), dtype=bool)
    for b, (_, n) in zip(begin, group, strict=True):
        starts[b : b + n] = True
    order = np.array(suffix_order(text, window), dtype=np.int64)
    order = order[starts[order]]
    common = common_prefixes(text, order, window) >= window
    hit = np.zeros(len(text), dtype=bool)
    hit[order[1:][common]] = hit[order[:-1][common]] = True
    return [hit[b : b + n] for b, (_, n) in zip(begin, group, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _segments(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text, begin, end) of pieces that together hold each window once; long texts are cut with an overlap."""
    for a, b in chunks(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo > 2 * PIECE and b == a + 1:
            for k in range(lo, max(lo + 1, hi - window + 1), PIECE):
                end = min(k + PIECE + window - 1, hi)
                yield data[k:end], np.array([a]), np.array([0]), np.array([end - k]), k - lo
        else:
            own = np.flatnonzero(offsets[a + 1 : b + 1] > offsets[a:b]) + a
            yield data[lo:hi], own, offsets[own] - lo, offsets[own + 1] - lo, 0


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for part, own, begin, end, shift in _segments(data, offsets, window):
                text, first, count, name, anchor = contexts(part, begin, end, window)
                raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
                whole = np.fromiter((digest(raw[s : s + n + window - 1]) for s, n in zip(first.tolist(), count.tolist(), strict=True)), np.uint64, len(first))
                cols = [name.view(np.int64), whole.view(np.int64), keys[own[text]], first - begin[text] + shift, count.astype(np.int32), (anchor - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "c", "key", "first", "count", "off"])

    return run


def _fetched(window: int):
    """The bytes of the contexts that are wanted from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            out: list[tuple] = []
            held = 0
            for k, wanted in enumerate(batch.column(1)):
                base = int(offsets[k])
                for w in wanted.as_py():
                    at = base + w["first"]
                    out.append((w["h"], w["c"], w["n"], w["count"], w["off"], data[at : at + w["count"] + window - 1].tobytes()))
                    held += w["count"] + window
                if held > 4 << 20 or k == len(batch) - 1:
                    cols = list(zip(*out, strict=True)) or [[]] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "c", "n", "count", "off", "bytes"])
                    out, held = [], 0

    return run


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_groups(window: int):
    """Rows come by h. Whole groups are sorted together until there are enough bytes."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        hits = [runs(f) for f in repeated([(b, n) for _, _, n, b in rows], window)] if rows else []
        kept = [(h, c, [{"a": a, "b": b} for a, b in r]) for (h, c, _, _), r in zip(rows, hits, strict=True) if r]
        cols = list(zip(*kept, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], SPANS)], ["h", "c", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held > SORTED_TOGETHER and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        yield solve(rows)

    return run


def _parts(window: int):
    """Contexts cut by the distance of their windows to the anchor; a part's group is named by what its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "n", "count", "off", "bytes", "owner_h", "owner_c", "shift"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        digest = lambda b, seed: xxhash.xxh3_64_intdigest(b, seed) - 2**63
        for batch in batches:
            out: list[tuple] = []
            for h, c, n, off, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for q in range((off - n + 1) // PART, off // PART + 1):
                    low, high = max(0, off - PART * q - PART + 1), min(n - 1, off - PART * q)
                    core = b[off - PART * q : off - PART * q - PART + 1 + window]
                    part = b[low : high + window]
                    out.append((digest(h.to_bytes(8, "little", signed=True) + bytes([q]) + core, 3), digest(part, 4), 1, high - low + 1, 0, part, h, c, low))
            cols = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names)

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, c, n, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(h, c, k, xxhash.xxh3_64_intdigest(b[k : k + window]) - 2**63) for k in range(n)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["h", "c", "k", "w"])

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out, kept = [], []
            spans = batch.column(2)
            for k in range(len(batch)):
                text = data[offsets[k] : offsets[k + 1]]
                own = spans[k].as_py() or []
                step = np.zeros(len(text) + 1, dtype=np.int32)
                for s in own:
                    step[s["a"]] += 1
                    step[min(s["b"] + window - 1, len(text))] -= 1
                gone = np.cumsum(step[:-1]) > 0
                left = text[~gone].tobytes() if own else text.tobytes()
                n_spans = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
                out.append((len(text), int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest()))
                kept.append(left)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


SPAN_TYPE = "array<struct<a:int,b:int>>"


def _whole(contexts_: DataFrame) -> DataFrame:
    """Verdicts of contexts that occur several times: all their windows repeat."""
    return contexts_.filter("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("count").alias("b"))).cast(SPAN_TYPE).alias("spans"))


def _open_groups(distinct: DataFrame) -> DataFrame:
    """Groups with several contexts of which one at least is not settled by its name."""
    groups = distinct.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1")
    return stored(groups.select("h", (F.col("k") > GROUP_CONTEXTS).alias("hot")), "groups")


def _settled(distinct: DataFrame, groups: DataFrame, window: int, parts: bool) -> DataFrame:
    """h, c and spans of repeated windows, for distinct contexts (h, c, n, count, off, bytes) of open groups."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = distinct.join(groups.filter("NOT hot").select("h"), "h").select("h", "c", "count", "bytes").repartition(tasks, "h").sortWithinPartitions("h", "c")
    found = cold.mapInArrow(_sorted_groups(window), f"h long, c long, spans {SPAN_TYPE}")
    hot = distinct.join(groups.filter("hot").select("h"), "h")
    if parts:
        schema = "h long, c long, n long, count int, off int, bytes binary, owner_h long, owner_c long, shift int"
        cut = stored(hot.select("h", "c", "count", "off", "bytes").mapInArrow(_parts(window), schema), "parts")
        inner = stored(cut.groupBy("h", "c").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("count", "off", "bytes"))), "distinct_parts")
        verdict = stored(_whole(inner).unionByName(_settled(inner, _open_groups(inner), window, False).join(inner.filter("n = 1").select("h", "c"), ["h", "c"], "left_semi")), "verdict_parts")
        shifted = F.transform("spans", lambda s: F.struct((s.a + F.col("shift")).alias("a"), (s.b + F.col("shift")).alias("b")))
        more = cut.join(verdict, ["h", "c"]).select(F.col("owner_h").alias("h"), F.col("owner_c").alias("c"), shifted.alias("spans"))
    else:
        single = stored(hot.select("h", "c", "count", "bytes").mapInArrow(_windows(window), "h long, c long, k int, w long"), "windows")
        twice = stored(single.groupBy("h", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "w"), "twice")
        more = single.join(twice, ["h", "w"]).select("h", "c", F.array(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("spans"))
    return found.unionByName(more)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key and spans (a, b) of keyed texts (key, text): the windows that start at a, ..., b - 1 start elsewhere too."""
    found = docs.select("key", "text").mapInArrow(_contexts(window), "h long, c long, key long, first long, count int, off int")
    again = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "again")
    live = stored(found.join(again, "h"), "live")
    distinct = live.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "count", "off")).alias("one"))
    distinct = stored(distinct.select("h", "c", "n", "one.*"), "distinct")
    groups = _open_groups(distinct)
    wanted = distinct.join(groups.select("h"), "h").groupBy("key").agg(F.collect_list(F.struct("h", "c", "n", "first", "count", "off")).alias("wanted"))
    fetched = docs.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(_fetched(window), "h long, c long, n long, count int, off int, bytes binary")
    fetched = stored(fetched, "contexts")
    single = distinct.filter("n = 1").select("h", "c")
    verdict = stored(_whole(distinct).unionByName(_settled(fetched, groups, window, True).join(single, ["h", "c"], "left_semi")), "verdict")
    placed = live.join(verdict, ["h", "c"]).select("key", F.explode(F.transform("spans", lambda s: F.struct((F.col("first") + s.a).alias("a"), (F.col("first") + s.b).alias("b")))).alias("s"))
    return placed.groupBy("key").agg(F.collect_list("s").alias("spans"))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Texts are UTF-8 bytes; a null text is empty. Every byte that a window covers which also starts anywhere else, in
    the same text or another, is removed; matches never cross texts, and windows are compared as they came in. Rows
    that repeat doc_id and text are texts of their own, so their long texts go as a whole. A null doc_id is kept. Other
    columns are not read, and an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = stored(docs.withColumn("key", F.monotonically_increasing_id()), "keyed")
    marked = docs.join(stored(repeats(docs, window), "repeats"), "key", "left")
    return marked.select("doc_id", "text", "spans").mapInArrow(_removed(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digests(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
