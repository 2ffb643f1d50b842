"""Packing tokenised documents into sequences of a bounded length by best-two-fit.

Only the lengths matter for the packing, and there are at most as many lengths as tokens in a sequence. So the counts by
length are enough to plan all bins, and the plan's size depends on the sequence length alone: a bin is filled greedily
with the largest document that fits; then its smallest document gives way to two unpacked documents if they fit the
expanded gap more tightly; and the bin is repeated as long as the counts allow. Spark ranks the documents within each
length and gives each rank its place in the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .prefix import buckets_for, running_total

SEQUENCE_TOKENS = 2048
#: The id that ends each document.
END_ID = 0
#: Long texts are encoded in parts of about so many characters.
PART_CHARS = 1 << 20
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_encoders: dict = {}


class Encoder:
    """Token ids of the public 50k byte-level vocabulary.

    tiktoken has the same merges as the tokenizers file and is about four times faster. Texts with characters beyond
    U+024F, whose classes could differ between the two libraries' Unicode versions, and texts that hold the special
    token's string go to tokenizers itself.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def part(self, text: str, plain: bool) -> np.ndarray:
        ids = self.fast.encode_ordinary(text) if plain else self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4")

    def __call__(self, text: str, raw: bytes) -> np.ndarray:
        """Ids of the whole text and the id that ends it. raw: the text in UTF-8; its lead bytes tell the characters."""
        plain = (not raw or int(np.frombuffer(raw, np.uint8).max()) <= 0xC9) and "<|endoftext|>" not in text
        parts, at = [], 0
        while plain and len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
            # Words never span a space between two letters, so both sides get the ids that they get together.
            parts.append(self.part(text[at : cut.start()], plain))
            at = cut.start()
        parts.append(self.part(text[at:], plain))
        return np.concatenate([*parts, np.array([END_ID], dtype="<u4")])


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(json_path, ranks_path)
    return _encoders[key]


def _pieces(tokens: int, paths: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = encode(text, text.encode("utf-8", "surrogatepass"))
                first = (len(ids) - 1) % tokens + 1
                edges = [0, *range(first, len(ids) + 1, tokens)]
                rows += [(doc_id.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan_bins(counts: dict[int, int], tokens: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (times, [(length, how many)]): best-two-fit over the counts by length."""
    left = np.zeros(tokens + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    at = np.arange(tokens + 1)
    plan = []

    def largest() -> np.ndarray:
        """For each room, the largest length left that fits in it; 0 if there is none."""
        return np.maximum.accumulate(np.where(left > 0, at, 0))

    while (fits := largest())[tokens]:
        used: dict[int, int] = {}
        room = tokens
        while room and (s := int(fits[room])):
            n = min(int(left[s]), room // s)
            used[s] = used.get(s, 0) + n
            left[s] -= n
            room -= n * s
            if not left[s]:
                fits = largest()
        if room and len(used) + max(used.values()) > 2:
            small = min(used)
            gap = room + small
            a = at[1:gap][left[1:gap] > 0]
            if len(a):
                b = fits[np.minimum(gap - a, a)]
                b = np.where((b == a) & (left[a] < 2), fits[np.maximum(b - 1, 0)], b)
                both = np.where(b > 0, a + b, 0)
                k = int(both.argmax())
                if both[k] > small:
                    used[small] -= 1
                    left[small] += 1
                    for s in (int(a[k]), int(b[k])):
                        used[s] = used.get(s, 0) + 1
                        left[s] -= 1
        used = {s: n for s, n in used.items() if n}
        more = min(int(left[s]) // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= more * n
        plan.append((1 + more, sorted(used.items(), reverse=True)))
    return plan


def _placed(plan: list, tokens: int):
    """Looks up each (length, rank) in the plan: runs of ranks, with how many stand in one sequence."""
    key, first, each, base, offset = [], [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for times, items in plan:
        at = 0
        for s, n in items:
            start = used.get(s, 0)
            key.append((s << 44) + start)
            first.append(start)
            each.append(n)
            base.append(sequence)
            offset.append(at)
            used[s] = start + times * n
            at += s * n
        sequence += times
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    key, first, each, base, offset = (np.array(x, dtype=np.int64)[order] for x in (key, first, each, base, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(n)).to_numpy() for n in ("length", "rank"))
            k = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            turn, place = np.divmod(rank - first[k], each[k])
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base[k] + turn), pa.array(offset[k] + place * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents longer than a sequence are cut; their first piece may be
    shorter. Pieces of one length are ranked by hash, so reruns agree; repeated rows are packed each for itself, and a
    null doc_id is kept as null. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(docs.mapInArrow(_pieces(tokens, (json_path, ranks_path)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    keyed = pieces.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(buckets_for(sum(counts.values())))))
    ranked = running_total(keyed, ["length"], "bucket", ["place", "doc_id", "piece", "start"], F.lit(1), "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(plan_bins(counts, tokens), tokens), schema)
