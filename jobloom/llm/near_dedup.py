"""Near-duplicate groups by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and its maximum, so a signature of a given
length costs half the hash evaluations. A band joins both values of two permutations; texts that share a band are
candidates, and a link needs the exact Jaccard similarity of the full shingle sets. Texts with the same set are one
node. Within a bucket, members are first compared with a random member of another component, which joins groups of
copies of any size. Members that are still apart are held against all others of their buckets by sketches: the parity of
the shingles that fall on each of a few bits. Where two sketches differ, the sets differ, so they bound the similarity
from above; only pairs within the bound are confirmed on their texts, and no link is lost. The closest member of each
other component is tried first, so a group of copies is joined before all pairs that are left are looked at. Large buckets
are dealt in blocks of so many bytes of sketches, and texts go to no block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, keyed, only, same, stored, text_bytes
from .shingles import mix, shingle_sets

#: 32 bands of two permutations (four values): a pair at similarity 0.8 misses all of them once in 10**7 times.
BANDS = 32
PERMUTATIONS_PER_BAND = 2
#: Rounds of comparing with random members, before the members that are apart are compared by their sketches.
STAR_ROUNDS = 2
#: Bytes of sketches in a block of a bucket.
BLOCK_BYTES = 1 << 20
#: So many links that are left are joined in one task.
LAST_LINKS = 1 << 14


def signature(shingles: np.ndarray, factors: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the shingles under each permutation x -> factor * x modulo 2**32."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(factors), 2**32 - 1, np.uint32), np.zeros(len(factors), np.uint32)
    for k in range(0, len(x), step):
        v = factors[:, None] * x[None, k : k + step]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of the shingles on each of 2**k bits, at least eight for each shingle. Halves fold to half the bits."""
    size = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _sign(words: int, bands: int, per_band: int):
    factors = np.random.default_rng(4711).integers(0, 2**31, bands * per_band, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            count, name, out = [], [], np.zeros((len(batch), bands), np.int64)
            for k, s in enumerate(shingle_sets(data, offsets, words)):
                count.append(len(s))
                name.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low, high = signature(s, factors)
                    both = (low.astype(np.uint64) << np.uint64(32) | high).reshape(bands, per_band)
                    band = salt.copy()
                    for j in range(per_band):
                        band = mix(band * np.uint64(0x9FB21C651E98DF25) + both[:, j])
                    out[k] = band.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bands), pa.array(out.ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(name, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_name", "n_shingles", "set_name", "bands"])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, at_left), (right, at_right) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            keep = []
            for a, b in zip(shingle_sets(left, at_left, words), shingle_sets(right, at_right, words), strict=True):
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [sketch(s) for s in shingle_sets(*text_bytes(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["rep", "bits"])

    return run


#: What a member of a bucket is in a block: compared with others, compared by others, beside the bucket's main component.
LEFT, RIGHT, BESIDE = 1, 2, 4


def near_pairs(side: np.ndarray, rep: np.ndarray, label: np.ndarray, n: np.ndarray, bands: np.ndarray, here: int, bits: list[np.ndarray], percent: int, best: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of members of one block, of different labels, whose sketches leave room for their similarity: all of
    them, or each member's closest one of each label. A pair counts in the first band that it shares only; here is the
    block's."""
    wide = np.array([len(b) for b in bits])
    for w in np.unique(wide).tolist():
        at = np.flatnonzero((wide == w) | (wide == 2 * w))
        at = at[np.argsort(n[at], kind="stable")]
        left, right = at[(side[at] & LEFT) > 0], at[(side[at] & RIGHT) > 0]
        if not len(left) or not len(right):
            continue
        whole = {int(k): bits[k] if wide[k] == w else bits[k][:w] ^ bits[k][w:] for k in at}
        table = np.stack([whole[int(k)] for k in right]).view(np.uint64)
        names = label[right]
        size, owner, beside, wider = n[right], rep[right], (side[right] & BESIDE) > 0, wide[right] > w
        first = np.searchsorted(size, -(-percent * n[left] // 100), "left")
        last = np.searchsorted(size, 100 * n[left] // percent, "right")
        for k, a, b in zip(left.tolist(), first.tolist(), last.tolist(), strict=True):
            if a >= b:
                continue
            apart = np.bitwise_count(table[a:b] ^ whole[k].view(np.uint64)).sum(axis=1, dtype=np.int64)
            both = size[a:b] + n[k]
            ok = ((100 + percent) * (both - apart) >= 2 * percent * both) & (names[a:b] != label[k]) & (~beside[a:b] | (owner[a:b] > rep[k]))
            if wide[k] > w:
                ok &= ~wider[a:b]
            hits = np.flatnonzero(ok)
            if len(hits):
                shared = bands[right[a + hits]] == bands[k]
                hits = hits[bands[k][shared.argmax(axis=1)] == here]
            if len(hits):
                if best:
                    hits = hits[np.argsort(apart[hits], kind="stable")]
                    hits = hits[np.unique(names[a + hits], return_index=True)[1]]
                hit = owner[a + hits]
                yield np.minimum(hit, rep[k]), np.maximum(hit, rep[k])


def _compared(percent: int, best: bool):
    """Rows (h, i, j, side, rep, label, n, bands, bits) come by block (h, i, j); its pairs that may be similar leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
            h, side, rep, label, n = (rows.column(k).to_numpy() for k in (0, 3, 4, 5, 6))
            bands = rows.column(7).flatten().to_numpy().reshape(len(rows), -1)
            data, offsets = text_bytes(rows.column(8))
            found, begin = [(np.zeros(0, np.int64),) * 2], 0
            for end in ends.tolist():
                if end - begin > 1:
                    bits = [data[offsets[k] : offsets[k + 1]] for k in range(begin, end)]
                    part = (x[begin:end] for x in (side, rep, label, n, bands))
                    found += near_pairs(*part, h[begin], bits, percent, best)
                begin = end
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            keys = [batch.column(k).to_numpy() for k in range(3)]
            for c in keys:
                new[1:] |= c[1:] != c[:-1]
            new[0] = bool(held) and any(c[0] != held[-1].column(k)[-1].as_py() for k, c in enumerate(keys))
            starts = np.flatnonzero(new)
            if len(starts):
                rows = pa.concat_batches([*held, batch.slice(0, int(starts[-1]))])
                yield solve(rows, np.append(starts[:-1], starts[-1]) + len(rows) - int(starts[-1]))
                held = [batch.slice(int(starts[-1]))]
            else:
                held.append(batch)
        if held:
            rows = pa.concat_batches(held)
            yield solve(rows, np.array([len(rows)]))

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the few links (a, b) of one task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root): each node's smallest node that it reaches. Nodes hook to their smallest neighbour, then edges are
    drawn between hooks; at least half of the nodes of a component that is still open go in each round. When no more than
    LAST_LINKS edges are left, one task joins them."""
    edges = stored(edges.select("a", "b"), "edges")
    roots = None
    while edges.count() > LAST_LINKS:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("r")), "hook")
        before = (edges, roots)
        if roots is None:
            roots = stored(hook.select(F.col("u").alias("node"), F.col("r").alias("root")), "roots")
        else:
            roots = stored(roots.join(hook, F.col("root") == F.col("u"), "left").select("node", F.coalesce("r", "root").alias("root")), "roots")
        half = edges.join(hook, F.col("a") == F.col("u")).select(F.col("r").alias("x"), "b")
        moved = half.join(hook, F.col("b") == F.col("u")).select("x", F.col("r").alias("y"))
        edges = stored(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(hook, *before)
    last = edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    if roots is None:
        return last
    last = last.select(F.col("node").alias("u"), F.col("root").alias("r"))
    return roots.join(last, F.col("root") == F.col("u"), "left").select("node", F.coalesce("r", "root").alias("root"))


def _similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, per_band: int = PERMUTATIONS_PER_BAND) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * intersection >= percent * union over their distinct shingles of so many words; with
    fewer words the whole sequence is one shingle. A null text, or one without words, has no shingle and no link.
    component_id is the smallest doc_id that links reach; kept is doc_id = component_id. Other columns are not read.
    Rows that repeat a doc_id have the links of their own texts; equal rows get equal results. A row without doc_id has
    no link and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_name"), "text")
    schema = "doc_id long, text_name long, n_shingles long, set_name binary, bands array<long>"
    rows = stored(docs.mapInArrow(_sign(words, bands, per_band), schema), "signatures")
    sets = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_name").agg(
        F.min(F.struct("doc_id", "text_name")).alias("one"), *(F.first(c).alias(c) for c in ("n_shingles", "bands"))
    )
    #: Each set is a node with a number of its own, and the smallest doc_id that has it.
    nodes = stored(sets.select("set_name", "one.*", F.col("n_shingles").alias("n"), "bands", F.monotonically_increasing_id().alias("rep")), "nodes")
    dealt = nodes.select(F.explode("bands").alias("h"), "rep", "n")
    met = stored(dealt.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "met")
    members = stored(dealt.join(met, "h"), "members")
    component = stored(members.select("rep").distinct().withColumn("label", F.col("rep")), "component")
    wanted = nodes.select(F.col("doc_id").alias("d"), F.col("text_name").alias("t"), "rep").join(component.select("rep"), "rep", "left_semi")
    texts = docs.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("text_name") == F.col("t"))).groupBy("rep").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are similar enough on their full sets."""
        left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        full = left.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long")

    def merged(links: DataFrame) -> DataFrame:
        """component after the links are taken in."""
        links = stored(links, "links")
        label = component.select(F.col("rep").alias("r"), "label")
        ends = links.join(label, F.col("a") == F.col("r")).select(F.col("label").alias("a"), "b").join(label, F.col("b") == F.col("r")).select("a", F.col("label").alias("b"))
        roots = contracted(ends.filter("a <> b").distinct())
        out = stored(component.join(roots, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("root", "label").alias("label")), "component")
        forget(links, component)
        return out

    def apart(now: DataFrame, lead: DataFrame, sketches: DataFrame, best: bool) -> DataFrame:
        """All links between members of different components of one bucket; or each member's link to the closest one of
        each other component, if it is one."""
        rows_ = now.join(lead.select("h"), "h")
        sizes = rows_.join(sketches.select("rep", (F.length("bits").cast("long") + 8 * bands + 64).alias("bytes")), "rep")
        by_label = sizes.groupBy("h", "label").agg(F.sum("bytes").alias("bytes"))
        buckets = by_label.groupBy("h").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most"), F.max_by("label", F.struct("bytes", "label")).alias("main"))
        parts = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES)).cast("long")
        buckets = buckets.select("h", "main", parts(F.col("all") - F.col("most")).alias("lefts"), parts(F.col("all")).alias("rights"))
        dealt_ = rows_.join(buckets, "h")
        beside, place = F.col("label") != F.col("main"), F.xxhash64("rep")
        own, own_right = F.pmod(place, F.col("lefts")), F.pmod(place, F.col("rights"))
        each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        seat = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
        lefts = F.transform(each("rights"), lambda j: seat(own, j, F.lit(LEFT | BESIDE) + F.when(j == own_right, RIGHT).otherwise(0)))
        rights = F.transform(F.filter(each("lefts"), lambda i: ~beside | (i != own)), lambda i: seat(i, own_right, F.lit(RIGHT) + F.when(beside, BESIDE).otherwise(0)))
        seats = F.explode(F.when(beside, F.concat(lefts, rights)).otherwise(rights)).alias("s")
        # Sketches come last, so they are shuffled once by member and once by block.
        blocks = dealt_.select("h", seats, "rep", "label", "n").join(sketches, "rep").select("h", "s.i", "s.j", "s.side", "rep", "label", "n", "bands", "bits")
        blocks = blocks.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
        return linked(blocks.mapInArrow(_compared(percent, best), "a long, b long").distinct())

    now = lead = sketches = None
    for turn in range(STAR_ROUNDS + 2):
        forget(now, lead)
        # Members with their labels, and for each bucket with several components two random members of different ones.
        now = stored(members.join(component, "rep"), "members")
        one = F.struct(F.xxhash64("label", F.lit(turn)), F.xxhash64("rep", "h", F.lit(turn)), "label", "rep", "n")
        lead = stored(now.groupBy("h").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo.label <> hi.label"), "lead")
        if lead.isEmpty():
            break
        if turn >= STAR_ROUNDS:
            if sketches is None:
                wanted = now.join(lead.select("h"), "h").select("rep").distinct()
                made = texts.join(wanted, "rep", "left_semi").mapInArrow(_sketches(words), "rep long, bits binary")
                sketches = stored(made.join(nodes.select("rep", "bands"), "rep"), "sketches")
            component = merged(apart(now, lead, sketches, turn == STAR_ROUNDS))
            continue
        pick = F.when(F.col("label") != F.col("lo.label"), F.col("lo")).otherwise(F.col("hi"))
        tried = now.join(lead, "h").select("rep", "n", pick.alias("p")).filter(_similar_size("n", "p.n", percent))
        choice = F.struct(F.xxhash64("rep", "p.rep", F.lit(turn)), "p.rep")
        best = tried.groupBy("rep").agg(F.min(choice).alias("p"), F.max(choice).alias("q"))
        pairs = best.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.array("p.rep", "q.rep") if turn else F.array("p.rep"))).alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        component = merged(linked(pairs))

    forget(now, lead, sketches, members, texts)
    names = nodes.select("set_name", "rep", "doc_id").join(component, "rep", "left")
    smallest = names.filter("label IS NOT NULL").groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("low"))
    of_set = names.join(smallest, F.col("label") == F.col("l"), "left").select("set_name", F.coalesce("low", "doc_id").alias("own"))
    labels = stored(of_set, "labels")
    forget(nodes, component, met)
    out = rows.select("doc_id", "n_shingles", "set_name").join(labels, "set_name", "left")
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    own = F.when(has, F.coalesce("own", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), same(F.col("doc_id"), own).alias("kept"))


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest doc_id; all columns stay.

    A null doc_id comes after all others. Rows are told apart by keys of their own, so ids may be null or repeat, and
    each text of a repeated id has its links.
    """
    rows = keyed(docs)
    groups = near_groups(rows.select(F.col("key").alias("doc_id"), "row.text"), words, percent).filter("n_shingles > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name", "key"))["key"]
    return only(rows, groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("of")), best)
