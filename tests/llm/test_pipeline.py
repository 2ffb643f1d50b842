"""The corpus pipeline against its operators' brute-force versions, stage by stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

from . import brute
from .test_operators import DOCS, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        t = words(rng, rng.randint(5, 200))
        rows.append((k, t + " ###bad*** " * 4 if k % 5 == 0 else t, "en", f"s{k % 3}", len(t)))
    rows += [(300 + k, rows[k][1], "en", "s0", 0) for k in range(1, 40)]
    rows += [(400 + k, rows[k][1] + " extra", "en", "s1", 0) for k in range(1, 40)]
    rows += [(500, None, None, None, None), (501, "", "en", "s2", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 0 if k % 5 == 0 else 1, 0) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        seen.append((before, docs))
    ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
    quality, exact, near, mixed, packed = seen
    kept = set(ids(quality[1]))
    assert all(k not in kept for k in range(0, 300, 5)) and len([k for k in range(300) if k % 5 and k in kept]) >= 230
    texts = {}
    for r in exact[0].select("doc_id", F.coalesce("text", F.lit(""))).collect():
        texts.setdefault(r[1].translate(brute.FOLD), []).append(r[0])
    assert sorted(ids(exact[1])) == sorted(max(v) for v in texts.values())
    want = brute.near([tuple(r) for r in near[0].select("doc_id", "text").collect()], 5)
    assert sorted(ids(near[1])) == sorted(d for d, (_, root) in want.items() if d == root)
    assert Counter(map(tuple, mixed[1].collect())) == brute_mix([tuple(r) for r in mixed[0].select("*", F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(7))).collect()])
    check_packing([(r.doc_id, r.text or "") for r in packed[0].collect()], packed[1].collect())


def brute_mix(rows):
    """How often each row (columns of documents and its place in the order) is in the mixture: sources by name, null last,
    weigh 5, 2, 1 and share 150 % of all words up to twice their own; each gives its first words, twice over."""
    size = [len(brute.WORD.findall(r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(own.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * own[s], level * weight[s]) for s in names) < 1.5 * sum(own.values()) else (low, level)
    buckets, out = max(1, int(len(rows) ** 0.5)), Counter()
    for s in names:
        goal, start = int(round(min(2 * own[s], level * weight[s]), 6) + 0.5), 0
        for n, r in sorted(((n, r) for n, r in zip(size, rows, strict=True) if r[3] == s and n), key=lambda x: (x[1][5] % buckets, x[1][5])):
            taken = sum(max(0, min(at + n, goal) - at) for at in (start, start + own[s]))
            start += n
            if times := int(taken / n + 0.5):
                out[r[:5]] += times
    return out


def check_packing(docs, pieces):
    """Pieces against the ids of whole texts: every document is there as often as it came in, cut only where it must be,
    sequences are full without gaps, and there are hardly more of them than all ids need."""
    import public_tokenizers

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: [*encoder.encode(t, add_special_tokens=False).ids, 0] for _, t in docs}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = Counter()
    for d, t in docs:
        cuts = [0, *range(len(ids[t]) % 2048 or 2048, len(ids[t]), 2048), len(ids[t])]
        want.update((d, k, a, b - a, crc(ids[t][a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    need = sum(length for places in sequences.values() for _, length in places) / 2048
    assert len(sequences) <= 1.05 * need + 2


def test_null_and_repeated_ids(spark, corpus):
    rng = random.Random(4)
    a, b, c, e = (words(rng, 60) for _ in range(4))
    rows = [(None, a), (2, a), (None, "unique"), (3, b), (9, b), (3, c), (None, e), (None, e), (7, c + " end"), (7, b + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", f"s{k}", k) for k, (d, t) in enumerate(rows)], DOCS)
    pairs = lambda d: sorted(((r.doc_id, r.text or "") for r in d.collect()), key=str)
    exact = corpus_pipeline.exact_stage(spark, docs, corpus)
    assert pairs(exact) == sorted([(2, a), (None, "unique"), (9, b), (3, c), (None, e), (7, c + " end"), (7, b + " end"), (None, "")], key=str)
    assert pairs(corpus_pipeline.near_stage(spark, exact, corpus)) == sorted([(2, a), (None, "unique"), (3, c), (None, e), (7, b + " end"), (None, "")], key=str)
    many = spark.createDataFrame([(None if k % 2 else 1, f"{words(rng, 30)}", "en", f"s{k % 3}", k) for k in range(60)], DOCS)
    mixed = corpus_pipeline.mixing_stage(spark, many, corpus)
    assert max(r["count"] for r in mixed.groupBy("n_chars").count().collect()) <= 2
    assert 1.3 * 60 <= mixed.count() <= 1.7 * 60


def test_no_rows(spark, corpus):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_registered_once():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
