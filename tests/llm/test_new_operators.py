"""Sharding along the Hilbert curve, dense lexical search and whitening against brute force and SQL."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import lexical, queries, sharding, whitening

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def clashing(df):
    """df with columns that are named as those inside the operators."""
    return df.withColumns({c: F.lit("x") for c in ("key", "size", "place", "shard", "slot", "rank", "start", "value", "cell", "many", "n", "ids", "tfs", "term", "terms", "number", "score", "x", "v", "y", "i", "j", "row", "k")})


@pytest.mark.parametrize("name", ["op11_hilbert_sharding", "op12_dense_lexical_search"])
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    want = duck.execute(queries.oracle_sql()[name])
    named = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*named).collect()), key=str) == sorted(want.fetchall(), key=str)


# --- sharding -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(spark, dims, bits):
    """The curve meets every cell once, and each next cell is a neighbour in one dimension."""
    cells = [f"c{k}" for k in range(dims)]
    grid = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{c} int" for c in cells))
    rows = sorted((r.place, *(r[c] for c in cells)) for r in sharding.hilbert(grid, cells, "place", bits).collect())
    assert [r[0] for r in rows] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in itertools.pairwise(rows))


def document_rows():
    rng = random.Random(5)
    rows = [(k, "w" * rng.randint(0, 400), rng.choice(["en", "de", None]), f"s{rng.randint(0, 6)}") for k in range(300)]
    rows += [(1000 + k, "copy", "en", "hot") for k in range(200)]
    return rows + [(None, None, None, None), (None, "é" * 70, None, None), (7, "", "", ""), (7, "", "", ""), (8, "long " * 3000, "en", "hot")]


@pytest.mark.parametrize("law", ["bytes", "rows"])
@pytest.mark.parametrize("shards", [1, 8])
def test_shards(spark, law, shards):
    rows = document_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = sharding.sharded(docs, shards, law).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {law} and {r.grown_shard for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for r in by.values():
        assert sorted(x.slot for x in r) == list(range(len(r)))
    # The shards are runs of the curve.
    ends = [(min(x.place for x in by[k]), max(x.place for x in by[k])) for k in sorted(by)]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == shards
    else:
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(x["size"] for x in by.get(k, [])) - total / shards) <= largest for k in range(shards))


def test_shards_of_little(spark):
    docs = spark.createDataFrame([], DOCS)
    assert sharding.sharded(docs).count() == 0 and sharding.sharded(docs, law="rows").count() == 0
    one = sharding.sharded(spark.createDataFrame([(1, None, None, None)], DOCS)).collect()
    assert [(r.doc_id, r["size"], r.text_crc32, r.slot) for r in one] == [(1, 1, 0, 0)]
    with pytest.raises(ValueError, match="unknown law"):
        sharding.sharded(docs, law="key")


def test_files_can_be_pruned(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, "w" * int(2 ** rng.uniform(1, 12)), rng.choice(["de", "en", "fr", "it"]), f"s{rng.randint(0, 15):02}") for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard_note", F.lit("kept"))
    boxes = sharding.write_shards(docs, str(tmp_path / "out"), files=2, shards=16)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    hashed = sharding.boxes(docs.withColumn("size", F.length("text")).withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(16))))
    for wanted in ({"source": ("s03", "s03")}, {"lang": ("fr", "fr")}, {"size": (1, 16)}, {"source": ("s10", "s11"), "lang": ("de", "de"), "size": (500, 5000)}):
        read = sharding.shards_for(boxes, **wanted)
        assert read.count() < sharding.shards_for(hashed, **wanted).count()
        kept = F.lit(True)
        for c, (low, high) in wanted.items():
            kept &= (F.length("text") + 1 if c == "size" else F.col(c)).between(low, high)
        there = {r.shard for r in back.filter(kept).select("shard").distinct().collect()}
        assert there <= {r.shard for r in read.collect()}


# --- lexical search -------------------------------------------------------------------------------------------------

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top):
    texts = [(d, re.findall(lexical.TERM, (t or "").translate(FOLD))) for d, t in docs]
    texts = [(d, t) for d, t in texts if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    counts = [(d, len(t), Counter(t)) for d, t in texts]
    df = Counter(x for _, _, c in counts for x in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(re.findall(lexical.TERM, (t or "").translate(FOLD)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, length, c in counts:
            m = 100 - 90 + (90 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms if x in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"group_terms": 5, "block_items": 2, "tile_docs": 3, "tile_terms": 2}])
def test_search(spark, options):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b1", "Caf", "é", "Émil", "x9", "THE", "of", "日本", "q-r", "s.t"])
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 30)))) for k in range(60)]
    docs += [(100 + k, "the same b1 text") for k in range(40)] + [(None, "b1 null"), (None, "b1 null"), (5, "twice x9"), (5, "twice x9"), (6, None), (7, ""), (8, " .,-\n"), (9, "b1 " * 20_000)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 6)))) for k in range(9)] + [(20, None), (21, ""), (22, "nowhere"), (None, "x9 of"), (3, "more THE"), (23, "same b1 same")]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    b = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = lexical.top_documents(d, b, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)


def test_search_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.top_documents(none, items).count() == 0
    assert lexical.top_documents(docs, items.limit(0)).count() == 0
    # A term of the only document weighs floor(1000 * ln(4 / 3)).
    assert [tuple(r) for r in lexical.top_documents(docs, items).collect()] == [(1, 1, 1, 287 * (1_000_000_000 // 1800))]


def test_no_sum_reaches_the_bound():
    width = lexical.exact_width()
    assert width * lexical.WEIGHT * lexical.IMPACT < 2**53 and width >= lexical.TILE_TERMS
    assert lexical.weights(np.array([0]), 2**62)[0] < lexical.WEIGHT
    assert lexical.impacts(np.array([1, 2**31]), np.array([10, 10])).max() < lexical.IMPACT


# --- whitening ------------------------------------------------------------------------------------------------------


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 9, 40, 120):
        a = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(a)
        yield a @ a.T
        yield np.eye(n) * 3
        yield np.diag(np.repeat([5.0, 1.0], [n // 2, n - n // 2]))
        yield q @ np.diag(np.r_[np.full(min(4, n), 7.0), rng.random(max(0, n - 4))]) @ q.T
        yield np.outer(a[0], a[0]) * 1e12
        yield np.diag(10.0 ** -np.arange(n).clip(0, 300))
        yield np.zeros((n, n))


@pytest.mark.parametrize("v", list(matrices()))
def test_eigenvectors(v):
    v = (v + v.T) / 2
    values, x = whitening.leading(v, 8)
    want, norm = np.linalg.eigvalsh(v)[::-1][:8], max(np.abs(v).max() * len(v), 1e-300)
    assert np.abs(values - want).max() <= 1e-14 * norm
    assert np.abs(v @ x - x * values).max() <= 1e-14 * norm and np.abs(x.T @ x - np.eye(x.shape[1])).max() <= 1e-13


def brute_whitening(rows, many=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums).astype(np.float64) / n
    v = c.T @ c / n
    e, basis = np.linalg.eigh(v)
    e, basis = e[::-1][:many], basis[:, ::-1][:, :many]
    keep = e > 1e-12 * np.trace(v)
    y = c @ basis[:, keep] / np.sqrt(e[keep])
    return y, [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x], e[keep] / np.trace(v)


@pytest.mark.parametrize("dim", [1, 3, 24])
def test_whitened(spark, dim):
    rng = np.random.default_rng(dim)
    scale = np.linspace(1, 4, dim)
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(dim) * scale + 2]) for k in range(120)] + [(5, [0.5] * dim), (5, [0.5] * dim), (None, [-1.25] * dim)]
    bad = [(200, None), (201, [float("nan")] * dim), (202, [None] * dim), (203, [float("inf")] + [0.0] * (dim - 1)), (204, [1.0] * (dim + 1)), (205, [])]
    df = clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).repartition(3)
    got = whitening.whitened(df).toPandas()
    y, far, share = brute_whitening(rows)
    k = min(8, dim)
    assert len(got) == len(rows) * k and set(got.n) == {len(rows)} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    for c in range(k):
        mine = got[got.component == c + 1]
        assert np.allclose(mine.explained, share[c], rtol=1e-10)
        by_id = {None if math.isnan(r.vec_id) else int(r.vec_id): (r.whitened, r.deviation) for r in mine.itertuples()}
        at = {r[0]: i for i, r in enumerate(rows)}
        sign = np.sign(by_id[0][0] * y[at[0], c])
        for i, (w, d) in by_id.items():
            assert math.isclose(w * sign, y[at[i], c], rel_tol=1e-8, abs_tol=1e-8) and d == far[at[i]]


def test_whitened_without_spread(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, [])]).count() == 0 and make([(1, None)]).count() == 0
    assert make([(1, [1.0, 2.0])]).count() == 0 and make([(k, [3.0, 4.0]) for k in range(5)]).count() == 0
    # One direction only: one component.
    line = make([(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]).toPandas()
    assert set(line.component) == {1} and line.explained.round(9).eq(1).all()
    wide = make([(1, [4e12]), (2, [0.0]), (3, [-4e12])]).toPandas()
    assert wide.deviation.isna().sum() == 2 and (wide.deviation.dropna() == 0).all()
