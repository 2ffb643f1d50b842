"""Changes of written tables, terms of many profiles, rescue budgets, exports, catalogs and late rows."""

import datetime as dt
import glob
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from jobloom.operators import dedup, enrich, health, lifecycle, partitioned, serving, skill_index
from jobloom.sources import payloads
from jobloom.streaming import jobs

# --- terms of many profiles -----------------------------------------------------------------------------------------


def brute_hits(texts, terms, least):
    own = {}
    for p, t in terms:
        if t is not None and len(t.strip()) >= 3:
            own.setdefault(p, set()).add(t.strip().lower())
    out = {}
    for i, text in texts:
        if i is None or text is None:
            continue
        for p, ts in own.items():
            out.setdefault((i, p), set()).update(t for t in ts if t in text.lower())
    return sorted((i, p, len(ts)) for (i, p), ts in out.items() if len(ts) >= least)


@pytest.mark.parametrize("options", [{}, {"most": 3, "at_once": 2}])
def test_profile_hits(spark, options):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 6)))
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(50)] + [(50, None), (51, ""), (52, "ab"), (3, "again abc bca"), (None, "abc bca cab"), (53, "abc" * 40_000)]
    terms = [(p, word() + word()) for p in range(40) for _ in range(5)] + [(1, None), (2, "ab"), (3, "  ABC "), (3, "abc"), (3, "bca"), (3, "cab"), (4, "abc"), (4, "bca"), (4, "cab"), (5, "nowhere")]
    p, t = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "profile_id long, term string")
    for least in (1, 3):
        got = skill_index.profile_hits(p, t, least, **options)
        assert sorted(map(tuple, got.collect())) == brute_hits(texts, terms, least)
    assert skill_index.profile_hits(p.limit(0), t).count() == 0 and skill_index.profile_hits(p, t.limit(0)).count() == 0


def test_profile_hits_plan_has_no_nested_loop(spark):
    p = spark.range(100).select("id", F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    t = spark.range(100).select(F.col("id").alias("profile_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("term"))
    plan = skill_index.profile_hits(p, t, 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_profile_hits_by_blocks(spark):
    """Blocks of any size give the same pairs, without the done ones; the first of each profile are kept."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    texts = [(k, " ".join(word(rng.randint(1, 40)) for _ in range(30)), rng.randint(0, 3)) for k in range(40)]
    terms = [(p, word(3)) for p in range(30) for _ in range(6)] + [(p, t) for p in range(100, 112) for t in ("abc", "bca", "a b")] + [(7, texts[0][1][:60])] + [(8, word(2)) for _ in range(300)]
    done = {(rng.randint(0, 39), rng.choice([1, 2, 3, 100, 105, 999])) for _ in range(60)}
    p, t, d = spark.createDataFrame(texts, "id long, text string, place int"), spark.createDataFrame(terms, "profile_id long, term string"), spark.createDataFrame(sorted(done), "id long, profile_id int")
    want = [x for x in brute_hits([x[:2] for x in texts], terms, 2) if x[:2] not in done]
    got = skill_index.profile_hits(p, t, 2, most=3, at_once=2, done=d, block=(3, 4))
    assert got.dtypes == [("id", "bigint"), ("profile_id", "bigint"), ("hits", "bigint")] and sorted(map(tuple, got.collect())) == want
    place = {x[0]: x[2] for x in texts}
    best = {tuple(x) for x in skill_index.profile_hits(p, t, 2, done=d, best=2, block=(8, 4)).collect()}
    firsts = lambda rows: [sorted((x for x in rows if x[1] == q), key=lambda x: (place[x[0]], x[0]))[:2] for q in {x[1] for x in want}]
    assert best < set(want) and firsts(best) == firsts(want)


def test_terms_of_two_words(spark, monkeypatch):
    """Terms of two words are found by the words beside the white space: postings that only share a trigram are no rows."""
    texts = [(1, "Ab.\ncd ef"), (2, "ab. cd\n\nef"), (3, "xxab.\ncdyy"), (4, "b.\nc"), (5, "ab.\r\ncd"), (6, "\nab.\n"), (7, " ab.\ncd"), (8, "ab.\n cd"), (9, "x" * 40 + "\t" + "y" * 40)]
    terms = [(1, "ab.\ncd"), (2, "ab. cd"), (3, "b.\ncd"), (4, "cd\n\nef"), (5, "ab.\r\ncd"), (8, "ab.\ncd ef"), (9, "x" * 24 + "\t" + "y" * 24), (9, "x" * 25 + "\ty"), (9, "x\ty"), (9, "x\t" + "y" * 26), (10, "d\ne")]
    p, t = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "profile_id long, term string")
    looked_up, found = [], skill_index.found
    monkeypatch.setattr(skill_index, "found", lambda texts, pairs, *a: looked_up.append(pairs) or found(texts, pairs, *a))
    # Only blanks are trimmed, so these begin or end with a line.
    edges = spark.createDataFrame([(20, " \nab"), (21, "ab.\n")], "profile_id long, term string")
    want = sorted(brute_hits(texts, terms, 1) + [(6, 20, 1)] + [(k, 21, 1) for k in (1, 3, 6, 7, 8)])
    for gaps in (skill_index.GAPS, 1):
        monkeypatch.setattr(skill_index, "GAPS", gaps)
        assert sorted(map(tuple, skill_index.profile_hits(p, t.unionByName(edges), 1).collect())) == want
    many = spark.range(50).select("id", F.concat(F.lit("word.\nand"), F.col("id").cast("string")).alias("text"))
    more = spark.range(50).select(F.col("id").alias("profile_id"), F.concat(F.lit("rd.\nand"), (F.col("id") + 100).cast("string")).alias("term"))
    assert skill_index.profile_hits(many, more, 1).count() == 0 and looked_up[-1].count() == 0


def shuffled(plan):
    """Rows that the exchanges of a plan that ran have written."""
    inner = [getattr(plan, k)() for k in ("executedPlan", "plan") if any(m.getName() == k for m in plan.getClass().getMethods())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return ([own.get().value()] if own.isDefined() else []) + [n for x in inner + [plan.children().apply(i) for i in range(plan.children().size())] for n in shuffled(x)]


def test_blocks_are_few(spark, tmp_path):
    """A posting goes to few blocks of profiles, so what is shuffled of all pairs grows with postings and profiles."""
    n, m, at = 60_000, 20_000, F.col("id") % 7
    p = spark.range(m).select("id", F.concat(F.lit("aaa"), at.cast("string"), F.lit(" bbb"), ((at + 1) % 7).cast("string")).alias("text"))
    t = spark.range(n).select(F.col("id").alias("profile_id"), F.explode(F.array(*[F.concat(F.lit(x), at.cast("string")) for x in ("aaa", "bbb")])).alias("term"))
    names = iter("abcd")

    def stored(rows):
        rows.write.parquet(path := str(tmp_path / next(names)))
        return spark.read.parquet(path)

    got = skill_index.profile_hits(p, t, 2, stored=stored)
    assert got.collect() == []
    rows = shuffled(got._jdf.queryExecution().executedPlan())
    assert m < max(rows) <= max(2 * n, m * 2 * spark.sparkContext.defaultParallelism + n // 500)


@pytest.mark.parametrize("first", [1 << 10, 7])
def test_first_of_each_profile(spark, monkeypatch, first):
    """Profiles that have enough of the first postings meet no others, the rest finds its own among all."""
    monkeypatch.setattr(skill_index, "FIRST_POSTINGS", first)
    texts = [(k, ("early " if k % 9 < 2 else "") + f"common mark{k} " + ("late" if k > 1990 else ""), k % 9) for k in range(2000)]
    own = {1: ["common"], 2: ["early"], 3: ["late"], 4: ["mark1999"], 5: ["nowhere"], 6: ["late", "common"], 7: ["mark8"]}
    done = [(0, 1), (9, 1), (1, 2), (1998, 3), (77, 5)]
    p, d = spark.createDataFrame(texts, "id long, text string, place int"), spark.createDataFrame(done, "id long, profile_id long")
    terms = [(q, t) for q, ts in own.items() for t in ts]
    got = sorted(map(tuple, skill_index.profile_hits(p, spark.createDataFrame(terms, "profile_id long, term string"), 1, done=d, best=3).collect()))
    want = [x for x in brute_hits([x[:2] for x in texts], terms, 1) if x[:2] not in done]
    firsts = lambda rows: [sorted((x for x in rows if x[1] == q), key=lambda x: (x[0] % 9, x[0]))[:3] for q in own]
    assert set(got) <= set(want) and len(set(got)) == len(got) and firsts(got) == firsts(want)
    assert all(sum(x[1] == q for x in got) == 3 for q in (1, 2, 6)) and len(got) <= 6 * len(own)


@pytest.mark.parametrize("limit", [0, 3, 5, 8, 200])
def test_rescue_budget(spark, limit):
    rows = lambda n, ids: spark.createDataFrame([(ids + k, 40 - k) for k in range(n)], "id long, score_total int")
    first = rows(5, 0).orderBy(*enrich.best_first()).limit(limit)
    for cap in (2, 100):
        got = enrich.with_rescued(first, rows(6, 100), limit, cap).collect()
        had = min(5, limit)
        assert sorted(r.id for r in got if not r.rescued) == list(range(had))
        assert sorted(r.id for r in got if r.rescued) == list(range(100, 100 + min(6, cap, max(0, limit - had))))


def test_rescue_budget_by_profile(spark):
    first = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "profile_id long, id long")
    more = spark.createDataFrame([(p, 20 + k, 39 - k) for p in (1, 2, 3) for k in range(4)], "profile_id long, id long, score_total int")
    got = enrich.with_rescued_by_profile(first, more, 3, 2).filter("rescued").collect()
    assert sorted((r.profile_id, r.id) for r in got) == [(1, 20), (2, 20), (2, 21), (3, 20), (3, 21)]


# --- tables by day --------------------------------------------------------------------------------------------------

POSTING = "dedup_key string, id long, title string, company string, location string, description string, apply_url string, source string, source_tier int, source_url string, score_total int, first_seen_at timestamp, last_seen_at timestamp, salary_min_usd int, salary_max_usd int, salary_source string, is_active boolean, seniority string"


def posting(key, k, day, last=None, active=True):
    at = lambda d: d and dt.datetime(2024, 1, d, 5)
    return (key, k, f"t{k}", "c", "l", "d", "u", "s", 1, "su", k, at(day), at(last or day), None, None, None, active, "Mid")


@pytest.fixture
def table(spark, tmp_path):
    rows = [posting(f"k{d}-{n}", d * 10 + n, d) for d in range(1, 6) for n in range(3)] + [posting("none", 99, None), posting(None, 98, 1)]
    return partitioned.create(spark.createDataFrame(rows, POSTING), str(tmp_path / "days"))


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/*/*.parquet")}


def day_of(f):
    return os.path.basename(os.path.dirname(f)).split("=")[1]


def test_upsert_leaves_other_days_alone(spark, table):
    before = files(table)
    incoming = spark.createDataFrame([(*posting("k2-0", 500, 4), 0), (*posting("k2-0", 501, 4), 1), (*posting("new", 600, 5), 0), (*posting("none", 700, 3), 0)], f"{POSTING}, seq int")
    assert partitioned.upsert(table, incoming) == {"inserted": 1, "updated": 2}
    after = files(table)
    kept = {f for f in before if f in after and before[f] == after[f]}
    assert {day_of(f) for f in kept} == {"2024-01-01", "2024-01-03", "2024-01-04"}
    got = {r.dedup_key: (r.id, r.score_total, r.seen_day and r.seen_day.day) for r in table.rows().collect()}
    # A row that was there keeps its id and its day, one that came twice takes the last values.
    assert len(got) == 18 and got["k2-0"] == (20, 501, 2) and got["new"] == (600, 600, 5) and got["none"] == (99, 700, None) and got["k1-0"] == (10, 10, 1)
    # The same change once more changes nothing.
    assert partitioned.upsert(table, incoming) == {"inserted": 0, "updated": 3}
    assert {r.dedup_key: (r.id, r.score_total, r.seen_day and r.seen_day.day) for r in table.rows().collect()} == got


def test_days_are_pruned(table):
    plan = table.rows([dt.date(2024, 1, 2), None])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "seen_day" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.id for r in table.rows([dt.date(2024, 1, 2), None]).collect()} == {20, 21, 22, 99}


def test_patch_by_day(spark, table):
    before = files(table)
    patches = spark.createDataFrame([(30, 0, "Lead"), (30, 1, None), (31, 0, "Staff"), (12345, 0, "x")], "id long, seq int, seniority string")
    assert partitioned.patch(table, patches) == {"patched": 2}
    assert {day_of(f) for f in before if files(table).get(f) != before[f]} == {"2024-01-03"}
    assert {r.id: r.seniority for r in table.rows().filter("seniority <> 'Mid'").collect()} == {30: "Lead", 31: "Staff"}


def test_retention_by_day(spark, tmp_path):
    rows = [posting("a", 1, 1), posting("b", 2, 1, active=False), posting("c", 3, 5, 9), posting("d", 4, 5, 30), posting("e", 5, 20), posting("f", 6, None)]
    table = partitioned.create(spark.createDataFrame(rows, POSTING), str(tmp_path / "days"))
    before = files(table)
    as_of = F.lit("2024-01-31 05:00:00").cast("timestamp")
    assert partitioned.retain(table, as_of, 20, 28) == {"marked": 2, "deleted": 2}
    assert sorted((r.id, r.is_active) for r in table.rows().collect()) == [(3, False), (4, True), (5, True), (6, True)]
    assert not os.path.exists(f"{table.path}/seen_day=2024-01-01")
    assert {day_of(f) for f in before if files(table).get(f) == before[f]} == {"2024-01-20", "__HIVE_DEFAULT_PARTITION__"}
    assert partitioned.retain(table, as_of, 20, 28) == {"marked": 0, "deleted": 0}


def test_empty_table_by_day(spark, tmp_path):
    table = partitioned.create(spark.createDataFrame([], POSTING), str(tmp_path / "days"))
    assert table.rows().count() == 0
    incoming = spark.createDataFrame([(*posting("a", 1, 1), 0)], f"{POSTING}, seq int")
    assert partitioned.upsert(table, incoming.limit(0)) == {"inserted": 0, "updated": 0}
    assert partitioned.upsert(table, incoming) == {"inserted": 1, "updated": 0} and table.rows().count() == 1


# --- inserts and deletions ------------------------------------------------------------------------------------------


def test_inserts(spark):
    at = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame([(1, 7, 100, "old", "offer", at, at), (2, 7, None, "free", "saved", None, at)], "id long, user_id long, job_id long, job_title_snapshot string, status string, applied_at timestamp, updated_at timestamp")
    rows = [(7, 100, 1, "again", "saved"), (7, 200, 2, "new", None), (7, 200, 3, "newer", "applied"), (7, None, 4, "free", "applied"), (7, None, 5, "free", "applied"), (None, 200, 6, "x", "saved"), (None, 200, 7, "x", "saved"), (8, 300, 8, "y", "offer"), (8, 300, 9, "z", "applied")]
    got = {r.seq: r for r in lifecycle.inserted(current, spark.createDataFrame([(*r, at) for r in rows], "user_id long, job_id long, seq long, job_title_snapshot string, status string, at timestamp")).collect()}
    assert {k: (r.outcome, r.id, r.job_title_snapshot, r.status) for k, r in got.items()} == {
        1: ("duplicate", 1, "old", "offer"), 2: ("created", None, "new", "saved"), 3: ("duplicate", None, "new", "saved"), 4: ("created", None, "free", "applied"), 5: ("created", None, "free", "applied"),
        6: ("created", None, "x", "saved"), 7: ("created", None, "x", "saved"), 8: ("refused", None, None, None), 9: ("created", None, "z", "applied"),
    }
    assert got[4].applied_at == at and got[2].applied_at is None


def test_cascade(spark, tmp_path):
    profiles = spark.createDataFrame([(1, 7, False), (2, 7, True), (3, 8, False)], "id long, user_id long, is_active boolean")
    scores = spark.createDataFrame([(10, 1), (11, 1), (10, 2), (10, 3), (12, None)], "job_id long, profile_id long")
    wanted = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7), (4, 7)], "id long, user_id long")

    def store(rows):
        rows.write.parquet(str(tmp_path / "decided"))
        return spark.read.parquet(str(tmp_path / "decided"))

    left, kept, refused = lifecycle.profile_cascade(profiles, scores, wanted, store)
    assert sorted(r.id for r in left.collect()) == [2, 3]
    assert sorted((r.job_id, r.profile_id or 0) for r in kept.collect()) == [(10, 2), (10, 3), (12, 0)]
    assert sorted((r.id, r.outcome) for r in refused.collect()) == [(2, "active"), (3, "not owned"), (4, "missing")]


def test_activations(spark):
    profiles = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, True), (4, None, False)], "id long, user_id long, is_active boolean")
    wanted = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3), (8, 9, 1), (None, 4, 1)], "user_id long, id long, seq long")
    after, said = lifecycle.activations(profiles, wanted)
    assert sorted((r.id, r.is_active) for r in after.collect()) == [(1, False), (2, True), (3, True), (4, False)]
    assert sorted((r.id, r.seq, r.outcome) for r in said.collect()) == [(1, 1, "replaced"), (2, 2, "activated"), (3, 3, "not owned"), (4, 1, "missing"), (9, 1, "missing")]


# --- rows without names, histories of any length --------------------------------------------------------------------


def test_repair_of_rows_without_names(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(k, None if k % 3 == 0 else " " if k % 3 == 1 else f"t{k // 6}", "c", at(1 + k % 20), at(25), k % 2 == 0, "r") for k in range(60)] + [(100, "only", None, at(1), at(2), True, None)]
    df = spark.createDataFrame(rows, "id long, title string, company string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean, geo_reject_reason string")
    got = dedup.repair_collisions(df, F.lit(at(10)))
    out = {r.id: r.action for r in got.collect()}
    assert len(out) == 61 and all(out[k] == "kept" for k in out if k % 3 != 2) and {"canonical", "deleted"} <= set(out.values())
    # The second part of the union, rows without names, passes through no window.
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union") and not [line for line in plan if "Window" in line and not line.startswith(":")]


def test_states_of_long_histories(spark):
    rng = random.Random(5)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)
    rows = [("hot" if k % 3 == 0 else f"s{k % 7}", at(rng.randint(0, 500)), k, rng.random() < 0.1, "suspended" if rng.random() < 0.1 else None) for k in range(900)] + [("bad", at(k), k, False, None) for k in range(400)] + [(None, at(1), 1, True, None)]
    df = spark.createDataFrame(rows, "source string, run_at timestamp, seq long, success boolean, error_message string")
    want = {}
    for source in {r[0] for r in rows} - {None}:
        fails, since, good = 0, None, None
        for _, t, _, ok, said in sorted((r for r in rows if r[0] == source), key=lambda r: r[1:3]):
            if said != "suspended":
                fails = 0 if ok else fails + 1
                since = None if ok else t if fails == 4 else since
                good = t if ok else good
        want[source] = (fails, fails >= 4, since, good)
    states = health.states(df, 4)
    assert {r.source: (r.consecutive_failures, r.suspended, r.suspended_at, r.last_success_at) for r in states.collect() if r.source} == want
    assert "WindowGroupLimit" in states._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", ["<a href='/jobs/1'>x ", "<a href='/jobs/1", "<a >", "</a>", "<a href='/jobs/{k}'>Data Engineer {k}</a> "])
def test_links_of_long_pages(spark, part):
    body = lambda n: "".join(part.replace("{k}", str(k)) for k in range(n))

    def seconds(n):
        page = spark.createDataFrame([("s", "http://a/x", "http://a/x", body(n))], "source string, url string, final_url string, body string")
        start = time.time()
        found = payloads.harvested(page).collect()
        assert len(found) == (50 if "{k}" in part else 0)
        return time.time() - start

    seconds(100)
    assert seconds(8000) < 15


# --- answers --------------------------------------------------------------------------------------------------------


def test_score_of_odd_answers(spark):
    bodies = [
        ({"final_score": None}, None), ({"final_score": "7.5"}, None), ({"final_score": [1]}, None), ({"final_score": 7.9}, 7), ({"final_score": " 12 "}, 12), ({"final_score": True}, 1),
        ({"final_score": -5}, 0), ({"final_score": "99999999999"}, 100), ({"final_score": 5, "dimensions": "x"}, None), ({"final_score": 5, "dimensions": {"seniority": 3}}, None),
        ({"final_score": 5, "dimensions": {"seniority": 0}, "adjustments": {}}, 5), ({"final_score": 5, "adjustments": 3}, None), ({"final_score": 5, "dimensions": "0"}, None), ({"final_score": 5, "dimensions": ""}, 5), ({"final_score": 5, "dimensions": []}, 5), ({"location_eligible": False, "final_score": 90}, 0),
        ({"location_eligible": "false", "final_score": 90}, 90), ({"location_eligible": None, "final_score": 1}, 1),
    ]
    texts = [json.dumps(b) for b, _ in bodies] + [None, "[]", "nope"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.s and r.s.match_score for r in df.select("k", enrich.score_of(F.col("t")).alias("s")).collect()}
    assert [got[k] for k in range(len(texts))] == [w for _, w in bodies] + [None] * 3


def test_write_back(spark):
    good, bad = json.dumps({"final_score": 5}), json.dumps({"final_score": "x"})
    rows = [("a", "succeeded", good), ("a", "errored", None), ("b", "succeeded", bad), ("b", "succeeded", bad), ("c", "succeeded", None), ("d", "expired", None), ("z", "succeeded", good), (None, "succeeded", good), (None, "succeeded", good), ("e", None, good)]
    asked = spark.createDataFrame([(c,) for c in "abcde"], "custom_id string")
    (r,) = enrich.write_back(spark.createDataFrame(rows, "custom_id string, outcome string, body string"), asked).collect()
    assert r.asDict() == {"errored": 2, "unknown_id": 3, "json_failed": 1, "build_failed": 1, "ok": 1, "repeated": 2, "parse_failed": 5}


# --- exports, catalogs, streams -------------------------------------------------------------------------------------


def test_export_files_in_order(spark, tmp_path):
    n = 5000
    rows = spark.range(n).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), (F.col("id") % 700).cast("int").alias("match_score"), F.lit(1).alias("score_total"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at"), F.lit("u").alias("source_url"))
    path = str(tmp_path / "out")
    assert serving.export(rows.repartition(5), path, "notion", limit=4000) == 4000
    text = "".join(r.text for r in sorted(serving.exported(spark, path).collect(), key=lambda r: r.file))
    head, *lines = text.splitlines()
    assert head.startswith("Name,Company,Match,Rule Score,") and head.endswith(",First Seen,Verdict")
    want = sorted(range(n), key=lambda i: (-(i % 700), i))[:4000]
    assert [line.split(",")[0] for line in lines] == [f"t{i}" for i in want] and lines[0].split(",")[12] == "u"
    assert serving.export(rows.limit(0), str(tmp_path / "none"), "csv") == 0
    with pytest.raises(ValueError, match="unknown form"):
        serving.export(rows, str(tmp_path / "x"), "xml")


def test_broken_catalog_fails_with_its_name(spark, tmp_path):
    good = {"groups": {"group_1": {"sources": [{"name": "A", "url": "u", "category": "Board"}]}}, "metadata": {"cjl_boost_companies": ["Acme"]}}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    whole = payloads.read_catalog(spark, str(tmp_path))
    assert [tuple(r) for r in payloads.catalog(whole, {"group_1": 1}).select("v2_group", "name", "super_group").collect()] == [("group_1", "A", 1)]
    assert [r.company for r in payloads.boost_list(whole).collect()] == ["Acme"]
    for broken in ('{"groups": {', "{}"):
        (tmp_path / "broken.json").write_text(broken)
        with pytest.raises(Exception, match=r"not a catalog: \S*broken.json"):
            payloads.catalog(payloads.read_catalog(spark, str(tmp_path)), {"group_1": 1}).collect()


def test_late_rows_of_a_stream(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d, 12)
    batches = [[(day(1), "a", 1.0), (day(10), "a", 2.0)], [(day(7), "a", 4.0), (day(7), "b", 4.0), (day(8), "a", 8.0), (day(12), "a", 16.0)], [(day(9), "a", 32.0), (day(20), "a", 64.0)]]
    progress = []
    for rows in batches:
        spark.createDataFrame(rows, "run_at timestamp, operation string, cost_usd double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spend = jobs.daily_spend(spark.readStream.schema("run_at timestamp, operation string, cost_usd double").parquet(str(tmp_path / "in")))
        progress += jobs.drained(spend.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "check"))
    # The 7th is late after the 10th was seen, the 8th is not; the 9th is late after the 12th.
    assert [n for _, _, n in jobs.late(progress)] == [0, 2, 1]
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.day.day, r.operation, r.cost_usd) for r in out) == [(1, "a", 1.0), (8, "a", 8.0), (10, "a", 2.0), (12, "a", 16.0)]
