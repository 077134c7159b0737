"""Spelling variants, virtual slots and whitening against brute force, and their edge cases."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_path import SF

from skyfold.llm import sharding, spelling, whitening
from skyfold.llm.queries import QUERIES
from skyfold.session import scratch_path

CLASH = ["word", "n", "key", "rest", "slot", "shard", "size", "crc", "copies", "v", "id", "component", "at", "sharding"]


def clashing(df):
    return df.select("*", *[F.lit(c).alias(c) for c in CLASH])


# ---- spelling

def near_by_force(words):
    """All pairs one edit apart."""
    found = set()
    known = set(words)
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1:] in known:
                found.add(frozenset((w, w[:i] + w[i + 1:])))
    for a in words:
        for b in words:
            if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                found.add(frozenset((a, b)))
    return found


@pytest.mark.parametrize("alphabet, size, count", [("ab", 9, 400), ("abc", 7, 600), ("aé", 12, 300), ("a", 40, 30)])
def test_composition_finds_each_pair_once(alphabet, size, count):
    rng = random.Random(size)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))) for _ in range(count)})
    a, b = spelling.Composition(words).pairs(None)
    pairs = [frozenset((words[x], words[y])) for x, y in zip(a, b)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near_by_force(words)


def test_long_words_need_no_recursion():
    long = "ab" * 5000
    words = sorted([long, long + "c", long[:-1], "x" + long])
    a, b = spelling.Composition(words).pairs(None)
    assert {frozenset((words[x], words[y])) for x, y in zip(a, b)} == {frozenset((long, w)) for w in words if w != long}


@pytest.mark.parametrize("limit", [spelling.LIMIT, 3])
def test_near_words_in_parts(spark, limit):
    """Small limits part the partitions down to their end."""
    rng = random.Random(5)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) + "suffix" for _ in range(20)}
    counts = {w: rng.randint(5, 90) for w in sorted(words)}
    expected = {}
    for pair in near_by_force(sorted(words)):
        for w in pair:
            (other,) = pair - {w}
            expected.setdefault(w, []).append((-counts[other], other))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.partitions(df, 6, limit).groupBy("key").agg(F.count("*").alias("k"), F.max(F.coalesce("shorter", F.length("rest"))).alias("most")).collect()
    assert all(r.k <= limit or r.most <= 1 for r in rows)
    found = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, 6, limit).collect()}
    assert found == {w: (len(x), -min(x)[0], min(x)[1]) for w, x in expected.items()}


def test_variants_edges(spark):
    text = " ".join(["Planet"] * 25 + ["planer"] * 5 + ["planers"] * 5 + ["École", "écolé"] + ["éàüöîñ"] * 6)
    df = clashing(spark.createDataFrame([(None, text), (1, None), (2, ""), (3, " 12 "), (4, "z" * 200_000 + " short")], "doc_id long, text string"))
    found = {r.word: r for r in spelling.variants(df).collect()}

    def printed(doc_id, run):
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        return run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]
    assert all(printed("", w) == w for w in ("planet", "planer", "planers", "éàüöîñ"))
    assert {w: (r.n, r.n_near, r.form, r.form_n, r.root) for w, r in found.items()} == {
        "planet": (25, 1, None, None, "planet"), "planer": (5, 2, "planet", 25, "planet"), "planers": (5, 1, None, None, "planers"),
        "éàüöîñ": (6, 0, None, None, "éàüöîñ")}
    assert spelling.variants(df.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    found = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert found == {w: "w13" for w, _ in chain}


# ---- slots

ROWS = [(None, "a b"), (None, None), (1, None), (2, ""), (3, "é"), (3, "é"), (3, "é"), (3, "other"), (4, "x" * 300_000)] + [(i, "t" * (i % 97)) for i in range(10, 400)]


@pytest.fixture(scope="module")
def rows(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string"))


def test_shards_are_near_equal_and_gapless(spark, rows):
    folder = scratch_path(spark, "map")
    out = sharding.shard(rows.filter("coalesce(doc_id, 0) <> 4"), 4, folder).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS if i != 4)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == expected
    loads = Counter()
    for s in range(4):
        assert sorted(r.position for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    for r in out:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 97
    assert sharding.read_map(spark, folder).count() == sharding.SLOTS


def test_a_row_that_comes_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    df = spark.createDataFrame([(7, "same")] * 100 + [(8, "b")], "doc_id long, text string")
    out = sharding.shard(df, 2, scratch_path(spark, "map")).collect()
    assert sorted(r.position for r in out if r.doc_id == 7) == list(range(100))


def test_growing_and_rebalancing_edit_the_map(spark, rows):
    folder = scratch_path(spark, "map")
    weights = sharding.slot_bytes(sharding.records(rows.filter("coalesce(doc_id, 0) <> 4"))).cache()
    one = sharding.write_map(sharding.first(weights, 4), folder, 1)
    two = sharding.write_map(sharding.grown(one, weights, 4), folder, 2)
    before, after = ({r.slot: r.shard for r in m.collect()} for m in (one, two))
    assert set(before) == set(range(sharding.SLOTS)) and all(after[s] in (before[s], 4) for s in after)
    load = Counter()
    for r in weights.collect():
        load[after[r.slot]] += r.bytes
    assert max(load[s] for s in range(4)) <= sum(load.values()) / 5 and max(load.values()) - min(load.values()) <= 5 * 98
    more = weights.withColumn("bytes", F.col("bytes") + F.when((F.col("slot") % 50 == 0) & (F.col("bytes") > 0), 500).otherwise(0)).cache()
    three = {r.slot: r.shard for r in sharding.rebalanced(one, more, 4).collect()}
    moved = [s for s in three if three[s] != before[s]]
    assert 0 < len(moved) < sharding.SLOTS // 8
    assert sharding.read_map(spark, folder).select("version").distinct().collect()[0][0] == 2
    assert sharding.read_map(spark, folder, 1).count() == sharding.SLOTS
    named = sharding.assign(rows, two).collect()
    assert len(named) == len(ROWS) and named[0].__fields__[:2] == ["doc_id", "text"]
    assert all(r.sharding.shard == after[r.sharding.slot] for r in named)


def test_no_rows_to_shard(spark, rows):
    assert sharding.shard(rows.limit(0), 8, scratch_path(spark, "map")).count() == 0


def test_slots_use_no_python(spark, rows):
    plan = sharding.shard(rows, 8, scratch_path(spark, "map"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# ---- whitening

def by_force(vectors, k):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - total[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    white = np.array([[r[j] / n for j in range(d)] for r in centred]) @ columns[:, order] / np.sqrt(values[order])
    return white, values[order] / np.trace(cov), [sum(c * c for c in r) for r in centred], cov


def test_whitening_against_fractions(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    white, explained, deviation, _ = by_force([r.embedding for r in source], 8)
    out = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    assert len(out) == 8 * len(source) and {r.n for r in out} == {len(source)}
    place = {r.vec_id: i for i, r in enumerate(source)}
    found = np.zeros((len(source), 8))
    for r in out:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
    signs = np.sign((found * white).sum(0))
    assert np.abs(found - white * signs).max() < 1e-8
    covariance = np.cov(found.T, bias=True)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    assert np.abs(covariance - np.eye(8)).max() < 1e-9


def test_covariances_are_exact_for_large_values(spark):
    rng = random.Random(3)
    vectors = [[rng.uniform(-1, 1) * 10**rng.randint(0, 12) for _ in range(5)] for _ in range(60)]
    model = whitening.fit(spark.createDataFrame([(v,) for v in vectors], "v array<double>"), 5)
    *_, deviation, cov = by_force(vectors, 5)
    assert model.covariance == cov.tolist()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors])
    assert model.deviations(x) == deviation


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)]
    rows = good + [(None, [1.0, 2.0, 1.0]), (5, [5.0, 5.0, 1.0]), (5, [5.0, 5.0, 1.0]), (40, None), (41, [1.0, None, 2.0]), (42, [nan, 1.0, 1.0]), (43, [1.0, inf, 2.0]),
                   (44, []), (45, [1.0]), (46, [1e300, 0.0, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in out) == Counter({**{i: 3 for i in range(30)}, None: 3, 5: 9})
    assert {r.n for r in out} == {33} and all((r.whitened is None) == (r.component == 3) for r in out)
    assert {r.explained for r in out if r.component == 3} == {0.0}
    for table in (df.limit(0), df.filter("vec_id = 40"), df.filter("vec_id = 44")):
        assert whitening.whiten(table).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in same] == [(None, 0.0, 0, 0.0)] * 6
    wide = whitening.whiten(spark.createDataFrame([(i, [float(i * j % 7) for j in range(200)]) for i in range(9)], "vec_id long, embedding array<double>"))
    assert wide.count() == 72
