"""Percentile sketches and similar vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quantiles, similar

# --- percentiles ------------------------------------------------------------------------------


@pytest.mark.parametrize("n, k", [(50, 64), (20_000, 64), (200_000, 256)])
def test_sketch_stays_within_its_bound(n, k):
    rng = np.random.default_rng(n)
    v = np.concatenate([rng.lognormal(1, 2, n // 2), np.full(n - n // 2, 7.0)])
    rng.shuffle(v)
    whole = quantiles.Sketch(np.random.default_rng(1), k)
    for part in np.array_split(v, 13):
        s = quantiles.Sketch(np.random.default_rng(len(part)), k)
        for piece in np.array_split(part, 5):
            s.add(piece)
        whole.merge(s.n, s.var, s.levels)
    assert whole.n == n and sum(len(x) << h for h, x in enumerate(whole.levels)) == n
    assert sum(map(len, whole.levels)) <= max(n if n < 3 * k else 0, 4 * k + 200)
    bound = whole.rank_error() * n
    for p, x in zip((0.5, 0.95, 0.99), whole.quantiles((0.5, 0.95, 0.99))):
        low, high = (v < x).sum(), (v <= x).sum()
        assert low - bound <= p * n + 1 and high + bound >= p * n - 1
    if n < k:
        assert bound == 0 and whole.quantiles((0.5,))[0] == np.sort(v)[int(np.ceil(0.5 * n)) - 1]
    else:
        assert 0 < whole.rank_error() < 0.15


def test_days_add_up(spark):
    rng = np.random.default_rng(4)
    data = [(g, int(d), float(x)) for g in ("a", "b", None) for d in range(4) for x in rng.exponential(5, 30)]
    data += [("a", 0, None), ("a", 0, float("nan")), ("a", 1, float("inf")), ("a", 1, -1.0), ("c", 0, -5.0), ("a", None, 2.0)]
    df = spark.createDataFrame(data, "g string, d int, v double").withColumn("q_n", F.lit("x"))
    day = F.date_add(F.lit("2024-07-01").cast("date"), F.col("d"))
    kept = quantiles.day_sketches(df, ["g"], day, "v").persist()
    assert kept.count() == 13
    some = F.col("day") <= F.lit("2024-07-02").cast("date")
    for where, keep in ((None, lambda d: True), (some, lambda d: d is not None and d <= 1)):
        got = {r.g: r for r in quantiles.percentiles(kept, ["g"], days=where).collect()}
        assert set(got) == {"a", "b", None}
        for g, r in got.items():
            v = sorted(x for a, d, x in data if a == g and keep(d) and x is not None and 0 <= x < float("inf"))
            assert r.n == len(v) and r.rank_error == 0 and r.p95 == v[int(np.ceil(0.95 * len(v))) - 1]
    assert quantiles.percentiles(quantiles.day_sketches(df.limit(0), ["g"], day, "v"), ["g"]).count() == 0


def test_worker_flushes_are_merged(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHER", 50)
    monkeypatch.setattr(quantiles, "HOLD", 100)
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).repartition(3)
    got = quantiles.percentiles(quantiles.day_sketches(df, ["g"], F.lit("2024-01-01").cast("date"), "v"), ["g"]).collect()
    assert sum(r.n for r in got) == 5000 and all(abs(r.p50 - 2500) <= 5000 * r.rank_error + 5 for r in got)


# --- similar vectors --------------------------------------------------------------------------


def truth(keys, x, k):
    order = np.argsort(keys)
    keys, x = keys[order], x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
    s = (x @ x.T).round(6)
    np.fill_diagonal(s, -2)
    return {int(keys[i]): [int(keys[j]) for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(keys))}


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // 12, dim))
    x = c[rng.integers(0, len(c), n)] + 0.15 * rng.normal(size=(n, dim))
    return (x * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)


def frame(spark, keys, x):
    return spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(keys, x)], "vec_id long, embedding array<float>")


def found(df, **kw):
    out = {}
    for r in similar.nearest(df, "vec_id", "embedding", **kw).orderBy("key", "rank").collect():
        out.setdefault(r.key, []).append(r.near)
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARD_ROWS", 60)
    monkeypatch.setattr(similar, "LEAF", 16)
    monkeypatch.setattr(similar, "CHUNK_ROWS", 100)
    x = clustered(500, 12)
    keys = np.random.default_rng(2).permutation(5000)[:500]
    got, want = found(frame(spark, keys, x).repartition(3), dim=12, factor=1.0), truth(keys, x, 10)
    assert sum(set(got[i]) == set(want[i]) for i in want) >= 498  # two places in the sixth digit may tie


def test_relaxed_search_finds_most(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARD_ROWS", 100)
    x, keys = clustered(1500, 32), np.arange(1500)
    got, want = found(frame(spark, keys, x), dim=32), truth(keys, x, 10)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) > 0.95


def test_equal_vectors_ties_and_unusable_ones(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARD_ROWS", 40)
    x = clustered(200, 8)
    x[50:80] = x[50]  # thirty equal ones
    x[90] = x[91]
    rows_ = [(i, v.tolist()) for i, v in enumerate(x)]
    rows_ += [(0, x[0].tolist()), (50, x[50].tolist()), (900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] + [1.0] * 7), (905, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").withColumn("members", F.lit(1)).withColumn("cell", F.lit(2))
    got, want = found(df, dim=8, factor=1.0), truth(np.arange(200), x, 10)
    assert set(got) == set(range(200))
    assert got[75] == list(range(50, 60)) and got[55] == [50, 51, 52, 53, 54, 56, 57, 58, 59, 60] and got[90][0] == 91
    assert sum(set(got[i]) == set(want[i]) for i in want) >= 198
    pairs = similar.neighbour_pairs(similar.nearest(df, "vec_id", "embedding", 8, factor=1.0)).collect()
    assert all(r.vec_a < r.vec_b for r in pairs) and len(set(pairs)) == len(pairs)


def test_few_and_no_vectors(spark):
    df = frame(spark, [3, 1, 2], np.eye(3, dtype=np.float32))
    assert found(df, dim=3) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert found(df.where("vec_id = 1"), dim=3) == {} and found(df.limit(0), dim=3) == {}
    same = frame(spark, range(20), np.ones((20, 3), dtype=np.float32))
    assert found(same, dim=3)[19] == list(range(10))


def test_values_below_zero_where_they_are_wanted(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(-50, 51)], "k string, v double")
    got = quantiles.percentiles(quantiles.day_sketches(df, ["k"], F.lit("2024-01-01"), "v", least=None), ["k"]).first()
    assert (got.n, got.p50, got.p95) == (101, 0.0, 45.0)


def test_the_bound_is_shared_out_among_the_percentiles(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    days = quantiles.day_sketches(df, ["k"], F.lit("2024-01-01"), "v", k=32)
    one, three = (quantiles.percentiles(days, ["k"], ps, k=32).first().rank_error for ps in ((0.5,), (0.5, 0.95, 0.99)))
    assert 0 < one < three
