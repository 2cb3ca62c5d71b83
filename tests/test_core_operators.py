"""References, increments, hierarchies and skewed keys against brute force, with dirty rows."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import hierarchy, incremental, references, skew

# --- references -------------------------------------------------------------------------------


def _ledger(item, pending=None):
    deltas = [references.existence_deltas(item, "id"), references.reference_deltas(item, "parent")]
    return references.apply_deltas(None, deltas + ([references.reference_deltas(pending, "parent")] if pending is not None else []))


def test_orphans_with_nulls_repeats_and_clashing_columns(spark, rows):
    item = spark.createDataFrame([(1, None, 7), (2, 0, 7), (3, 1, 7), (3, 1, 7), (4, 99, 7), (4, 99, 8), (None, 98, 1)], "id long, parent long, ref_key int")
    pending = spark.createDataFrame([(5, 97, 0), (6, 3, 0), (7, None, 0)], "id long, parent long, refs int")
    got = references.orphan_records(_ledger(item, pending), {"item": item, "pending": pending})
    assert rows(got) == [("item", None), ("item", 4), ("pending", 5)]


def test_orphans_of_empty_tables(spark, rows):
    item = spark.createDataFrame([], "id long, parent long")
    assert rows(references.orphan_records(_ledger(item), {"item": item})) == []


def test_ledger_is_the_sum_of_its_deltas(spark, rows):
    day1 = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "id long, parent long")
    one = _ledger(day1)
    assert rows(references.orphan_keys(one)) == [(9,)]
    arrived = spark.createDataFrame([(9, 0)], "id long, parent long")
    gone = spark.createDataFrame([(1, 0)], "id long, parent long")
    two = references.apply_deltas(one, [references.existence_deltas(arrived, "id"), references.existence_deltas(gone, "id", -1), references.reference_deltas(gone, "parent", -1)])
    assert rows(references.orphan_keys(two)) == [(1,)]


# --- increments -------------------------------------------------------------------------------

CONTENT = ["title", "text"]


def test_version_tells_null_from_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, None, "x"), (4, "x", None)], "id long, title string, text string")
    v = {r.id: bytes(r.v) for r in df.select("id", incremental.content_version(CONTENT).alias("v")).collect()}
    assert v[1] == v[3] and len({v[1], v[2], v[4]}) == 3


def test_changed_since_last_good_run(spark, rows):
    feed = spark.createDataFrame(
        [
            (1, "a", 1, "t", "x", 5), (2, "a", 1, "t", "x", 50),  # delivered again, equal
            (3, "a", 2, "t", "x", 5), (4, "a", 2, "t", "y", 50),  # changed after the run
            (5, "a", 3, "t", "x", 50),  # only seen after the run
            (6, "a", 9, "t", "x", 5),  # beyond the run's position
            (7, "b", 1, "t", "x", 5),  # shard whose runs failed
            (8, None, 1, "t", "x", 5),
            (9, "a", 4, None, "x", 5), (10, "a", 4, None, "x", 60),
        ],
        "seq long, shard string, id long, title string, text string, fetched_at long",
    )
    runs = spark.createDataFrame([(1, "a", 10, 8, "ok"), (1, "a", 10, 8, "ok"), (2, "a", 99, 99, "error"), (3, "b", None, None, "running")], "id long, shard string, ended_at long, head_pos long, status string")
    source = incremental.latest_version(feed, ["shard", "id"], ["fetched_at", "seq"], CONTENT)
    target = incremental.published_at_last_run(feed, runs, CONTENT)
    assert rows(incremental.changed(source, target, ["shard", "id"]), "shard", "id") == [(None, 1), ("a", 2), ("a", 3), ("a", 9), ("b", 1)]
    nothing = feed.limit(0)
    assert rows(incremental.changed(incremental.latest_version(nothing, ["shard", "id"], ["fetched_at", "seq"], CONTENT), target, ["shard", "id"])) == []


def test_versioned_target_publishes_whole_runs_only(spark, rows, tmp_path):
    t = incremental.VersionedTarget(spark, f"file://{tmp_path}/t", ["id"])
    first = spark.createDataFrame([(1, "a"), (2, "a")], "id long, version string")
    assert t.read() is None and t.run(first) == 1
    second = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, version string")
    assert rows(t.pending(second)) == [(2, "b"), (3, "a")]

    def fails(df):
        raise RuntimeError("stopped part-way")

    with pytest.raises(RuntimeError):
        t.run(second, fails)
    assert t.versions() == [1] and rows(t.pending(second)) == [(2, "b"), (3, "a")]
    assert t.run(second) == 2
    assert rows(t.read()) == [(1, "a"), (2, "b"), (3, "a")] and rows(t.pending(second)) == []
    assert rows(t.read(1)) == [(1, "a"), (2, "a")]


def test_two_runs_cannot_publish_one_version(spark, tmp_path, monkeypatch):
    t = incremental.VersionedTarget(spark, f"file://{tmp_path}/t", ["id"])
    df = spark.createDataFrame([(1, "a")], "id long, version string")
    t.publish(df)
    monkeypatch.setattr(t, "manifest", lambda version=None: {"version": 0, "parts": []})
    with pytest.raises(RuntimeError):
        t.publish(df)


# --- hierarchies ------------------------------------------------------------------------------


def walk(pairs):
    """Brute force: id to (root, depth, ending)."""
    parent = {}
    for i, p in pairs:
        if i is not None:
            p = p or None
            parent[i] = p if i not in parent else min((x for x in (p, parent[i]) if x is not None), default=None)
    out = {}
    for i in parent:
        at, steps, seen = i, 0, set()
        while True:
            if at in seen:
                out[i] = (i, 0, "cycle")
                break
            seen.add(at)
            p = parent[at]
            if p is None:
                out[i] = (at, steps, "root")
                break
            if p not in parent:
                out[i] = (i, 0, "missing")
                break
            at, steps = p, steps + 1
    return out


def check_trees(spark, pairs):
    df = spark.createDataFrame(pairs, "id long, parent long").withColumn("size", F.lit("x")).withColumn("leaf", F.lit(1))
    tree = hierarchy.build_trees(df).persist()
    got = {r.id: (r.root_id, r.depth, r.ending) for r in hierarchy.stored_fields(tree).collect()}
    assert got == walk(pairs)
    nodes = {r.id: r for r in tree.collect()}
    for r in nodes.values():
        if r.tree_id is not None and r.parent in nodes:
            up = nodes[r.parent]
            assert up.entry < r.entry < r.exit < up.exit and up.tree_id == r.tree_id
        if r.entry is not None:
            assert r.exit - r.entry + 1 == 2 * r.size
    spans = sorted((r.tree_id, r.entry) for r in nodes.values() if r.tree_id is not None)
    assert len(set(spans)) == len(spans)
    return tree


@pytest.mark.parametrize("part", [1 / 64, 0.9, 0.0])
def test_trees_with_chain_star_cycle_and_missing(spark, monkeypatch, part):
    monkeypatch.setattr(hierarchy, "CORE_PART", part)
    pairs = [(1, 0), (2, None)]
    pairs += [(10 + i, 9 + i if i else 1) for i in range(70)]  # chain below 1, longer than any fixed cap
    pairs += [(200 + i, 2) for i in range(120)]  # star below 2
    pairs += [(400, 402), (401, 400), (402, 401), (403, 402), (404, 403), (405, 405)]  # circles and what leads into them
    pairs += [(500, 999), (501, 500), (502, 501), (503, 999)]
    pairs += [(600, 700), (700, 0), (600, 700), (700, 0), (None, 1)]
    high = 1 << 62 if part == 0.9 else 0  # ids beyond 2**62
    check_trees(spark, [(i + high, p and p + high) for i, p in pairs if i] + [(None, 1)])


def test_trees_of_random_parents(spark):
    rng = random.Random(5)
    ids = rng.sample(range(1, 5000), 400)
    check_trees(spark, [(i, rng.choice([0, None, 7777, *ids])) for i in ids])


def test_trees_of_an_empty_table(spark, rows):
    assert rows(hierarchy.build_trees(spark.createDataFrame([], "id long, parent long"))) == []


def test_siblings_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BUCKET_ROWS", 25)
    monkeypatch.setattr(hierarchy, "CORE_PART", 0.9)
    check_trees(spark, [(1, 0), *[(10 + i, 1) for i in range(80)], *[(200 + i, 10 + i % 7) for i in range(60)]])


def test_paths_ancestors_and_descendants(spark, rows):
    pairs = [(1, 0), (2, 1), (3, 2), (4, 1), (5, 9), (6, 5), (7, 8), (8, 7)]
    tree = check_trees(spark, pairs)
    assert rows(hierarchy.paths(tree)) == [(1, [1]), (2, [1, 2]), (3, [1, 2, 3]), (4, [1, 4]), (5, [5]), (6, [5, 6])]
    ask = spark.createDataFrame([(3,), (1,)], "id long")
    assert rows(hierarchy.ancestors_of(tree, ask), "id", "ancestor") == [(3, 1), (3, 2)]
    assert rows(hierarchy.descendants_of(tree, ask), "id", "descendant") == [(1, 2), (1, 3), (1, 4)]


@pytest.mark.parametrize("part", [1 / 64, 0.9, 0.0])
def test_subtrees_below_circles_whatever_the_peeling(spark, rows, monkeypatch, part):
    monkeypatch.setattr(hierarchy, "CORE_PART", part)
    pairs = [(1, 2), (2, 3), (3, 1), (8, 8), (20, 0), (21, 20), (22, 21), (23, 22)]  # two circles, a tree
    pairs += [(100, 1), (101, 100), (102, 101), (103, 101), (104, 103), (105, 100), (106, 1), (107, 106), (110, 8), (111, 8), (112, 111)]
    pairs += [(200 + i, 199 + i if i else 2) for i in range(40)]  # a chain into a circle
    pairs += [(300, 999), (301, 300), (302, 301)]
    parent, on = {i: p or None for i, p in pairs}, {1, 2, 3, 8}
    up = {}
    for i in parent:
        up[i], at = [i], parent[i]
        while i not in on and at in parent and at not in on:
            up[i], at = [at, *up[i]], parent[at]
    below = {i: {j for j in parent if j not in on and i in up[j]} - {i} for i in parent}
    tree = check_trees(spark, pairs)
    got = {r.id: r for r in tree.collect()}
    assert {i: r.size for i, r in got.items()} == {i: None if i in on else len(below[i]) + 1 for i in parent}
    assert {i: r.top for i, r in got.items()} == {i: None if i in on else up[i][0] for i in parent}
    spans = [(r.top, r.entry) for r in got.values() if r.top is not None]
    assert len(set(spans)) == len(spans)
    assert rows(hierarchy.paths(tree)) == sorted((i, up[i]) for i in parent if i not in on)
    ask = spark.createDataFrame([(i,) for i in parent], "id long")
    assert rows(hierarchy.descendants_of(tree, ask), "id", "descendant") == sorted((i, j) for i in parent if i not in on for j in below[i])


# --- skew -------------------------------------------------------------------------------------


def skewed(spark, n=4000):
    rng = random.Random(3)
    keys = [rng.choice([1, 1, 1, 2, None, rng.randint(100, 400)]) for _ in range(n)]
    return keys, spark.createDataFrame([(k, i % 50 if i % 9 else None, 1) for i, k in enumerate(keys)], "root_id long, ts long, q_task int")


def test_aggregate_by_key_equals_group_by(spark, rows):
    keys, df = skewed(spark)
    plan = skew.plan_loads(df, "root_id", tasks=6)
    assert plan.total == len(keys) and set(plan.heavy) >= {1, 2} and len(plan.heavy) <= 6 / skew.HEAVY_PART
    assert len(plan.heavy[1]) > 1 and max(plan.loads) < 1.3 * sum(plan.loads) / 6
    got = skew.aggregate_by_key(df, "root_id", [("root_id", "count", "n"), ("ts", "min", "lo"), ("ts", "max", "hi"), ("ts", "sum", "s")], plan)
    want = df.where("root_id is not null").groupBy("root_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum("ts").alias("s"))
    assert rows(got) == rows(want)


def test_heavy_key_is_spread_over_tasks(spark):
    keys, df = skewed(spark)
    plan = skew.plan_loads(df, "root_id", tasks=6)
    per = [r.n for r in skew.place(df.where("root_id is not null").drop("q_task"), "root_id", plan).groupBy("q_task").agg(F.count("*").alias("n")).collect()]
    assert max(per) < 1.6 * sum(per) / 6


def test_fragment_replicate_join_equals_join(spark, rows):
    _, df = skewed(spark, 1500)
    plan = skew.plan_loads(df, "root_id", tasks=6)
    right = spark.createDataFrame([(1, "a"), (1, "b"), (150, "c"), (None, "d"), (9999, "e")], "k long, name string")
    for how in ("inner", "left"):
        got = skew.fragment_replicate_join(df.select("root_id", "ts"), right, "root_id", "k", plan, how)
        assert rows(got) == rows(df.select("root_id", "ts").join(right, F.col("root_id") == F.col("k"), how))


def test_skew_of_an_empty_table(spark, rows):
    df = spark.createDataFrame([], "root_id long, ts long")
    assert rows(skew.aggregate_by_key(df, "root_id", [("ts", "min", "lo")])) == []


# --- kept states ------------------------------------------------------------------------------


def test_versions_are_claimed_once_and_parts_compacted(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(incremental, "COMPACT_PARTS", 3)
    target = incremental.VersionedTarget(spark, f"file://{tmp_path}/t", ["id"])
    for i in range(5):
        assert target.publish(spark.createDataFrame([(i, f"v{i}"), (99, f"v{i}")], "id long, version string")) == i + 1
    assert len(target.manifest()["parts"]) < 4
    assert rows(target.read()) == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "v3"), (4, "v4"), (99, "v4")]
    assert target._claim(5) == 6
    with pytest.raises(RuntimeError):  # a run that is between its claim and its manifest
        target.publish(spark.createDataFrame([(7, "x")], "id long, version string"))
    assert target.versions() == [1, 2, 3, 4, 5]
    monkeypatch.setattr(incremental, "CLAIM_SECONDS", -1)
    assert target.publish(spark.createDataFrame([(7, "x")], "id long, version string")) == 6


def test_ledger_after_changes_equals_a_recount(spark, rows):
    item = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 9), (4, 2), (5, None), (6, 4)], "id long, parent long")
    latest = spark.createDataFrame([(2, 1, True), (3, 8, False), (7, 6, None), (8, 0, False), (11, 1, True), (None, 3, False), (6, 4, False)], "id long, parent long, deleted boolean")
    kept = references.apply_deltas(None, [references.existence_deltas(item, "id"), references.reference_deltas(item, "parent")])
    after = references.apply_deltas(kept, references.change_deltas(item, latest))
    now = spark.createDataFrame([(1, 0), (3, 8), (4, 2), (5, None), (6, 4), (7, 6), (8, 0)], "id long, parent long")
    again = references.apply_deltas(None, [references.existence_deltas(now, "id"), references.reference_deltas(now, "parent")])
    assert rows(after) == rows(again)
    assert rows(references.orphan_keys(after)) == [(2,)]


def test_kept_trees_follow_their_files(spark, tmp_path, rows):
    path = f"{tmp_path}/item.parquet"
    spark.createDataFrame([(1, 0), (2, 1)], "id long, parent long").write.parquet(path)
    one = hierarchy.kept_trees(spark.read.parquet(path))
    assert rows(one, "id", "tree_id") == [(1, 1), (2, 1)] and hierarchy.kept_trees(spark.read.parquet(path)).inputFiles() == one.inputFiles()
    spark.createDataFrame([(3, 2)], "id long, parent long").write.mode("append").parquet(path)
    assert rows(hierarchy.kept_trees(spark.read.parquet(path)), "id", "level") == [(1, 0), (2, 1), (3, 2)]
