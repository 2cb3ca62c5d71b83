"""Search, quantisation, threads, text, net, percentiles: goldens, boundary tables and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import kernels, net, text
from quern.functions import vector as V
from quern.operators import hierarchy, lexical, percentile
from quern.operators import search as S
from quern.operators import threads as T
from quern.plans import harness, settings


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(20260709)
    x = rng.normal(size=(600, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[8]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    return x.astype(np.float64), base


def brute(x, q, k):
    d = ((x[q][:, None, :] - x[None]) ** 2).sum(axis=2)
    d[np.arange(len(q)), q] = np.inf
    return {i: np.lexsort((np.arange(len(x)), d[n].round(12)))[:k].tolist() for n, i in enumerate(q)}


def lists(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return out


def test_exact_search_equals_brute_force_both_ways(data, monkeypatch):
    x, base = data
    q = base.where("vec_id in (0, 7, 100, 499)")
    want = brute(x, [0, 7, 100, 499], 8)
    assert lists(S.exact_knn(base, q, 32, 8)) == want
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(S, "BASE_ROWS", 150)
    monkeypatch.setattr(S, "QUERY_ROWS", 2)
    assert lists(S.exact_knn(base, q, 32, 8, root=True)) == want


def test_exact_search_measures_like_the_expression(data):
    _, base = data
    hits = S.exact_knn(base, base.where("vec_id = 3"), 32, 5)
    one = base.where("vec_id = 3").select(F.col("embedding").alias("q"))
    direct = base.join(one, F.lit(True)).select("vec_id", V.l2_squared(F.col("q"), F.col("embedding")).alias("d2"))
    want = {r.vec_id: r.d2 for r in direct.collect()}
    assert all(r.d2 == want[r.vec_id] for r in hits.collect())


def test_search_of_nothing(spark, data):
    _, base = data
    assert S.exact_knn(base.limit(0), base.limit(2), 32, 3).count() == 0
    assert S.exact_knn(base, base.limit(0), 32, 3).count() == 0
    bad = spark.createDataFrame([(1, None), (None, [1.0] * 32), (2, [1.0]), (3, [None] + [1.0] * 31)], "vec_id long, embedding array<float>")
    assert S.valid(bad, "vec_id", "embedding", 32).count() == 0


def test_two_stages_find_most(data):
    x, base = data
    q = base.where("vec_id % 100 = 0")
    want, got = brute(x, list(range(0, 600, 100)), 10), lists(S.two_stage_knn(base, q, 32, 10, 200))
    assert np.mean([harness.recall(got[i], want[i]) for i in want]) > 0.9


def test_graph_search_finds_most(data):
    x, base = data
    q = base.where("vec_id % 100 = 0")
    want, got = brute(x, list(range(0, 600, 100)), 10), lists(S.graph_knn(base, q, 32, 10, shard_rows=200))
    assert np.mean([harness.recall(got[i], want[i]) for i in want]) > 0.9


def test_graph_and_pruning_see_the_whole_table(spark, tmp_path):
    from quern.plans import search

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    x[350:] = x[:350] + rng.normal(size=(350, 64)).astype(np.float32) * 0.01  # the nearest one is always in another block
    x[5:200] = x[5] + rng.normal(size=(195, 64)).astype(np.float32) * 1e-3  # more near ones than are asked for at first
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float64)
    want = brute(x, list(range(len(x))), 8)
    got = search.knn_graph(spark, str(tmp_path)).withColumnsRenamed({"node": "qid", "slot": "rank", "nbr": "vec_id"})
    assert lists(got) == want
    dist = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    pruned = {i: [int(j) for j in kernels.prune(np.where(np.arange(len(x)) == i, np.inf, dist[i]), dist, 8) if j != i] for i in range(len(x))}
    got = search.robust_prune(spark, str(tmp_path)).withColumnsRenamed({"node": "qid", "slot": "rank", "nbr": "vec_id"})
    assert lists(got) == pruned


def test_rotation_keeps_lengths_and_codes_agree_at_one_bit(data):
    x, _ = data
    r = kernels.rotate(x[:, :20])
    assert r.shape[1] == 32 and np.allclose((r * r).sum(axis=1), (x[:, :20] ** 2).sum(axis=1))
    c = kernels.rotate(x) - kernels.rotate(x).mean(axis=0)
    a = kernels.estimate_bits(c[:3], *kernels.encode_bits(c, np.zeros(32)))
    assert np.allclose(a, kernels.estimate_extended(c[:3], c, 1))
    assert kernels.estimate_bits(c[:1], np.ones((1, 32)), np.array([0.25]), np.array([0.0]))[0, 0] == 0.25


def test_prune_drops_what_a_kept_one_covers():
    pts = np.array([[1.0, 0], [1.1, 0], [0, 3.0], [0, 1.0]])
    d, between = np.linalg.norm(pts, axis=1), np.linalg.norm(pts[:, None] - pts[None], axis=2)
    assert kernels.prune(d, between, 4) == [0, 3]


def test_federated_merge_golden(spark, rows):
    hits = spark.createDataFrame([(1, "a", "1000", 0.5), (1, "a", "1001", 0.3), (1, "b", "9000", 0.2), (1, "b", "1001", 0.9)], "qid long, shard string, ext_id string, d2 double")
    assert rows(S.federated(hits, 3), "rank", "ext_id", "d2") == [(1, "9000", 0.2), (2, "1001", 0.3), (3, "1000", 0.5)]
    assert S.federated(hits, 0).count() == 1 and S.federated(hits.limit(0), 3).count() == 0


def test_threads_golden(spark, rows):
    hits = spark.createDataFrame([(1, 1001, 0.1), (1, 1002, 0.2), (1, 2000, 0.1), (1, 3001, 0.4), (1, 77, 0.0)], "qid long, vec_id long, d2 double")
    tree = spark.createDataFrame([(1000, 1000, 0), (1001, 1000, 1), (1002, 1000, 2), (2000, 2000, 0), (3001, 3000, 1)], "id long, root_id long, depth int")
    items = spark.createDataFrame([(1000, "one", 1160418092), (2000, None, 0)], "id long, title string, ts long")
    t = T.with_roots(T.ordered(T.hits_by_thread(hits, tree)), items).persist()
    assert rows(t, "pos", "root_id", "n_hits", "hits", "title", "date") == [(1, 1000, 2, "1001:1 1002:2", "one", "9 Oct 2006"), (2, 2000, 1, "", "", ""), (3, 3000, 1, "3001:1", "", "")]
    assert rows(T.by_day(t), "day_pos", "root_id") == [(1, 1000), (2, 2000), (3, 3000)]
    assert rows(T.page(t, 5, 2), "root_id") == [(3000,)]


def by_sql(sql, *changes, d="/root/testdata/sf0.01"):
    """Rows of a query's SQL, with the places that state the former, smaller job changed."""
    import duckdb

    for old, new in changes:
        assert old in sql
        sql = sql.replace(old, new)
    c = duckdb.connect()
    for t in ("item", "embed_response_item", "embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c.execute(sql).fetchall()


def test_threads_are_made_of_all_raw_hits(spark, rows):
    from quern.plans import threads

    want = by_sql(threads.ORACLE["thread_order"])
    assert rows(threads.thread_order(spark, "/root/testdata/sf0.01")) == sorted(want)


def test_pending_chains_resolve_whatever_their_order(spark, rows):
    items = spark.createDataFrame([(1, 0), (2, 1), (3, 99)], "id long, parent long")
    pending = spark.createDataFrame([(12, 11), (11, 10), (10, 2), (20, 3), (21, 20), (30, 98), (31, 30), (40, 41), (41, 40), (2, 1), (50, None)], "id long, parent long")
    assert rows(T.resolve_pending(hierarchy.stored_fields(hierarchy.build_trees(items)), pending)) == [
        (10, "appended", 1, 2, 0), (11, "appended", 1, 3, 0), (12, "appended", 1, 4, 0), (20, "appended", 20, 0, 1), (21, "appended", 21, 0, 1),
        (30, "pending", None, None, None), (31, "pending", None, None, None), (40, "pending", None, None, None), (41, "pending", None, None, None), (50, "appended", 50, 0, 0),
    ]


def test_percentile_rules(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.lognormal(3, 2, 999).round(1).tolist(), "b": [5.0], "c": [0.0, 0.0, 7.0, -3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None, float("nan")]], "g string, v double")
    for rule in ("linear", "floor"):
        for r in percentile.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}, rule).collect():
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
                want = (harness.percentile_linear if rule == "linear" else harness.percentile_floor)(values[r.g], p)
                assert r[name] == pytest.approx(want) and r.n == len(values[r.g])
    assert percentile.exact_percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).count() == 0


def test_bm25_prefers_rare_words_and_drops_self(spark, rows):
    docs = spark.createDataFrame([(1, "x", "alpha beta"), (2, "x", "alpha alpha gamma"), (3, "x", "beta"), (4, None, "alpha"), (5, "x", None), (6, "x", "")], "doc_id long, lang string, text string")
    q = spark.createDataFrame([(1, "gamma alpha"), (9, None), (8, "!?")], "qid long, title string")
    got = rows(lexical.bm25(docs, q, "doc_id", "lang", "text", "title", 5), "qid", "shard", "rank", "doc_id")
    assert got == [(1, None, 1, 4), (1, "x", 1, 2)]


def test_bm25_folds_accents_on_both_sides(spark, rows):
    docs = spark.createDataFrame([(1, "x", "Caf\u00e9 au lait"), (2, "x", "cafe\u0301 noir"), (3, "x", "CAFE"), (4, "x", "tea")], "doc_id long, lang string, text string")
    q = spark.createDataFrame([(9, "caf\u00e8")], "qid long, title string")
    assert rows(lexical.bm25(docs, q, "doc_id", "lang", "text", "title", 5), "doc_id") == [(1,), (2,), (3,)]


def test_lexical_stage_keeps_200_of_titles_and_texts(spark, rows):
    from quern.plans import threads

    want = by_sql(threads.ORACLE["scope_ratio"])
    got = rows(threads.scope_ratio(spark, "/root/testdata/sf0.01"))
    assert [r[:2] for r in got] == sorted(r[:2] for r in want)


def test_two_stages_keep_their_candidates_and_find_most(spark, rows):
    from quern.plans import search

    assert S.CANDIDATES >= 128
    assert rows(search.recall_summary(spark, "/root/testdata/sf0.01")) == by_sql(search.ORACLE["recall_summary"])
    assert search.recall_summary(spark, "/root/testdata/sf0.1").first().recall_mean >= 0.9


def test_search_keeps_k_per_query_over_many_batches():
    rng = np.random.default_rng(3)
    parts = [[np.repeat(np.arange(5), 7), rng.integers(0, 99, 35), rng.integers(0, 6, 35).astype(float)] for _ in range(9)]
    kept = None
    for part in parts:
        kept = S._merged(kept, part, 4) if kept else S._merged(part, [x[:0] for x in part], 4)
    for q in range(5):
        every = sorted((d, i) for p in parts for a, i, d in zip(*p) if a == q)[:4]
        assert [(d, i) for a, i, d in zip(*kept) if a == q] == every


@pytest.mark.parametrize("raw, want", [("<p>a</P>b &amp;lt; &lt;c&gt;", "a\n\nb &lt; <c>"), (" x<i>y</i>\n ", "xy"), ("", ""), (None, None)])
def test_html_to_text(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.html_to_text(F.col("t"))).first()[0] == want


def test_cuts(spark):
    df = spark.createDataFrame([("é" * 200,), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(text.cut(F.col("t"), 160)).collect()] == ["é" * 160 + "…", "short", None]
    for s in ("aé漢👍" * 3, "", "漢", "👍👍", "ab"):
        for n in range(4, 20):
            got = spark.createDataFrame([(s,)], "t string").select(text.utf8_cut(F.col("t"), n)).first()[0] if n in (4, 5, 6, 7, 11) else None
            if got is not None:
                assert got == s.encode()[:n].decode("utf-8", "ignore")


def test_dates_ids_and_queries(spark):
    df = spark.createDataFrame([(1160418091,), (0,), (-5,), (None,)], "ts long")
    assert [r[0] for r in df.select(text.short_date(F.col("ts"))).collect()] == ["9 Oct 2006", "", "", ""]
    df = spark.createDataFrame([(" 12 ",), ("x",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.parse_id("s")).collect()] == [12, None, None, None]
    assert text.match_query('a "b" c') == '"a" OR """b""" OR "c"' and text.match_query("  ") == ""


def test_preview_takes_first_and_falls_back():
    page = "<head><meta content='T' property=\"og:title\"><meta property=og:title content=no><title>x</title><meta name=description content='D &amp; E'></head><meta property='og:image' content='late'>"
    assert text.preview(page) == {"title": "T", "description": "D & E", "image": "", "site_name": ""}
    assert text.preview("<title> a &lt; b </title>")["title"] == "a < b" and text.preview("")["title"] == ""


@pytest.mark.parametrize("ip, want", [("8.8.8.8", True), ("10.1.2.3", False), ("100.64.0.1", False), ("127.0.0.1", False), ("169.254.1.1", False), ("198.18.0.1", False), ("240.0.0.1", False), ("224.0.0.1", False), ("::1", False), ("fe80::1", False), ("::ffff:10.0.0.1", False), ("2001:4860:4860::8888", True), ("x", False)])
def test_public_addresses(spark, ip, want):
    assert net.is_public(ip) is want
    if ":" not in ip:
        df = spark.createDataFrame([(ip,)], "ip string")
        assert df.select(net.ipv4_is_public(net.ipv4_number(F.col("ip")))).first()[0] is want


def test_urls_and_clients():
    assert net.may_fetch("https://example.org/x") and not net.may_fetch("ftp://example.org") and not net.may_fetch("http://10.0.0.1/") and not net.may_fetch("http:///x") and not net.may_fetch("http://localhost/")
    assert net.client_ip("1.2.3.4:5", "9.9.9.9, 8.8.8.8", True) == "8.8.8.8" and net.client_ip("1.2.3.4:5", "9.9.9.9", False) == "1.2.3.4" and net.client_ip("[::1]:80", None, True) == "::1"


def test_settings_tables():
    assert [settings.clamp_k(v) for v in (None, "", "x", "0", "-1", "7", "100", "101")] == [10, 10, 10, 10, 10, 7, 100, 100]
    assert [settings.window_margin(a, b) for a, b in ((None, 5), (100, 228), (101, 228), (0, 10), (5, None))] == ["unverifiable", "ok", "refuse", "unverifiable", "unverifiable"]
    assert settings.parse_ints("1, 2,3") == [1, 2, 3] and [settings.medium_of(x) for x in ("1", "0\n", "", None)] == ["rotational", "ssd", "unknown", "unknown"]
    for bad in ("", "a", "0"):
        with pytest.raises(ValueError):
            settings.parse_ints(bad, 1)
    assert settings.verdict_overlap(0.9, 0) and not settings.verdict_overlap(0.95, 1) and settings.verdict_hybrid(0.5, 0.504, 10, 9) and settings.verdict_insert([1.0], [0.995])


def test_metrics():
    assert harness.recall([1, 1, 2], [1, 3]) == 1.0 and harness.recall([1], []) == 0.0
    assert harness.overlap([1, 2, 3], [2, 3], 5) == 1.0 and harness.overlap([1], [], 5) == 0.0
    assert harness.percentile_linear([1, 2, 3, 4], 0.5) == 2.5 and harness.percentile_floor([1, 2, 3, 4], 0.5) == 2 and harness.percentile_linear([], 0.5) == 0.0


def test_protocol_rows_and_cached_truth(spark, data, tmp_path):
    _, all_rows = data
    base, q = all_rows.where("vec_id >= 20").limit(200), all_rows.where("vec_id < 5")
    truth = harness.ground_truth(spark, base, q, 32, 5, str(tmp_path / "gt"))
    assert truth.count() == 25 and harness.ground_truth(spark, base, q, 32, 5, str(tmp_path / "gt")).count() == 25
    assert harness.ground_truth(spark, base, q, 32, 4, str(tmp_path / "gt")).count() == 20
    rows_ = harness.run_protocol(harness.TwoStageEngine(32), base, q, 5, sweep=(20, 180), concurrency=(1, 2), seconds=0.2)
    assert len(rows_) == 4 and all(r["p99_ms"] >= r["p50_ms"] and r["qps"] > 0 for r in rows_)
    assert rows_[0]["recall_mean"] == rows_[1]["recall_mean"] <= rows_[2]["recall_mean"]
    assert harness.run_protocol(harness.AutoEngine(32), base, q, 5, sweep=(0,), seconds=0.1)[0]["recall_mean"] == 1.0


def test_plans_push_filters_and_columns(spark):
    d = "/root/testdata/sf0.001"
    from quern.plans import core, threads

    plan = threads.bulk_items(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(title)" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]
    plan = core.p2_found(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "text" not in plan


def test_bm25_equals_sql_on_odd_documents_in_any_division_and_shuffles_no_score(spark, rows, tmp_path, monkeypatch):
    """Repeated and missing ids, one id in two shards, equal scores, empty texts; several passes, slices and blocks."""
    import duckdb

    from quern.plans import threads

    rng = np.random.default_rng(3)
    pick = lambda n: " ".join(rng.choice(["the", "cache", "slow", "é", "x7", "node", "日本", *map(str, range(20))], n))
    docs = [(int(i), pick(rng.integers(0, 9)), ["en", "fr", None][i % 3], pick(rng.integers(0, 40)) if i % 300 else None) for i in range(1201)]
    docs += [(100, "cache the", "en", docs[100][3]), (100, "cache", "fr", docs[100][3]), (100, docs[100][1], docs[100][2], docs[100][3]), (200, None, None, "node slow"), (None, "the cache", "en", "x7"), (None, "the cache", "en", "x7"), (7, "!?", "de", "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(0, 900, 2)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {q: sorted((tuple(r) for r in con.execute(threads.ORACLE[q]).fetchall()), key=str) for q in ("bm25_topn", "hybrid_knn", "scope_ratio")}
    same = lambda q: sorted((tuple(r) for r in getattr(threads, q)(spark, str(tmp_path)).collect()), key=str) == want[q]
    assert want["bm25_topn"] and same("bm25_topn")
    for name, value in {"WORDS": 64, "PAIRS": 40, "KEPT_BYTES": 20_000, "BLOCK": 50, "SLICES": 2}.items():
        monkeypatch.setattr(lexical, name, value)
    assert same("bm25_topn") and same("hybrid_knn") and same("scope_ratio")
    plan = threads.bm25_topn(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
