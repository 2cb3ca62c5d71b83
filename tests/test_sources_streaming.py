"""Binary and text formats, ingestion with replay and restart, rate limiting."""

import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import binary, files
from quern.streaming import ingest, ratelimit


@pytest.fixture(scope="module")
def vectors(spark):
    x = (np.arange(60, dtype=np.float32).reshape(20, 3) * 0.5).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rank long, embedding array<float>")


@pytest.mark.parametrize("kind", ["fvecs", "arena"])
def test_vectors_survive_a_round_trip(spark, vectors, tmp_path, kind):
    x, df = vectors
    path = str(tmp_path / f"v.{kind}")
    binary.write_binary(df, path, kind, "rank", "embedding", partitions=3)
    back = binary.read_binary(spark, path, kind)
    got = [r.embedding for r in back.orderBy(back.columns[0]).collect()]
    assert np.array_equal(np.array(got, dtype=np.float32), x)
    assert binary.read_binary(spark, path, kind, limit=7).count() == 7
    raw = open(path, "rb").read()
    assert raw[:8] == b"HVARENA1" and len(raw) == 24 + 20 * 6 if kind == "arena" else raw[:4] == struct.pack("<i", 3) and len(raw) == 20 * 16


def test_ids_are_joined_by_rank(spark, vectors, tmp_path):
    _, df = vectors
    ids = df.select("rank", (F.col("rank") * 3 + 2**33).cast("decimal(20,0)").alias("ext_id"))
    path = str(tmp_path / "ids")
    binary.write_binary(ids, path, "ids", "rank", "ext_id", partitions=2)
    got = binary.with_ids(df, binary.read_binary(spark, path, "ids")).select("rank", "ext_id").orderBy("rank").collect()
    assert [int(r.ext_id) for r in got] == [i * 3 + 2**33 for i in range(20)]


def test_ivecs_and_adjacency(spark, tmp_path):
    np.array([[2, 5, 6], [2, 7, 8]], dtype="<i4").tofile(tmp_path / "t.ivecs")
    assert [r.ids for r in binary.read_binary(spark, str(tmp_path / "t.ivecs"), "ivecs").orderBy("row").collect()] == [[5, 6], [7, 8]]
    np.array([1, 2, 0, 2, 0, 1], dtype="<u4").tofile(tmp_path / "g.adj")
    (tmp_path / "g.adj.json").write_text(json.dumps({"n": 3, "degree": 2}))
    got = binary.read_binary(spark, str(tmp_path / "g.adj"), "adjacency").orderBy("src", "slot").collect()
    assert [(r.src, r.dst) for r in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_broken_files_are_refused(tmp_path):
    for kind, raw in (("fvecs", struct.pack("<i", 0)), ("fvecs", struct.pack("<i", 3) + b"1234"), ("arena", b"X" * 24), ("arena", binary.ARENA_HEADER.pack(binary.ARENA_MAGIC, 1, 4, 10)), ("ids", b"123"), ("adjacency", b"12345678")):
        (tmp_path / "f").write_bytes(raw)
        with pytest.raises(ValueError):
            binary.layout(kind, str(tmp_path / "f"), 3)


def test_text_formats(spark, rows, tmp_path):
    (tmp_path / "v.jsonl").write_text("[1, 2.5]\n\n  \n[3, 4]\n")
    v = files.read_vectors(spark, str(tmp_path / "v.jsonl"))
    assert rows(v) == [([1.0, 2.5],), ([3.0, 4.0],)] and files.check_vectors(v) == 2
    (tmp_path / "bad.jsonl").write_text("[1, 2]\nno\n")
    with pytest.raises(Exception, match="not a vector"):
        files.read_vectors(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "q.json").write_text('{"queries": [{"qid": 7, "text": "a", "vector": [1, 2]}, {"qid": "x", "text": null, "vector": [3, 4]}]}')
    assert rows(files.read_query_batch(spark, str(tmp_path / "q.json")), "qid", "vector") == [("7", [1.0, 2.0]), ("x", [3.0, 4.0])]
    (tmp_path / "i.ndjson").write_text('{"id": 1, "ts": 5, "title": "t"}\n')
    assert rows(files.read_items(spark, str(tmp_path / "i.ndjson")), "id", "title", "parent") == [(1, "t", None)]


def test_checks_and_splits(spark, rows):
    df = spark.createDataFrame([(i, [1.0]) for i in range(10)], "vec_id long, embedding array<float>")
    base, q = files.split_holdout(df, "vec_id", 3, 5)
    assert rows(base, "vec_id") == [(i,) for i in range(5)] and rows(q, "vec_id") == [(7,), (8,), (9,)]
    for bad in (0, 10):
        with pytest.raises(ValueError):
            files.split_holdout(df, "vec_id", bad)
    with pytest.raises(ValueError):
        files.check_vectors(df.limit(0))
    with pytest.raises(ValueError):
        files.check_vectors(df.unionByName(spark.createDataFrame([(99, [1.0, 2.0])], df.schema)))


def test_shards_months_and_manifest(tmp_path):
    for n in ("b.db", "b.db.arena", "a.db", "a.arena", "c.db", "x.arena"):
        (tmp_path / n).write_text("")
    assert [s[0] for s in files.discover_shards(str(tmp_path))] == ["month:a", "month:b"]
    assert files.month_bounds(["2023-12"]) == [("2023-12", 1701388800, 1704067200)]
    files.write_manifest(str(tmp_path / "m.json"), {"magic": "M", "count": 3})
    assert files.read_manifest(str(tmp_path / "m.json"), "M")["count"] == 3
    with pytest.raises(ValueError):
        files.read_manifest(str(tmp_path / "m.json"), "other")


def test_random_vectors_do_not_depend_on_partitions(spark, rows):
    a = binary.random_vectors(spark, 50, 4)
    assert rows(a) == rows(binary.random_vectors(spark, 50, 4).repartition(7)) and all(0 <= x < 1 for r in a.collect() for x in r.embedding)


def _embed(texts):
    return [[float(len(t)), 1.0] for t in texts]


def _deliver(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(i) for i in items) + "\n")


def test_ingestion_survives_failure_and_replay(spark, rows, tmp_path):
    calls = {"fail": True}

    def flaky(texts):
        import os

        if os.path.exists(str(tmp_path / "fail")):
            raise RuntimeError("embedder down")
        return _embed(texts)

    del calls
    (tmp_path / "fail").write_text("")
    _deliver(tmp_path / "feed", "1", {"id": 1, "time": 1, "title": "a", "text": "abc"}, {"id": 2, "time": 1, "title": "dead", "dead": True}, {"id": 1, "time": 2, "title": "a", "text": "abcd"})
    job = ingest.Ingest(spark, str(tmp_path / "out"), flaky, 2)
    with pytest.raises(Exception):
        job.run(ingest.feed_files(spark, str(tmp_path / "feed")))
    assert job.items.versions() == []
    (tmp_path / "fail").unlink()
    job.run(ingest.feed_files(spark, str(tmp_path / "feed")))
    assert rows(job.items.read(), "id", "text") == [(1, "abcd")] and rows(job.vectors.read(), "id", "embedding") == [(1, [4.0, 1.0])]
    _deliver(tmp_path / "feed", "2", {"id": 1, "time": 2, "title": "a", "text": "abcd"}, {"id": 3, "time": 3, "title": "only title", "text": ""})
    job.run(ingest.feed_files(spark, str(tmp_path / "feed")))
    assert rows(job.items.read(), "id") == [(1,), (3,)] and rows(job.vectors.read(), "embedding")[1] == ([10.0, 1.0],)
    log = spark.read.parquet(str(tmp_path / "out" / "runs"))
    assert rows(log.groupBy("status").agg(F.sum("ingested").alias("n")), "status", "n") == [("error", 0), ("ok", 2)]
    before = job.items.versions()
    job.batch(spark.read.schema(ingest.FEED).json(str(tmp_path / "feed")), 99)
    assert job.items.versions() == before


def test_embedding_rejects_short_answers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert ingest.embed_column(df, "id", "text", _embed, 2).count() == 2
    with pytest.raises(Exception, match="2 texts, 1 vectors"):
        ingest.embed_column(df.coalesce(1), "id", "text", lambda t: _embed(t)[:1], 2).collect()


def test_id_feed_goes_on_where_it_ended(spark, rows, tmp_path):
    newest = tmp_path / "newest"
    newest.write_text("3")
    path = str(newest)

    def max_id():
        with open(path) as f:
            return int(f.read())

    def fetch(i):
        return None if i == 2 else (i, "story", i, f"t{i}", None, 0, False, False)

    spark.dataSource.register(ingest.feed_source(max_id, fetch, per_batch=2))
    for _ in range(2):
        q = spark.readStream.format("idfeed").load().writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        want = int(newest.read_text())
        for _ in range(100):
            time.sleep(0.1)
            if q.exception() or ((tmp_path / "o").exists() and spark.read.schema(ingest.FEED).parquet(str(tmp_path / "o")).where(F.col("id") == want).count()):
                break
        q.stop()
        newest.write_text("5")
    assert rows(spark.read.parquet(str(tmp_path / "o")), "id") == [(1,), (3,), (4,), (5,)]


def test_cycles_and_budgets():
    assert [list(r) for r in ingest.id_ranges(10, 13, 2, 5, None, 2)] == [[11, 12, 13], [3, 4]]
    assert [list(r) for r in ingest.id_ranges(10, 10, 5, 5, None, 0)] == [[], []]
    assert ingest.parse_budget("90s") == ("seconds", 90.0) and ingest.parse_budget("0s") == ("seconds", 0.0) and ingest.parse_budget("5") == ("items", 5)
    for bad in ("-1", "-5s", "", "x"):
        with pytest.raises(ValueError):
            ingest.parse_budget(bad)


def test_token_bucket(spark, rows, tmp_path):
    assert ratelimit.take(0.5, 0, 0.4, 1, 5) == (False, 0.9) and ratelimit.take(5, 0, 100, 1, 5) == (True, 4)
    src = spark.createDataFrame([("a", float(t)) for t in (0, 0, 0, 0, 0, 0, 2)] + [("b", 0.0), (None, 1.0)], "ip string, ts double")
    src.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = ratelimit.limited(spark.readStream.schema(src.schema).parquet(str(tmp_path / "e")), "ip", "ts").writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert rows(spark.table("limited").groupBy("ip").agg(F.count_if("allowed").alias("n")), "ip", "n") == [("a", 6), ("b", 1)]


def test_cycles_take_the_head_and_then_the_backfill(spark, rows, tmp_path):
    def fetch(i):
        if i == 4:
            return None
        return (i, "story", i, f"t{i}", f"text {i}", 0, i == 6, False)

    job = ingest.Ingest(spark, str(tmp_path / "out"), _embed, 2)
    assert job.cycle(8, fetch, backfill_budget="3", per_batch=2) == {"head": 8, "head_origin": 8, "backfill": 3}
    assert rows(job.items.read(), "id") == [(1,), (2,), (3,)]
    assert job.cycle(10, fetch, head_budget="1", backfill_budget="0s") == {"head": 9, "head_origin": 8, "backfill": 3}
    assert job.cycle(10, fetch, per_batch=3) == {"head": 10, "head_origin": 8, "backfill": 8}
    assert rows(job.live(), "id") == [(i,) for i in (1, 2, 3, 5, 7, 8, 9, 10)]
    log = spark.read.parquet(str(tmp_path / "out" / "runs"))
    assert rows(log.groupBy("phase").agg(F.sum("ingested").alias("n"), F.max("pos").alias("p")), "phase", "n", "p") == [("backfill", 6, 8), ("head", 2, 10)]

    def broken(i):
        if i == 12:
            raise RuntimeError("feed down")
        return fetch(i)

    with pytest.raises(Exception):
        job.cycle(13, broken, per_batch=1)
    assert job.cursors()["head"] == 11
    assert job.cycle(13, fetch)["head"] == 13 and rows(job.live(), "id")[-3:] == [(11,), (12,), (13,)]


def test_the_later_delivery_counts_and_deletions_reach_the_target(spark, rows, tmp_path):
    job = ingest.Ingest(spark, str(tmp_path / "out"), _embed, 2)
    schema = f"{ingest.FEED}, fetched_at timestamp, seq bigint"
    one = lambda i, text, at, seq, deleted=False: (i, "story", 5, "t", text, 0, False, deleted, at, seq)
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    job.batch(spark.createDataFrame([one(1, "new", t[1], 1), one(1, "old", t[0], 2), one(2, "x", t[1], 3), one(3, "gone", t[1], 4), one(3, "gone", t[2], 5, True)], schema), 1)
    assert rows(job.live(), "id", "text") == [(1, "new"), (2, "x")]
    job.batch(spark.createDataFrame([one(1, "older", t[0], 6), one(2, "x", t[3], 7, True)], schema), 2)
    assert rows(job.live(), "id", "text") == [(1, "new")] and rows(job.items.read(), "id") == [(1,), (2,)]
