"""Queries over items, deliveries, runs and documents: joins, trees, thread search, text, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import net, text
from quern.operators import hierarchy, lexical, percentile
from quern.operators import search as S
from quern.operators import threads as T
from quern.plans.core import _TREE
from quern.tables import table

DIM, K = 96, 10
#: Raw hits of a query before they are grouped by thread, the reference's default.
K_RAW = 300
#: Documents of a shard that the lexical stage keeps, as in the reference.
BM25_LIMIT = 200
#: Bytes of a text that are embedded.
TEXT_BYTES = 24_000


# --- loads, lookups, upserts ------------------------------------------------------------------


def bulk_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "item", "id", "ts", "type", "title", "parent").where(F.col("title").isNotNull())


def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "item", "id", "type", "title", "parent")
    return it.where(F.col("id") == it.agg(F.min("id")).scalar()).distinct()


def last_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_log", "id", "shard", "status", "head_pos").distinct().orderBy(F.col("id").desc()).limit(10)


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last write of every id."""
    feed = table(spark, d, "hnitem", "id", "seq", "fetched_at", "type", "title", "dead")
    return feed.groupBy("id").agg(F.max_by(F.struct("seq", "type", "title", "dead"), F.struct("fetched_at", "seq")).alias("r")).select("id", "r.*")


def dedupe_events(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries kept and skipped per shard when every id counts once."""
    feed = table(spark, d, "hnitem", "shard", "id").groupBy("shard", "id").agg(F.count("*").alias("n"))
    return feed.groupBy("shard").agg(F.count("*").alias("n_kept"), F.sum(F.col("n") - 1).alias("n_skipped"))


def new_items_anti(spark: SparkSession, d: str) -> DataFrame:
    alive = table(spark, d, "hnitem", "id", "dead", "deleted").where(~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)))
    return alive.select("id").distinct().join(table(spark, d, "item", "id"), "id", "left_anti")


def items_with_vector(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "embed_response_item", "item_id", "embedding").where(F.col("embedding").isNotNull())
    return table(spark, d, "item", "id").distinct().join(have, F.col("id") == F.col("item_id"), "left_semi")


def calendar_shards(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "item", "id", "ts", "title", "text").where(F.col("ts").isNotNull() & ((F.col("title") != "") | (F.col("text") != "")))
    return it.groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month")).agg(F.countDistinct("id").alias("n_items"))


# --- joins ------------------------------------------------------------------------------------


def _hit_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "perquery", "engine", "param", "topk_ids").select("engine", "param", F.explode("topk_ids").alias("ext_id"))


def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _hit_ids(spark, d).withColumn("q_id", text.parse_id("ext_id"))
    return rows.groupBy("engine").agg(F.count("q_id").alias("n_valid"), F.count_if(F.col("q_id").isNull()).alias("n_invalid"))


def hits_items_join(spark: SparkSession, d: str) -> DataFrame:
    """Hits per engine and setting that name an item, counted before the join so that repeated ids travel once."""
    hits = _hit_ids(spark, d).select("engine", "param", text.parse_id("ext_id").alias("q_id")).where(F.col("q_id").isNotNull())
    hits = hits.groupBy("engine", "param", "q_id").agg(F.count("*").alias("n"))
    known = table(spark, d, "item", "id").distinct()
    return hits.join(known, F.col("q_id") == F.col("id")).groupBy("engine", "param").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_items"))


def thread_roots_join(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "item", "id", "root_id", "title")
    sizes = it.where(F.col("root_id").isNotNull()).groupBy("root_id").agg(F.count("*").alias("n_rows"))
    roots = it.groupBy(F.col("id").alias("q_id")).agg(F.min("title").alias("title"))
    return sizes.join(roots, F.col("root_id") == F.col("q_id"), "left").select("root_id", "n_rows", F.coalesce("title", F.lit("")).alias("title"))


def parent_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Tree fields of every id whose parent has some, derived from the parent's stored ones."""
    it = table(spark, d, "item", "id", "parent", "root_id", "depth", "orphan").groupBy("id").agg(*[F.min(c).alias(c) for c in ("parent", "root_id", "depth", "orphan")])
    up = it.select(F.col("id").alias("p_id"), F.col("root_id").alias("p_root"), F.col("depth").alias("p_depth"), F.col("orphan").alias("p_orphan"))
    rows = it.select("id", "parent").join(up, F.col("parent") == F.col("p_id"), "left")
    top, lost = F.coalesce(F.col("parent"), F.lit(0)) == 0, F.col("p_orphan") == 1
    rows = rows.where(top | (F.col("p_id").isNotNull() & F.col("p_root").isNotNull()))
    return rows.select("id", F.when(top | lost, F.col("id")).otherwise(F.col("p_root")).alias("root_id"), F.when(top | lost, 0).otherwise(F.col("p_depth") + 1).alias("depth"), F.when(~top & F.coalesce(lost, F.lit(False)), 1).otherwise(0).alias("orphan"))


# --- trees and threads ------------------------------------------------------------------------


def _trees(spark: SparkSession, d: str) -> DataFrame:
    """Right tree fields of the items, from the kept table of trees."""
    return hierarchy.stored_fields(hierarchy.kept_trees(table(spark, d, "item", "id", "parent")))


def tree_backfill(spark: SparkSession, d: str) -> DataFrame:
    trees = hierarchy.stored_fields(hierarchy.build_trees(table(spark, d, "item", "id", "parent")))
    return trees.select("id", "root_id", "depth", "orphan")


def append_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return T.resolve_pending(_trees(spark, d), table(spark, d, "pending", "id", "parent"))


def thread_sizes(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "item", "root_id", "depth", "orphan").where((F.col("orphan") == 0) & F.col("root_id").isNotNull())
    return it.groupBy("root_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("depth") == 1).alias("n_direct"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "item", "id").groupBy("id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    it = table(spark, d, "item", "id", "ts", "root_id", "depth", "orphan")
    one = it.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.countDistinct(F.when(F.col("orphan") == 0, F.col("root_id"))).alias("n_threads"), F.count_if(F.col("orphan") == 1).alias("n_orphans"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return one.withColumn("n_pending", table(spark, d, "pending", "id").agg(F.count("*")).scalar())


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "item", "ts").agg(F.coalesce(F.max("ts"), F.lit(0)).alias("max_ts"), F.coalesce(text.short_date(F.max("ts")), F.lit("")).alias("freshness"))


def _hits(spark: SparkSession, d: str, k_raw: int = K_RAW) -> DataFrame:
    """The ``k_raw`` nearest item vectors of every item vector whose id is divisible by 100."""
    v = table(spark, d, "embed_response_item", "item_id", "embedding")
    base = S.valid(v, "item_id", "embedding", DIM).where(F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).distinct()
    return S.exact_knn(base, base.where(F.col("vec_id") % 100 == 0), DIM, k_raw)


def _threads(spark: SparkSession, d: str, k_raw: int = K_RAW) -> DataFrame:
    return T.ordered(T.hits_by_thread(_hits(spark, d, k_raw), _trees(spark, d)))


def thread_score(spark: SparkSession, d: str) -> DataFrame:
    return _threads(spark, d).select("qid", "root_id", "score", "n_hits")


def thread_order(spark: SparkSession, d: str) -> DataFrame:
    return _threads(spark, d).select("qid", "pos", "root_id")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return T.with_roots(_threads(spark, d), table(spark, d, "item", "id", "title", "ts"))


def thread_search(spark: SparkSession, d: str) -> DataFrame:
    return _titled(spark, d).select("qid", "pos", "root_id", "title", "date", "score", "n_hits", "hits")


def sort_newest(spark: SparkSession, d: str) -> DataFrame:
    return T.by_day(_titled(spark, d)).select("qid", "day_pos", "root_id")


def sort_oldest(spark: SparkSession, d: str) -> DataFrame:
    return T.by_day(_titled(spark, d), newest=False).select("qid", "day_pos", "root_id")


def page_threads(spark: SparkSession, d: str) -> DataFrame:
    return T.page(_threads(spark, d), 1).select("qid", "pos", "root_id")


# --- lexical and hybrid search ----------------------------------------------------------------


def _lexical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and those of them whose titles are the queries."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "title")
    asked = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), "title")
    return docs.select("doc_id", "lang", F.concat_ws("\n", "title", "text").alias("q_text")), asked


def bm25_topn(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(*_lexical(spark, d), "doc_id", "lang", "q_text", "title", 10).select("qid", "shard", "rank", "doc_id", "score")


def hybrid_knn(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates of all shards, reordered by exact distance; queries and documents without a vector drop out."""
    base = S.valid(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64)
    docs, asked = _lexical(spark, d)
    asked = asked.join(base.select("vec_id"), F.col("qid") == F.col("vec_id"), "left_semi")
    cand = lexical.candidates(docs, asked, "doc_id", "lang", "q_text", "title", BM25_LIMIT)
    return S.rerank(cand.withColumnRenamed("doc_id", "vec_id"), base, base.where(F.col("vec_id") % 100 == 0), K)


def scope_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Part of all documents that the lexical stage leaves for reordering, per query."""
    cand = lexical.candidates(*_lexical(spark, d), "doc_id", "lang", "q_text", "title", BM25_LIMIT)
    cand = cand.groupBy("qid").agg(F.count("*").alias("n_candidates"))
    total = table(spark, d, "documents", "doc_id").agg(F.count("*")).scalar()
    return cand.select("qid", "n_candidates", F.round(F.col("n_candidates") / total, 9).alias("ratio"))


# --- text -------------------------------------------------------------------------------------


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "title")
    return docs.select("doc_id", F.md5(text.text_or_title(F.col("text"), F.col("title"))).alias("digest"))


def title_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.cut(F.col("text"), 160).alias("snippet"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hnitem", "seq", "text").select("seq", F.md5(text.html_to_text(F.col("text"))).alias("digest"))


def text_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hnitem", "seq", "text").select("seq", text.snippet(F.col("text")).alias("snippet"))


def utf8_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut = text.utf8_cut(F.col("text"), TEXT_BYTES)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.octet_length(cut).alias("n_bytes"), F.md5(cut).alias("digest"))


def item_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "item", "id", "ts").distinct().select("id", F.coalesce(text.short_date(F.col("ts")), F.lit("")).alias("date"))


def date_back(spark: SparkSession, d: str) -> DataFrame:
    """Days per month, read back from the written dates."""
    day = text.parse_short_date(text.short_date(F.col("ts")))
    rows = table(spark, d, "item", "ts").select(day.alias("day")).distinct()
    return rows.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("day").alias("n_days"))


def id_codec(spark: SparkSession, d: str) -> DataFrame:
    """Ids as eight bytes and back."""
    raw = text.id_to_bytes(F.col("id"))
    rows = table(spark, d, "item", "id").distinct()
    return rows.select("id", F.lower(F.hex(raw)).alias("bytes"), text.bytes_to_id(raw).alias("back"))


def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Items that still need a vector: a valid id, a text to embed, and none so far."""
    it = table(spark, d, "item", "id", "text", "title").where((F.col("id") >= 0) & (F.coalesce(text.text_or_title(F.col("text"), F.col("title")), F.lit("")) != ""))
    have = table(spark, d, "embed_response_item", "item_id", "embedding").where(F.col("embedding").isNotNull())
    return it.select("id").distinct().join(have, F.col("id") == F.col("item_id"), "left_anti")


def url_host(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hnitem", "text").select(net.url_host(F.col("text")).alias("host")).where(F.col("host").isNotNull())
    return rows.groupBy("host").agg(F.count("*").alias("n_rows"))


def page_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hnitem", "seq", "title", "text").select("seq", F.coalesce(text.page_title(F.col("text")), F.col("title"), F.lit("")).alias("title"))


def ip_is_public(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of the event ids, read back from text and classified."""
    n = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))
    ip = F.concat_ws(".", *[F.pmod(F.floor(n / s), F.lit(256)).cast("string") for s in (16777216, 65536, 256, 1)])
    rows = table(spark, d, "events", "event_id").select("event_id", ip.alias("ip"))
    return rows.select("event_id", "ip", net.ipv4_is_public(net.ipv4_number(F.col("ip"))).alias("is_public"))


def sample_queries(spark: SparkSession, d: str) -> DataFrame:
    stories = table(spark, d, "item", "id", "type", "title").where((F.col("type") == "story") & (F.col("title") != "")).select("id").distinct()
    return stories.orderBy(F.md5(F.col("id").cast("string")), "id").limit(200)


# --- metrics ----------------------------------------------------------------------------------

_PS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("latence_ms")
    return table(spark, d, "perquery", "engine", "param", "latence_ms").where((v >= 0) & ~F.isnan(v) & (v < float("inf")))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = percentile.exact_percentiles(_latencies(spark, d), ["engine", "param"], "latence_ms", _PS)
    return out.select("engine", "param", "n", *[F.round(p, 6).alias(p) for p in _PS])


def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    return percentile.exact_percentiles(_latencies(spark, d), ["engine", "param"], "latence_ms", _PS, "floor")


def validation_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "perquery", "engine", "param", "topk_ids", "overlap")
    empty = F.coalesce(F.size("topk_ids"), F.lit(0)) <= 0
    out = rows.groupBy("engine", "param").agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(~F.isnan("overlap"), F.col("overlap"))), 6).alias("overlap_mean"), F.count_if(empty).alias("n_empty"))
    return out.withColumn("passed", (F.col("overlap_mean") >= 0.9) & (F.col("n_empty") == 0))


def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    """Requests a token bucket lets through per user (one token a minute, five at most), in order of time.

    A user's events are read in order from a sorted partition, with one row of state; no group is held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, tokens, last, yes, no = None, 5.0, None, 0, 0
        for f in frames:
            out = []
            for u, t in zip(f["user_id"].tolist(), f["t"].tolist()):
                if u != user:
                    if user is not None:
                        out.append((user, yes, no))
                    user, tokens, last, yes, no = u, 5.0, t, 0, 0
                tokens, last = min(5.0, tokens + (t - last) / 60e6), t
                if tokens >= 1:
                    tokens, yes = tokens - 1, yes + 1
                else:
                    no += 1
            yield pd.DataFrame(out, columns=["user_id", "n_allowed", "n_refused"])
        if user is not None:
            yield pd.DataFrame([(user, yes, no)], columns=["user_id", "n_allowed", "n_refused"])

    e = table(spark, d, "events", "user_id", "ts", "event_id").where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    e = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return e.select("user_id", "t").mapInPandas(run, "user_id bigint, n_allowed bigint, n_refused bigint")


QUERIES = {
    f.__name__: f
    for f in (bulk_items, item_lookup, last_runs, upsert_latest, dedupe_events, new_items_anti, items_with_vector, calendar_shards, parse_ids, hits_items_join, thread_roots_join, parent_self_join, tree_backfill, append_fixpoint, thread_sizes, duplicate_ids, store_stats, freshness, thread_score, thread_order, thread_search, sort_newest, sort_oldest, page_threads, bm25_topn, hybrid_knn, scope_ratio, embed_text, title_snippet, html_to_text, text_snippet, utf8_truncate, item_date, date_back, id_codec, embed_pending, url_host, page_preview, ip_is_public, sample_queries, latency_percentiles, percentile_floor, validation_verdict, rate_limit_replay)
}

_WANT = """, want AS (SELECT id, CASE WHEN ending = 'root' THEN tree_id ELSE id END AS root_id,
  CASE WHEN ending = 'root' THEN level ELSE 0 END::INTEGER AS depth, CASE WHEN ending = 'root' THEN 0 ELSE 1 END AS orphan, ending FROM tree)"""
_DATE = "CASE WHEN {ts} > 0 THEN strftime(make_timestamp({ts} * 1000000), '%-d %b %Y') ELSE '' END"
_HITS = _TREE + _WANT + """, e AS (SELECT DISTINCT item_id AS vec_id, embedding FROM embed_response_item WHERE item_id IS NOT NULL AND len(embedding) = 96
  AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), true))
, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM e)
, hits AS (SELECT a.vec_id AS qid, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d2, b.vec_id) <= 300)
, th AS (SELECT qid, root_id, round(1 + 0.1 * ln(sum(exp((exp(-d2 / 0.1) - 1) / 0.1))), 9) AS score, count(*) AS n_hits,
  coalesce(string_agg(vec_id || ':' || depth, ' ' ORDER BY depth, vec_id) FILTER (WHERE vec_id <> root_id), '') AS hits FROM hits JOIN want ON vec_id = id GROUP BY 1, 2)
, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, root_id::VARCHAR)::INTEGER AS pos FROM th)
, roots AS (SELECT id, min(title) AS title, min(ts) AS ts FROM item GROUP BY id)
, titled AS (SELECT o.*, coalesce(r.title, '') AS title, coalesce(""" + _DATE.format(ts="r.ts") + """, '') AS date, CASE WHEN r.ts > 0 THEN make_timestamp(r.ts * 1000000)::DATE END AS day FROM o LEFT JOIN roots r ON o.root_id = r.id)
"""
# the same letters without their marks on both sides, and marks of their own
_TERMS = rf"""regexp_extract_all(regexp_replace(translate(lower({{}}), '{lexical._MARKED}', '{lexical._PLAIN}'), '[\x{{{{0300}}}}-\x{{{{036f}}}}]', '', 'g'), '[\p{{{{L}}}}\p{{{{N}}}}]+')"""
_BM25 = "WITH w AS (SELECT doc_id, lang, " + _TERMS.format("concat_ws(chr(10), title, text)") + r""" AS ws FROM documents),
p AS (SELECT lang, doc_id, len(ws) AS dl, unnest(ws) AS term FROM w), post AS (SELECT lang, doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
st AS (SELECT lang, count(*) AS n, avg(len(ws)) AS avgdl FROM w WHERE len(ws) > 0 GROUP BY lang), df AS (SELECT lang, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT DISTINCT doc_id AS qid, unnest(""" + _TERMS.format("coalesce(title, '')") + r""") AS term FROM documents WHERE doc_id % 100 = 0),
sc AS (SELECT a.qid, p.lang AS shard, p.doc_id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))), 6) AS score
  FROM asked a JOIN post p ON a.term = p.term JOIN st s ON p.lang IS NOT DISTINCT FROM s.lang JOIN df d ON d.term = p.term AND d.lang IS NOT DISTINCT FROM p.lang WHERE a.qid <> p.doc_id GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc)
"""
_CLEAN = r"""regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '</?p>', chr(10) || chr(10), 'gi'), '<[^>]+>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g')"""
_LAT = "WITH v AS (SELECT engine, param, latence_ms AS v FROM perquery WHERE latence_ms >= 0 AND NOT isnan(latence_ms) AND NOT isinf(latence_ms))"
_CLOSED = " OR ".join(f"n BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in net._CLOSED)

ORACLE = {
    "bulk_items": "SELECT id, ts, type, title, parent FROM item WHERE title IS NOT NULL",
    "item_lookup": "SELECT DISTINCT id, type, title, parent FROM item WHERE id = (SELECT min(id) FROM item)",
    "last_runs": "SELECT DISTINCT id, shard, status, head_pos FROM run_log ORDER BY id DESC LIMIT 10",
    "upsert_latest": "SELECT id, seq, type, title, dead FROM hnitem QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, seq DESC) = 1",
    "dedupe_events": "SELECT shard, count(DISTINCT id) AS n_kept, (count(*) - count(DISTINCT id))::BIGINT AS n_skipped FROM hnitem GROUP BY shard",
    "new_items_anti": "SELECT DISTINCT id FROM hnitem WHERE NOT coalesce(dead, false) AND NOT coalesce(deleted, false) AND id NOT IN (SELECT id FROM item WHERE id IS NOT NULL)",
    "items_with_vector": "SELECT DISTINCT id FROM item WHERE id IN (SELECT item_id FROM embed_response_item WHERE embedding IS NOT NULL)",
    "calendar_shards": "SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, count(DISTINCT id) AS n_items FROM item WHERE ts IS NOT NULL AND (title <> '' OR text <> '') GROUP BY 1",
    "parse_ids": "SELECT engine, count(try_cast(trim(x) AS BIGINT)) AS n_valid, count(*) - count(try_cast(trim(x) AS BIGINT)) AS n_invalid FROM (SELECT engine, unnest(topk_ids) AS x FROM perquery) GROUP BY engine",
    "hits_items_join": "SELECT engine, param, count(*) AS n_hits, count(DISTINCT h) AS n_items FROM (SELECT engine, param, try_cast(trim(x) AS BIGINT) AS h FROM (SELECT engine, param, unnest(topk_ids) AS x FROM perquery)) WHERE h IN (SELECT id FROM item) GROUP BY 1, 2",
    "thread_roots_join": "WITH s AS (SELECT root_id, count(*) AS n_rows FROM item WHERE root_id IS NOT NULL GROUP BY 1), r AS (SELECT id, min(title) AS title FROM item GROUP BY id) SELECT s.root_id, s.n_rows, coalesce(r.title, '') AS title FROM s LEFT JOIN r ON s.root_id = r.id",
    "parent_self_join": """WITH i AS (SELECT id, min(parent) AS parent, min(root_id) AS root_id, min(depth) AS depth, min(orphan) AS orphan FROM item GROUP BY id)
SELECT c.id, CASE WHEN coalesce(c.parent, 0) = 0 OR p.orphan = 1 THEN c.id ELSE p.root_id END AS root_id, CASE WHEN coalesce(c.parent, 0) = 0 OR p.orphan = 1 THEN 0 ELSE p.depth + 1 END AS depth,
 CASE WHEN coalesce(c.parent, 0) <> 0 AND coalesce(p.orphan = 1, false) THEN 1 ELSE 0 END AS orphan FROM i c LEFT JOIN i p ON c.parent = p.id WHERE coalesce(c.parent, 0) = 0 OR (p.id IS NOT NULL AND p.root_id IS NOT NULL)""",
    "tree_backfill": _TREE + _WANT + " SELECT id, root_id, depth, orphan FROM want",
    "append_fixpoint": _TREE + _WANT + """, pn AS (SELECT id, min(nullif(parent, 0)) AS parent FROM pending WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM n) GROUP BY id)
, pw AS (SELECT p.id, 'appended' AS state, p.id AS root_id, 0 AS depth, 0 AS orphan FROM pn p WHERE p.parent IS NULL
  UNION ALL SELECT p.id, 'appended', CASE WHEN w.orphan = 0 THEN w.root_id ELSE p.id END, CASE WHEN w.orphan = 0 THEN w.depth + 1 ELSE 0 END, w.orphan FROM pn p JOIN want w ON p.parent = w.id)
, pr AS (SELECT * FROM pw UNION ALL SELECT p.id, 'appended', CASE WHEN r.orphan = 0 THEN r.root_id ELSE p.id END, CASE WHEN r.orphan = 0 THEN r.depth + 1 ELSE 0 END, r.orphan FROM pn p JOIN pw r ON p.parent = r.id)
, pr2 AS (SELECT * FROM pr UNION ALL SELECT p.id, 'appended', CASE WHEN r.orphan = 0 THEN r.root_id ELSE p.id END, CASE WHEN r.orphan = 0 THEN r.depth + 1 ELSE 0 END, r.orphan FROM pn p JOIN pr r ON p.parent = r.id WHERE p.id NOT IN (SELECT id FROM pr))
, pr3 AS (SELECT * FROM pr2 UNION ALL SELECT p.id, 'appended', CASE WHEN r.orphan = 0 THEN r.root_id ELSE p.id END, CASE WHEN r.orphan = 0 THEN r.depth + 1 ELSE 0 END, r.orphan FROM pn p JOIN pr2 r ON p.parent = r.id WHERE p.id NOT IN (SELECT id FROM pr2))
SELECT p.id, coalesce(r.state, 'pending') AS state, r.root_id, r.depth::INTEGER AS depth, r.orphan FROM pn p LEFT JOIN pr3 r ON p.id = r.id""",
    "thread_sizes": "SELECT root_id, count(*) AS n_rows, count(*) FILTER (WHERE depth = 1) AS n_direct FROM item WHERE orphan = 0 AND root_id IS NOT NULL GROUP BY root_id",
    "duplicate_ids": "SELECT id, count(*) AS n_rows FROM item GROUP BY id HAVING count(*) > 1",
    "store_stats": "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, min(ts) AS min_ts, max(ts) AS max_ts, count(DISTINCT CASE WHEN orphan = 0 THEN root_id END) AS n_threads, count(*) FILTER (WHERE orphan = 1) AS n_orphans, coalesce(max(depth), 0) AS max_depth, (SELECT count(*) FROM pending) AS n_pending FROM item",
    "freshness": f"SELECT coalesce(max(ts), 0) AS max_ts, coalesce({_DATE.format(ts='max(ts)')}, '') AS freshness FROM item",
    "thread_score": _HITS + "SELECT qid, root_id, score, n_hits FROM th",
    "thread_order": _HITS + "SELECT qid, pos, root_id FROM o",
    "thread_search": _HITS + "SELECT qid, pos, root_id, title, date, score, n_hits, hits FROM titled",
    "sort_newest": _HITS + "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY day DESC NULLS LAST, pos)::INTEGER AS day_pos, root_id FROM titled",
    "sort_oldest": _HITS + "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY day ASC NULLS LAST, pos)::INTEGER AS day_pos, root_id FROM titled",
    "page_threads": _HITS + ", c AS (SELECT *, least(1, greatest(1, ceil(count(*) OVER (PARTITION BY qid) / 10)) - 1) AS page FROM o) SELECT qid, pos, root_id FROM c WHERE pos > page * 10 AND pos <= (page + 1) * 10",
    "bm25_topn": _BM25 + "SELECT qid, shard, rank, doc_id, score FROM rk WHERE rank <= 10",
    "hybrid_knn": _BM25 + """, c AS (SELECT DISTINCT qid, doc_id FROM rk WHERE rank <= 200), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT c.qid, c.doc_id AS vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM c JOIN e a ON c.qid = a.vec_id JOIN e b ON c.doc_id = b.vec_id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id)::INTEGER AS rank, vec_id, d2 FROM d QUALIFY rank <= 10""",
    "scope_ratio": _BM25 + "SELECT qid, count(DISTINCT doc_id) AS n_candidates, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 9) AS ratio FROM rk WHERE rank <= 200 GROUP BY qid",
    "embed_text": "SELECT doc_id, md5(coalesce(nullif(text, ''), title)) AS digest FROM documents",
    "title_snippet": "SELECT doc_id, CASE WHEN length(text) > 160 THEN substring(text, 1, 160) || '…' ELSE text END AS snippet FROM documents",
    "html_to_text": f"SELECT seq, md5({_CLEAN}) AS digest FROM hnitem",
    "text_snippet": f"SELECT seq, CASE WHEN length(c) > 140 THEN substring(c, 1, 140) || '…' ELSE c END AS snippet FROM (SELECT seq, {_CLEAN} AS c FROM hnitem)",
    "utf8_truncate": f"""WITH c AS (SELECT doc_id, CASE WHEN strlen(text) <= {TEXT_BYTES} THEN text
  ELSE substring(text, 1, (SELECT max(i) FROM range({TEXT_BYTES // 4}, least(length(text), {TEXT_BYTES}) + 1) t(i) WHERE strlen(substring(text, 1, i)) <= {TEXT_BYTES})) END AS cut FROM documents)
SELECT doc_id, strlen(cut)::INTEGER AS n_bytes, md5(cut) AS digest FROM c""",
    "rate_limit_replay": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT user_id, rn, t, 4.0::DOUBLE AS tokens, 1 AS yes FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, t, CASE WHEN has >= 1 THEN has - 1 ELSE has END, CASE WHEN has >= 1 THEN 1 ELSE 0 END
  FROM (SELECT e.user_id, e.rn, e.t, least(5.0::DOUBLE, b.tokens + (e.t - b.t) / 60e6::DOUBLE) AS has FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1))
SELECT user_id, sum(yes)::BIGINT AS n_allowed, (count(*) - sum(yes))::BIGINT AS n_refused FROM b GROUP BY user_id""",
    "item_date": f"SELECT DISTINCT id, coalesce({_DATE.format(ts='ts')}, '') AS date FROM item",
    "date_back": "SELECT strftime(day, '%Y-%m') AS month, count(day) AS n_days FROM (SELECT DISTINCT CASE WHEN ts > 0 THEN make_timestamp(ts * 1000000)::DATE END AS day FROM item) GROUP BY 1",
    "id_codec": "SELECT DISTINCT id, array_to_string(list_transform(range(0, 8), lambda i: lpad(to_hex((id >> (8 * i)) & 255), 2, '0')), '').lower() AS bytes, id AS back FROM item",
    "embed_pending": "SELECT DISTINCT id FROM item WHERE id >= 0 AND coalesce(nullif(text, ''), title, '') <> '' AND id NOT IN (SELECT item_id FROM embed_response_item WHERE embedding IS NOT NULL AND item_id IS NOT NULL)",
    "url_host": r"""SELECT host, count(*) AS n_rows FROM (SELECT lower(nullif(regexp_extract(text, 'https?://([^/\s"''<>?#)\]]+)', 1), '')) AS host FROM hnitem) WHERE host IS NOT NULL GROUP BY host""",
    "page_preview": r"SELECT seq, coalesce(nullif(regexp_extract(text, '<title[^>]*>\s*(.*?)\s*</title>', 1, 'is'), ''), title, '') AS title FROM hnitem",
    "ip_is_public": f"SELECT event_id, concat_ws('.', n // 16777216, (n // 65536) % 256, (n // 256) % 256, n % 256) AS ip, NOT ({_CLOSED}) AS is_public FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events)",
    "sample_queries": "SELECT id FROM (SELECT DISTINCT id FROM item WHERE type = 'story' AND title <> '') ORDER BY md5(id::VARCHAR), id LIMIT 200",
    "latency_percentiles": _LAT + " SELECT engine, param, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM v GROUP BY 1, 2",
    "percentile_floor": _LAT + ", s AS (SELECT engine, param, count(*) AS n, list_sort(list(v)) AS l FROM v GROUP BY 1, 2) SELECT engine, param, n, l[floor(0.5 * (n - 1))::INTEGER + 1] AS p50, l[floor(0.95 * (n - 1))::INTEGER + 1] AS p95, l[floor(0.99 * (n - 1))::INTEGER + 1] AS p99 FROM s",
    "validation_verdict": "SELECT *, overlap_mean >= 0.9 AND n_empty = 0 AS passed FROM (SELECT engine, param, count(*) AS n_queries, round(avg(CASE WHEN overlap::VARCHAR <> 'nan' THEN overlap END), 6) AS overlap_mean, count(*) FILTER (WHERE coalesce(len(topk_ids), 0) = 0) AS n_empty FROM perquery GROUP BY 1, 2)",
}
