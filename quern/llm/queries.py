"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, lookalike, markup, packing, quantiles, similar, wrapper
from quern.tables import table


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """(src, name, param, value, at): the values of both measured columns that count, finite and not below zero."""
    q = table(spark, d, "perquery", "engine", "param", "latence_ms", "run_at")
    q = q.select(F.lit("perquery"), "engine", "param", "latence_ms", "run_at")
    r = table(spark, d, "results_sifta_horosvec_arena", "dataset", "param", "p99_ms", "measured_at")
    r = r.select(F.lit("results"), "dataset", "param", "p99_ms", "measured_at")
    names = ("src", "name", "param", "value", "at")
    v = F.col("value")
    return q.toDF(*names).unionByName(r.toDF(*names)).where((v >= 0) & ~F.isnan(v) & (v < float("inf")))


def _day_sketches(spark: SparkSession, d: str, k: int = quantiles.K) -> DataFrame:
    """(src, name, param, day, sketch) of both measured columns."""
    return quantiles.day_sketches(_measured(spark, d), ["src", "name", "param"], F.col("at"), "value", k)


_GROUP = ["src", "name", "param"]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """50th, 95th and 99th percentile per group over all days, with the bound of their rank error."""
    return quantiles.percentiles(_day_sketches(spark, d), _GROUP)


def _months(spark: SparkSession, d: str, k: int = quantiles.K) -> DataFrame:
    days = _day_sketches(spark, d, k).withColumn("month", F.date_format("day", "yyyy-MM"))
    return quantiles.percentiles(days, [*_GROUP, "month"], k=k)


def p1_months(spark: SparkSession, d: str) -> DataFrame:
    """The same per calendar month, from the sketches of its days."""
    return _months(spark, d)


def _held_against(rows: DataFrame, got: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """(*keys, n, within): whether every answer is within its bound of the exact rank.

    ``least``: groups with more values must have been compacted, that is, have a bound above zero.
    """
    got = got.select(*[F.col(c).alias(f"q_{c}") for c in keys], "n", "p50", "p95", "p99", "rank_error")
    on = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"q_{c}"))
        on = one if on is None else on & one
    both = rows.join(got, on)
    aggs, ok, v = [], F.lit(True), F.col("value")
    slack = F.col("rank_error") * F.col("n") + 1e-6 * F.col("n") + 1e-9
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        aggs += [F.count_if(v < F.col(name)).alias(f"lt_{name}"), F.count_if(v <= F.col(name)).alias(f"le_{name}")]
        ok = ok & (F.col(f"lt_{name}") <= F.col("n") * p + slack) & (F.col(f"le_{name}") >= F.col("n") * p - slack)
    if least:
        ok = ok & ((F.col("n") <= least) | (F.col("rank_error") > 0))
    return both.groupBy(*keys, "n", "rank_error").agg(*aggs).select(*keys, "n", ok.alias("within"))


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Holds every answer of p1_percentiles against its exact rank: (src, name, param, n, within)."""
    return _held_against(_measured(spark, d), p1_percentiles(spark, d), _GROUP)


#: Size of the top level of the small sketches that are tested under compaction, and the values that always compact one.
SMALL_K, SMALL_N = 16, 150


def p1_compacted_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """The same for sketches so small that every group of more than SMALL_N values was compacted."""
    got = quantiles.percentiles(_day_sketches(spark, d, SMALL_K), _GROUP, k=SMALL_K)
    return _held_against(_measured(spark, d), got, _GROUP, SMALL_N)


def p1_months_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """The same per calendar month."""
    rows = _measured(spark, d).withColumn("month", F.date_format("at", "yyyy-MM"))
    return _held_against(rows, _months(spark, d, SMALL_K), [*_GROUP, "month"], SMALL_N)


def _similar(spark: SparkSession, d: str, name: str) -> DataFrame:
    key, dim = {"dataset_base": ("vec_id", 64), "embed_response_item": ("item_id", 96)}[name]
    return similar.nearest(table(spark, d, name, key, "embedding"), key, "embedding", dim)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for name in ("dataset_base", "embed_response_item"):
        pairs = similar.neighbour_pairs(_similar(spark, d, name)).select(F.lit(name).alias("src"), "vec_a", "vec_b")
        rows = pairs if rows is None else rows.unionByName(pairs)
    return rows


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for name, key in (("item", "id"), ("hnitem", "seq")):
        found = markup.marked_up(table(spark, d, name, key, "text"), key, "text").select(F.lit(name).alias("src"), F.col(key).alias("id"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every item, once, and of every delivery."""
    item = markup.clean_column(table(spark, d, "item", "id", "text", "type"), "id", "text", "type").groupBy("id").agg(F.min("text").alias("text"))
    feed = markup.clean_column(table(spark, d, "hnitem", "seq", "text", "shard"), "seq", "text", "shard").select(F.col("seq").alias("id"), "text")
    return item.select(F.lit("item").alias("src"), "id", "text").unionByName(feed.select(F.lit("hnitem").alias("src"), "id", "text"))


def p7_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """Per host (shard of the feed, type of the store): all trees, nodes of the wrapper that the parts hand on and constant texts among them."""
    rows = None
    for name, key, host in (("item", "id", "type"), ("hnitem", "seq", "shard")):
        found = wrapper.wrappers(table(spark, d, name, key, "text", host), key, "text", host)
        found = found.select(F.lit(name).alias("src"), F.col("q_host").alias("host"), F.col("q_pages").alias("n_trees"), F.col("q_nodes").alias("n_nodes"), F.col("q_constant").alias("n_constant"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """One row per container with its documents."""
    sizes = bpe.count_column(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    return packing.contents(packing.pack(sizes, "doc_id"), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_to_a_reader(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with a text: its class of texts that look the same, and its links to other texts."""
    return lookalike.classes(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return lookalike.canonical_column(table(spark, d, "documents", "doc_id", "text"), "doc_id")


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_months, p1_within_bound, p1_compacted_within_bound, p1_months_within_bound, p5_found, p7_found, p7_clean, p7_wrappers, p8_ids, p9_packed, p10_found, p10_classes, p10_forms)}

_VALUES = """
WITH v AS (SELECT 'perquery' AS src, engine AS name, param, latence_ms AS v, run_at AS t FROM perquery
  UNION ALL SELECT 'results', dataset, param, p99_ms, measured_at FROM results_sifta_horosvec_arena)
"""
_WITHIN = _VALUES + "SELECT src, name, param, count(*) AS n, true AS within FROM v WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1, 2, 3"
_MONTHS = _VALUES + "SELECT src, name, param, strftime(t, '%Y-%m') AS month, count(*) AS n, true AS within FROM v WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1, 2, 3, 4"

ORACLE = {"p1_within_bound": _WITHIN, "p1_compacted_within_bound": _WITHIN, "p1_months_within_bound": _MONTHS}
