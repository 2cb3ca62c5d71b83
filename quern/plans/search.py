"""Queries over vectors: functions, exact and quantised search, graphs, federation, recall.

The query set is every vector whose id is divisible by 100, searched against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import kernels
from quern.functions import vector as V
from quern.operators import search as S
from quern.tables import table

DIM, K = 64, 10


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.valid(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", DIM)


def _queries(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % 100 == 0)


def _first(base: DataFrame) -> DataFrame:
    """The vector with the smallest id, one row."""
    return base.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q_v"))


def _against_first(base: DataFrame) -> DataFrame:
    return base.withColumn("q_v", _first(base).scalar())


def dim_profile(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dataset_base", "vec_id", "embedding")
    n = F.size("embedding")
    return v.agg(F.count("*").alias("n_rows"), F.count("embedding").alias("n_vectors"), F.min(F.when(F.col("embedding").isNotNull(), n)).alias("min_dim"), F.max(F.when(F.col("embedding").isNotNull(), n)).alias("max_dim"))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 ids are queries, the others the base."""
    v = table(spark, d, "embeddings", "vec_id")
    last = F.broadcast(v.orderBy(F.col("vec_id").desc()).limit(20).select(F.col("vec_id").alias("q_id")))
    rows = v.join(last, F.col("vec_id") == F.col("q_id"), "left")
    return rows.select("vec_id", F.when(F.col("q_id").isNull(), "base").otherwise("query").alias("part"))


def l2_distance(spark: SparkSession, d: str) -> DataFrame:
    return _against_first(_vectors(spark, d)).select("vec_id", V.l2_distance(F.col("embedding"), F.col("q_v")).alias("dist"))


def l2_squared(spark: SparkSession, d: str) -> DataFrame:
    return _against_first(_vectors(spark, d)).select("vec_id", V.l2_squared(F.col("embedding"), F.col("q_v")).alias("d2"))


def _ends(v, n: int) -> list:
    return [F.round(F.element_at(v, 1), 9).alias("first"), F.round(F.element_at(v, n), 9).alias("last"), F.round(V.norm(v), 6).alias("norm")]


def normalize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dataset_base", "vec_id", "embedding").where((F.size("embedding") == DIM) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < 1e300)))
    v = v.distinct().withColumn("u", V.normalize(F.col("embedding")))
    return v.select("vec_id", *_ends(F.col("u"), DIM))


def mrl_truncate(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).withColumn("u", V.truncate(F.col("embedding"), 32))
    return v.select("vec_id", *_ends(F.col("u"), 32))


def pattern_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id").withColumn("p", V.pattern(F.col("vec_id"), DIM))
    return v.select("vec_id", F.element_at("p", 1).cast("int").alias("first"), F.element_at("p", DIM).cast("int").alias("last"), V.total(V.doubles(F.col("p"))).cast("long").alias("total"))


def fp16_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Largest error of each vector after half precision, and its distance to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = kernels.matrix(b.column(1), DIM)
            back = x.astype("<f2").astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.abs(x - back).max(axis=1) if len(x) else []), pa.array(kernels.squared(x, back))], ["vec_id", "max_error", "d2"])

    return _vectors(spark, d).mapInArrow(run, "vec_id bigint, max_error double, d2 double")


def _per_vector(base: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in f(kernels.rotate(kernels.matrix(b.column(1), DIM)))]], [x.split()[0] for x in schema.split(",")])

    return base.mapInArrow(run, schema)


def hadamard_rotate(spark: SparkSession, d: str) -> DataFrame:
    f = lambda r: [r[:, 0].round(9), r[:, 1].round(9), r[:, 63].round(9), np.abs(r).sum(axis=1).round(6)]
    return _per_vector(_vectors(spark, d), f, "vec_id bigint, c0 double, c1 double, c63 double, l1 double")


def rabitq_encode(spark: SparkSession, d: str) -> DataFrame:
    base = _vectors(spark, d)
    centre = S.rotated_centroid(base, DIM)

    def f(r: np.ndarray) -> list:
        code, sq, l1 = kernels.encode_bits(r, centre)
        return [["".join("1" if x > 0 else "0" for x in row) for row in code], sq.round(6), l1.round(6)]

    return _per_vector(base, f, "vec_id bigint, code string, sq_norm double, l1 double")


def _estimate(spark: SparkSession, d: str, how) -> DataFrame:
    base = _vectors(spark, d)
    centre = S.rotated_centroid(base, DIM)
    first = base.orderBy("vec_id").limit(1).toArrow()
    q = kernels.rotate(kernels.matrix(first["embedding"], DIM)) - centre if first.num_rows else np.zeros((1, DIM))
    return _per_vector(base, lambda r: [how(q, r - centre)[0].round(6)], "vec_id bigint, est double")


def rabitq_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _estimate(spark, d, lambda q, c: kernels.estimate_bits(q, *kernels.encode_bits(c, np.zeros(DIM))))


def lut_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The same estimates by look-up tables over packed codes."""

    def how(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        code, sq, l1 = kernels.encode_bits(c, np.zeros(DIM))
        return kernels.estimate_table(q[0], kernels.pack_bits(code), sq, l1)[None, :]

    return _estimate(spark, d, how)


def sq_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _estimate(spark, d, lambda q, c: kernels.estimate_levels(q, *kernels.encode_levels(c, 4), (c * c).sum(axis=1), 4))


def ext_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _estimate(spark, d, lambda q, c: kernels.estimate_extended(q, c, 4))


def sq_encode_b(spark: SparkSession, d: str) -> DataFrame:
    """4-bit levels of every vector, in the JVM."""
    level, a = V.scalar_levels(F.col("embedding"), 4)
    v = _vectors(spark, d).withColumn("level", level).withColumn("a", a)
    return v.select("vec_id", F.array_join(F.transform("level", lambda x: x.cast("string")), ",").alias("levels"), "a")


def hamming_distance(spark: SparkSession, d: str) -> DataFrame:
    """Differing signs of every vector and the first one, over packed words."""
    def word(w: int):
        bit = lambda i: F.when(F.element_at("embedding", (i + 1 + 16 * w).cast("int")) >= 0, F.pow(F.lit(2.0), i)).otherwise(0.0)
        return V.total(F.transform(F.sequence(F.lit(0), F.lit(15)), bit)).cast("long")

    words = F.array(*[word(w) for w in range(4)])
    v = _vectors(spark, d).select("vec_id", words.alias("code"))
    first = v.orderBy("vec_id").limit(1).select("code").scalar()
    return v.withColumn("q_code", first).select("vec_id", V.hamming(F.col("code"), F.col("q_code")).alias("bits"))


def centroid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(F.posexplode("embedding").alias("pos", "x"))
    return v.groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))


def medoid(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    c = v.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("q_c"))
    near = v.withColumn("q_c", c.scalar()).select("vec_id", F.round(V.l2_squared(F.col("embedding"), F.col("q_c")), 9).alias("d2"))
    return near.orderBy("d2", "vec_id").limit(1)


def exact_knn(spark: SparkSession, d: str) -> DataFrame:
    base = _vectors(spark, d)
    return S.exact_knn(base, _queries(base), DIM, K, root=True).select("qid", "rank", "vec_id", F.sqrt("d2").alias("dist"))


def exact_knn_heap(spark: SparkSession, d: str) -> DataFrame:
    base = _vectors(spark, d)
    return S.exact_knn(base, _queries(base), DIM, K)


def two_stage_knn(spark: SparkSession, d: str) -> DataFrame:
    base = _vectors(spark, d)
    return S.two_stage_knn(base, _queries(base), DIM, K)


def two_tier_knn(spark: SparkSession, d: str) -> DataFrame:
    """An index of nine tenths of the rows and a delta of the rest, merged at query time."""
    base = _vectors(spark, d)
    q = _queries(base)
    old, new = base.where(F.col("vec_id") % 10 != 3), base.where(F.col("vec_id") % 10 == 3)
    return S.ranked(S.exact_knn(old, q, DIM, K).drop("rank").unionByName(S.exact_knn(new, q, DIM, K).drop("rank")), K)


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    """Exact 8-neighbour graph of the whole table."""
    base = _vectors(spark, d)
    return S.exact_knn(base, base, DIM, 8).select(F.col("qid").alias("node"), F.col("rank").alias("slot"), F.col("vec_id").alias("nbr"))


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    base = _vectors(spark, d)
    return S.graph_knn(base, _queries(base), DIM, K)


def robust_prune(spark: SparkSession, d: str) -> DataFrame:
    """Pruned neighbours of every vector among all others."""
    return S.robust_prune(_vectors(spark, d), DIM, 8)


def federated_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three shards by label, and a fourth that holds the labels 0 and 1 once more."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    base = S.valid(e, "vec_id", "embedding", DIM)
    q = _queries(base)
    found = None
    for name, want in (("s0", F.col("label") % 3 == 0), ("s1", F.col("label") % 3 == 1), ("s2", F.col("label") % 3 == 2), ("again", F.col("label").isin(0, 1))):
        hits = S.exact_knn(S.valid(e.where(want), "vec_id", "embedding", DIM), q, DIM, K)
        rows = hits.select("qid", F.lit(name).alias("shard"), F.col("vec_id").cast("string").alias("ext_id"), "d2")
        found = rows if found is None else found.unionByName(rows)
    return S.federated(found, K)


def dense_shards(spark: SparkSession, d: str) -> DataFrame:
    """Every shard is asked for k hits and only then is the query itself dropped, so fewer than k may be left."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    q = _queries(S.valid(e, "vec_id", "embedding", DIM))
    me = q.select(F.col("vec_id").alias("qid"), "vec_id", F.lit(0.0).alias("d2"))
    found = None
    for s in range(3):
        held = S.valid(e.where(F.col("label") % 3 == s), "vec_id", "embedding", DIM)
        hits = S.exact_knn(held, q, DIM, K).select("qid", "vec_id", "d2").unionByName(me.join(held.select("vec_id"), "vec_id", "left_semi").select("qid", "vec_id", "d2"))
        rows = hits.select("qid", F.lit(s).alias("shard"), "vec_id", "d2")
        found = rows if found is None else found.unionByName(rows)
    return S.ranked(S.per_shard(found, K).where(F.col("qid") != F.col("vec_id")), K)


def shard_split(spark: SparkSession, d: str) -> DataFrame:
    """Four shards of n // 4 rows in order of id; the remainder is left out. (shard, n_rows, min_id, max_id)"""
    from quern.operators.percentile import ordered_places

    v = ordered_places(table(spark, d, "embeddings", "vec_id"), "vec_id")
    each = F.floor(v_count(spark, d) / 4)
    rows = v.withColumn("shard", F.floor(F.col("place") / each).cast("int")).where(F.col("shard") < 4)
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("vec_id").alias("min_id"), F.max("vec_id").alias("max_id"))


def v_count(spark: SparkSession, d: str):
    return F.lit(table(spark, d, "embeddings", "vec_id").count())


def overlap_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Common ids of approximate and exact search per min(k, n)."""
    base = _vectors(spark, d)
    q = _queries(base)
    want = S.exact_knn(base, q, DIM, K).groupBy("qid").agg(F.collect_set("vec_id").alias("w"))
    got = S.two_stage_knn(base, q, DIM, K).groupBy(F.col("qid").alias("q_q")).agg(F.collect_set("vec_id").alias("g"))
    both = want.join(got, F.col("qid") == F.col("q_q"), "left")
    n = F.least(F.lit(K), F.size("w"))
    return both.select("qid", F.round(F.coalesce(F.size(F.array_intersect("w", "g")), F.lit(0)) / n, 6).alias("overlap"))


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    base = _vectors(spark, d)
    q = _queries(base)
    want = S.exact_knn(base, q, DIM, K).select("qid", "vec_id")
    got = S.two_stage_knn(base, q, DIM, K).select("qid", F.col("vec_id").alias("q_v"))
    hit = want.join(got.withColumnRenamed("qid", "q_q"), (F.col("qid") == F.col("q_q")) & (F.col("vec_id") == F.col("q_v")), "left")
    return hit.groupBy("qid").agg((F.count("q_v") / F.count("*")).alias("recall"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recalls(spark, d).select("qid", F.round("recall", 6).alias("recall"))


def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    r = _recalls(spark, d)
    return r.agg(F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall_mean"), F.round(F.coalesce(F.min("recall"), F.lit(0.0)), 6).alias("recall_min"), F.count("*").alias("n_queries"))


def bitbudget_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the extended codes alone at 1 to 8 bits, with the bytes a vector takes."""
    base = _vectors(spark, d)
    q = _queries(base)
    want = S.exact_knn(base, q, DIM, K).select("qid", "vec_id")
    rows = None
    for bits in range(1, 9):
        got = S.quantised_knn(base, q, DIM, bits, K, extended=True).select(F.col("qid").alias("q_q"), F.col("vec_id").alias("q_v"))
        hit = want.join(got, (F.col("qid") == F.col("q_q")) & (F.col("vec_id") == F.col("q_v")), "left")
        one = hit.groupBy("qid").agg((F.count("q_v") / F.count("*")).alias("recall"))
        one = one.agg(F.round(F.avg("recall"), 6).alias("recall_mean"), F.round(F.min("recall"), 6).alias("recall_min"))
        one = one.select(F.lit(bits).alias("bits"), F.lit(bits * DIM // 8 + 8).alias("bytes_per_vector"), "recall_mean", "recall_min")
        rows = one if rows is None else rows.unionByName(one)
    return rows


QUERIES = {
    f.__name__: f
    for f in (dim_profile, holdout_split, l2_distance, l2_squared, normalize, mrl_truncate, pattern_vectors, fp16_roundtrip, hadamard_rotate, rabitq_encode, rabitq_estimate, lut_estimate, sq_encode_b, sq_estimate, ext_estimate, hamming_distance, centroid, medoid, exact_knn, exact_knn_heap, two_stage_knn, two_tier_knn, knn_graph, graph_search, robust_prune, federated_merge, dense_shards, shard_split, overlap_at_k, recall_at_k, recall_summary, bitbudget_recall)
}

_E = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_FIRST = ", f AS (SELECT v AS fv FROM e ORDER BY vec_id LIMIT 1)"
_Q = ", q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 100 = 0)"
_PAIRS = _E + _Q + f", pairs AS (SELECT qid, vec_id, {_SQ.format(a='qv', b='v')} AS d2 FROM q JOIN e ON qid <> vec_id)"
_TRUTH = _PAIRS + ", truth AS (SELECT qid, vec_id FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) <= 10)"
_SIGN = "(1 - 2 * (((j * 2654435761) % 4294967296) >> 31))"
_ROT = f"""
, rot AS (SELECT vec_id, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64),
    lambda j: v[j + 1] * {_SIGN} * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END)) / 8.0) AS r FROM e)"""
_CEN = """
, cen AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(r[i + 1]) AS m FROM rot, range(64) t(i) GROUP BY i))
, x AS (SELECT vec_id, list_transform(list_zip(r, c), lambda p: p[1] - p[2]) AS x FROM rot, cen)
, code AS (SELECT vec_id, x, list_sum(list_transform(x, lambda y: y * y)) AS sq, list_sum(list_transform(x, lambda y: abs(y))) AS l1 FROM x)"""
_FX = ", f AS (SELECT x AS fx, sq AS fsq FROM code ORDER BY vec_id LIMIT 1)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_BITS = "list_transform(x, lambda y: CASE WHEN y >= 0 THEN 1 ELSE -1 END)"
_LEVELS = "list_transform({x}, lambda y: least(greatest(floor((y + {a}) / (2 * {a}) * {top} + 0.5), 0), {top}))"
_A = "CASE WHEN list_max(list_transform({x}, lambda y: abs(y))) = 0 THEN 1e-9 ELSE list_max(list_transform({x}, lambda y: abs(y))) END"
_COARSE = f"""
, qx AS (SELECT vec_id AS qid, x AS qx, sq AS qsq FROM code WHERE vec_id % 100 = 0)
, est AS (SELECT qid, vec_id, CASE WHEN l1 = 0 THEN sq ELSE qsq + sq - 2 * sq * {_DOT.format(a='qx', b=_BITS)} / l1 END AS est FROM qx JOIN code ON qid <> vec_id)
, coarse AS (SELECT qid, vec_id FROM est QUALIFY row_number() OVER (PARTITION BY qid ORDER BY est, vec_id) <= 256)
, fine AS (SELECT p.qid, p.vec_id, p.d2, row_number() OVER (PARTITION BY p.qid ORDER BY p.d2, p.vec_id) AS rank FROM pairs p JOIN coarse c ON p.qid = c.qid AND p.vec_id = c.vec_id)"""
_ENDS = "round(u[1], 9) AS first, round(u[{n}], 9) AS last, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm"
_KNN = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id)::INTEGER AS rank, vec_id, d2 FROM pairs QUALIFY rank <= 10"
_EXT = "list_transform(" + _LEVELS + ", lambda y: 2 * y - {top})"


def _budget() -> str:
    parts = []
    for bits in range(1, 9):
        top = (1 << bits) - 1
        parts.append(f"""SELECT {bits} AS bits, qid, vec_id, CASE WHEN g = 0 THEN sq ELSE qsq + sq - 2 * {_DOT.format(a='qx', b='o')} * sq / g END AS est
  FROM (SELECT *, {_DOT.format(a='o', b='x')} AS g FROM (SELECT *, {_EXT.format(x='x', a='a', top=top)} AS o FROM (SELECT *, {_A.format(x='x')} AS a FROM code))) JOIN qx ON qid <> vec_id""")
    return _TRUTH + _ROT + _CEN + ", qx AS (SELECT vec_id AS qid, x AS qx, sq AS qsq FROM code WHERE vec_id % 100 = 0), est AS (" + " UNION ALL ".join(parts) + """)
, got AS (SELECT bits, qid, vec_id FROM est QUALIFY row_number() OVER (PARTITION BY bits, qid ORDER BY est, vec_id) <= 10)
, per AS (SELECT g.bits, g.qid, count(t.vec_id) / 10.0 AS recall FROM got g LEFT JOIN truth t ON g.qid = t.qid AND g.vec_id = t.vec_id GROUP BY 1, 2)
SELECT bits, (bits * 8 + 8)::INTEGER AS bytes_per_vector, round(avg(recall), 6) AS recall_mean, round(min(recall)::DOUBLE, 6) AS recall_min FROM per GROUP BY bits"""


_RECALL = _TRUTH + _ROT + _CEN + _COARSE + ", per AS (SELECT t.qid, count(f.vec_id) / count(*) AS recall FROM truth t LEFT JOIN fine f ON t.qid = f.qid AND t.vec_id = f.vec_id AND f.rank <= 10 GROUP BY t.qid) "

ORACLE = {
    "dim_profile": "SELECT count(*) AS n_rows, count(embedding) AS n_vectors, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim FROM dataset_base",
    "holdout_split": "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id DESC) <= 20 THEN 'query' ELSE 'base' END AS part FROM embeddings",
    "l2_distance": _E + _FIRST + f" SELECT vec_id, sqrt({_SQ.format(a='v', b='fv')}) AS dist FROM e, f",
    "l2_squared": _E + _FIRST + f" SELECT vec_id, {_SQ.format(a='v', b='fv')} AS d2 FROM e, f",
    "normalize": "WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM dataset_base WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), u AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END) AS u FROM n) SELECT vec_id, " + _ENDS.format(n=64) + " FROM u",
    "mrl_truncate": "WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), u AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM n) SELECT vec_id, " + _ENDS.format(n=32) + " FROM u",
    "pattern_vectors": "SELECT vec_id, ((vec_id * 7) % 2048)::INTEGER AS first, ((vec_id * 7 + 63 * 13) % 2048)::INTEGER AS last, list_sum(list_transform(range(0, 64), lambda i: (vec_id * 7 + i * 13) % 2048))::BIGINT AS total FROM embeddings",
    "fp16_roundtrip": _E + f""", h AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END) AS w FROM e)
SELECT vec_id, list_max(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))) AS max_error, {_SQ.format(a='v', b='w')} AS d2 FROM h""",
    "hadamard_rotate": _E + _ROT + " SELECT vec_id, round(r[1], 9) AS c0, round(r[2], 9) AS c1, round(r[64], 9) AS c63, round(list_sum(list_transform(r, lambda y: abs(y))), 6) AS l1 FROM rot",
    "rabitq_encode": _E + _ROT + _CEN + " SELECT vec_id, array_to_string(list_transform(x, lambda y: CASE WHEN y >= 0 THEN '1' ELSE '0' END), '') AS code, round(sq, 6) AS sq_norm, round(l1, 6) AS l1 FROM code",
    "rabitq_estimate": _E + _ROT + _CEN + _FX + f" SELECT vec_id, round(CASE WHEN l1 = 0 THEN sq ELSE fsq + sq - 2 * sq * {_DOT.format(a='fx', b=_BITS)} / l1 END, 6) AS est FROM code, f",
    "lut_estimate": _E + _ROT + _CEN + _FX + f" SELECT vec_id, round(CASE WHEN l1 = 0 THEN sq ELSE fsq + sq - 2 * sq * {_DOT.format(a='fx', b=_BITS)} / l1 END, 6) AS est FROM code, f",
    "sq_encode_b": _E + f", a AS (SELECT vec_id, v, {_A.format(x='v')} AS a FROM e) SELECT vec_id, array_to_string(list_transform({_LEVELS.format(x='v', a='a', top=15)}, lambda y: y::INTEGER), ',') AS levels, a FROM a",
    "sq_estimate": _E + _ROT + _CEN + _FX + f", a AS (SELECT *, {_A.format(x='x')} AS a FROM code), b AS (SELECT *, list_transform({_LEVELS.format(x='x', a='a', top=15)}, lambda y: y / 15 * 2 * a - a) AS back FROM a) SELECT vec_id, round(fsq + sq - 2 * {_DOT.format(a='fx', b='back')}, 6) AS est FROM b, f",
    "ext_estimate": _E + _ROT + _CEN + _FX + f", a AS (SELECT *, {_A.format(x='x')} AS a FROM code), b AS (SELECT *, {_EXT.format(x='x', a='a', top=15)} AS o FROM a) SELECT vec_id, round(fsq + sq - 2 * {_DOT.format(a='fx', b='o')} * sq / {_DOT.format(a='o', b='x')}, 6) AS est FROM b, f",
    "hamming_distance": _E + _FIRST + " SELECT vec_id, list_sum(list_transform(list_zip(v, fv), lambda p: CASE WHEN (p[1] >= 0) <> (p[2] >= 0) THEN 1 ELSE 0 END))::INTEGER AS bits FROM e, f",
    "centroid": "SELECT i::INTEGER AS pos, round(avg(embedding[i + 1]::DOUBLE), 9) AS mean FROM embeddings, range(64) t(i) GROUP BY i",
    "medoid": _E + ", c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i + 1]) AS m FROM e, range(64) t(i) GROUP BY i)) SELECT vec_id, round(" + _SQ.format(a="v", b="c") + ", 9) AS d2 FROM e, c ORDER BY d2, vec_id LIMIT 1",
    "exact_knn": _PAIRS + " SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sqrt(d2), vec_id)::INTEGER AS rank, vec_id, sqrt(d2) AS dist FROM pairs QUALIFY rank <= 10",
    "exact_knn_heap": _PAIRS + _KNN,
    "two_stage_knn": _PAIRS + _ROT + _CEN + _COARSE + " SELECT qid, rank::INTEGER AS rank, vec_id, d2 FROM fine WHERE rank <= 10",
    "two_tier_knn": _PAIRS + _KNN,
    "knn_graph": _E + f", p AS (SELECT a.vec_id AS node, b.vec_id AS nbr, {_SQ.format(a='a.v', b='b.v')} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT node, row_number() OVER (PARTITION BY node ORDER BY d2, nbr)::INTEGER AS slot, nbr FROM p QUALIFY slot <= 8",
    "federated_merge": _PAIRS + """, m AS (SELECT vec_id AS id, 's' || (label % 3) AS shard FROM embeddings UNION ALL SELECT vec_id, 'again' FROM embeddings WHERE label IN (0, 1)),
hits AS (SELECT qid, shard, vec_id, d2 FROM pairs JOIN m ON vec_id = id QUALIFY row_number() OVER (PARTITION BY qid, shard ORDER BY d2, vec_id) <= 10),
once AS (SELECT qid, vec_id::VARCHAR AS ext_id, min(d2) AS d2 FROM hits GROUP BY 1, 2)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, ext_id)::INTEGER AS rank, ext_id, d2 FROM once QUALIFY rank <= 10""",
    "dense_shards": _E + _Q + f""", p AS (SELECT q.qid, e.vec_id, m.label % 3 AS shard, {_SQ.format(a='qv', b='v')} AS d2 FROM q, e JOIN embeddings m ON e.vec_id = m.vec_id),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid, shard ORDER BY d2, vec_id) <= 10)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id)::INTEGER AS rank, vec_id, d2 FROM t WHERE qid <> vec_id QUALIFY rank <= 10""",
    "shard_split": "WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () // 4 AS each FROM embeddings) SELECT (place // each)::INTEGER AS shard, count(*) AS n_rows, min(vec_id) AS min_id, max(vec_id) AS max_id FROM p WHERE place // each < 4 GROUP BY 1",
    "overlap_at_k": _RECALL + "SELECT qid, round(recall, 6) AS overlap FROM per",
    "recall_at_k": _RECALL + "SELECT qid, round(recall, 6) AS recall FROM per",
    "recall_summary": _RECALL + "SELECT round(coalesce(avg(recall), 0), 6) AS recall_mean, round(coalesce(min(recall), 0), 6) AS recall_min, count(*) AS n_queries FROM per",
    "bitbudget_recall": _budget(),
}
