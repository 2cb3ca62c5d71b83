"""The k most similar vectors of every vector.

Vantage-point trees per shard. A small tree, fitted on a bounded sample of the vectors, cuts the
space into shards; every vector is then put into its shard, and each shard builds its own tree.

1. Every vector searches its own shard, which gives an upper bound for the distance of its k-th
   neighbour.
2. With that bound the vector is sent to those other shards that may hold something closer. At a
   vantage point with radius m, a vector at distance d whose k-th neighbour is within t needs the
   inner side only if d - t <= m and the outer side only if d + t >= m. It visits the FIRST nearest
   of these shards, and the others only if they are still needed with the bound that gives.
3. The answers are merged.

Both searches shrink t by ``factor`` before they test. Factor 1 is exact; with a smaller one a
neighbour is missed only if its distance to a vantage point differs from the query's by more than
factor * t, which in many dimensions is rare because distances to a third point hardly change
between neighbours.

Similarity is the cosine, that is, the distance of the vectors scaled to unit length.

Defined results: vectors that are null, of another length, all zero or not finite take no part,
nor do null keys; a key counts once, with its smallest vector if it has several; equal vectors are
indexed once with their k + 1 smallest keys, which is all that any answer can contain, and the
remaining keys get their answers from these; ties go to the smaller key; fewer than k others give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import Scratch

K = 10
FACTOR = 0.3
#: Sample on which the shards are fitted: at least SAMPLE vectors, with more shards SAMPLE_PER_SHARD of them for each, at most SAMPLE_MOST.
SAMPLE, SAMPLE_PER_SHARD, SAMPLE_MOST = 16_384, 32, 262_144
#: Most vectors a shard should have, fewest where more shards would keep more tasks busy, and the
#: most queries that meet a shard in one task.
SHARD_ROWS, LEAST_SHARD_ROWS, CHUNK_ROWS = 16_384, 2048, 32_768
LEAF = 128
#: Nearest other shards that a vector visits before its bound is used for all.
FIRST = 4
_EPS = 1e-6


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vector): one usable vector per key."""
    x = F.col(vector)
    ok = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.where(F.col(key).isNotNull() & x.isNotNull()).where(ok).select(F.col(key).cast("long").alias("key"), x.cast("array<float>").alias("vector"))
    return rows.groupBy("key").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.list_(pa.float32()))
    m = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True) if len(m) else 1.0
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m.astype(np.float32)


def _distance(scores: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * scores))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> int:
    """Of a few random vectors the one whose distances spread most."""
    some = rng.choice(len(x), min(6, len(x)), replace=False)
    near = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    return int(some[int(np.argmax(_distance(near @ x[some].T).std(axis=0)))])


@dataclass
class ShardTree:
    """A complete vantage-point tree whose leaves are the shards; node i has children 2i+1 and 2i+2."""

    points: np.ndarray
    radii: np.ndarray
    depth: int

    @staticmethod
    def fit(sample: np.ndarray, shards: int) -> ShardTree:
        depth = max(0, (max(1, shards) - 1).bit_length())
        while depth and len(sample) >> depth < SAMPLE_PER_SHARD:
            depth -= 1
        n = (1 << depth) - 1
        points, radii = np.zeros((n, sample.shape[1]), dtype=np.float32), np.zeros(n)
        members = {0: np.arange(len(sample))}
        rng = np.random.default_rng(7)
        for node in range(n):
            own = members.pop(node)
            p = sample[own[_vantage(sample[own], rng)]]
            d = _distance(sample[own] @ p)
            points[node], radii[node] = p, float(np.median(d))
            members[2 * node + 1], members[2 * node + 2] = own[d <= radii[node]], own[d > radii[node]]
            for side in (2 * node + 1, 2 * node + 2):
                if side < n and len(members[side]) == 0:  # all at one distance: both sides stay usable
                    members[side] = own
        return ShardTree(points, radii, depth)

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        if self.depth:
            d = _distance(x @ self.points.T)
            for _ in range(self.depth):
                node = 2 * node + 1 + (d[np.arange(len(x)), node] > self.radii[node])
        return node - ((1 << self.depth) - 1)

    def needed(self, x: np.ndarray) -> np.ndarray:
        """How far around vector i one has to look to get into shard j: 0 for its own shard."""
        need = np.zeros((len(x), 1))
        if self.depth:
            d = _distance(x @ self.points.T)
            for level in range(self.depth):
                nodes = np.arange((1 << level) - 1, (2 << level) - 1)
                out = d[:, nodes] - self.radii[nodes]
                need = np.maximum(need[:, :, None], np.stack([out, -out], axis=2)).reshape(len(x), -1)
        return need


class VantageTree:
    """The tree of one shard."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf = x, leaf
        self.rng = np.random.default_rng(len(x))
        self.root = self._build(np.arange(len(x)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        p = self.x[own[_vantage(self.x[own], self.rng)]]
        d = _distance(self.x[own] @ p)
        m = float(np.median(d))
        inner, outer = own[d <= m], own[d > m]
        if not len(inner) or not len(outer):
            return own
        return p, m, self._build(inner), self._build(outer)

    def search(self, q: np.ndarray, k: int, factor: float, within: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best per query, -1 where there are fewer.

        ``within``: distance beyond which nothing is wanted; ``own``: position not to be found.
        """
        self.q, self.k, self.factor, self.own = q, k, factor, own
        self.best = np.full((len(q), k), -2.0, dtype=np.float32)
        self.at = np.full((len(q), k), -1, dtype=np.int64)
        self.reach = np.full(len(q), 2.0) if within is None else np.minimum(2.0, within.astype(np.float64))
        self._visit(self.root, np.arange(len(q)))
        return self.at, self.best

    def _visit(self, node, some: np.ndarray) -> None:
        if not len(some):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, some)
            return
        p, m, inner, outer = node
        d = _distance(self.q[some] @ p)
        first = d <= m
        self._visit(inner, some[first])
        self._visit(outer, some[~first])
        t = self.reach[some] * self.factor
        self._visit(inner, some[~first & (d - t <= m + _EPS)])
        self._visit(outer, some[first & (d + t >= m - _EPS)])

    def _leaf(self, own: np.ndarray, some: np.ndarray) -> None:
        for a in range(0, len(some), 4096):
            part = some[a : a + 4096]
            s = self.q[part] @ self.x[own].T
            if self.own is not None:
                s[self.own[part][:, None] == own[None, :]] = -2.0
            hit = np.flatnonzero(s.max(axis=1) > self.best[part, -1])
            part, s = part[hit], s[hit]
            if not len(part):
                continue
            scores = np.concatenate([self.best[part], s], axis=1)
            at = np.concatenate([self.at[part], np.broadcast_to(own, s.shape)], axis=1)
            top = np.argpartition(-scores, self.k - 1, axis=1)[:, : self.k]
            rows = np.arange(len(part))[:, None]
            top = top[rows, np.argsort(-scores[rows, top], axis=1, kind="stable")]
            self.best[part], self.at[part] = scores[rows, top], at[rows, top]
            self.reach[part] = np.minimum(self.reach[part], _distance(self.best[part, -1].astype(np.float64)))


def _answers(keys: np.ndarray, members: list[list[int]], at: np.ndarray, best: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k first keys per query: by score, then key."""
    single = all(len(m) == 1 for m in members)
    if single:
        ok = at >= 0
        who = np.repeat(keys, ok.sum(axis=1))
        first = np.array([m[0] for m in members], dtype=np.int64)
        return who.tolist(), first[at[ok]].tolist(), best[ok].astype(float).tolist()
    q, n, s = [], [], []
    for i, key in enumerate(keys.tolist()):
        found = sorted((-float(best[i, j]), m) for j in range(at.shape[1]) if at[i, j] >= 0 for m in members[at[i, j]])[:k]
        q += [key] * len(found)
        n += [m for _, m in found]
        s += [-x for x, _ in found]
    return q, n, s


_FOUND = pa.schema([("key", pa.int64()), ("near", pa.int64()), ("score", pa.float64())])


def nearest(df: DataFrame, key: str, vector: str, dim: int, k: int = K, factor: float = FACTOR) -> DataFrame:
    """(key, near, rank): for every key its k most similar others."""
    spark = df.sparkSession
    scratch = Scratch(spark, "similar")
    same = Window.partitionBy("q_h1", "q_h2").orderBy("key")
    all_rows = usable_vectors(df, key, vector, dim).withColumn("q_h1", F.xxhash64("vector")).withColumn("q_h2", F.xxhash64(F.lit(1), F.col("vector")))
    all_rows = scratch.save(all_rows, "vectors")
    heads = all_rows.select("key", "q_h1", "q_h2").withColumn("q_rn", F.row_number().over(same)).where(F.col("q_rn") <= k + 1)
    groups = heads.groupBy("q_h1", "q_h2").agg(F.min("key").alias("rep"), F.sort_array(F.collect_list("key")).alias("members"))
    groups = scratch.save(groups, "groups")
    index = all_rows.join(groups.select("rep", "members"), F.col("key") == F.col("rep")).select("key", "vector", "members")
    n = groups.count()
    busy = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_SHARD_ROWS))
    wanted = max(busy, -(-n // SHARD_ROWS))
    size = min(SAMPLE_MOST, max(SAMPLE, 2 * wanted * SAMPLE_PER_SHARD))  # twice, as the number of shards is a power of two
    sample = index.select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(size).toArrow()
    tree = ShardTree.fit(_matrix(sample["vector"], dim), wanted)
    shards = 1 << tree.depth
    shared = spark.sparkContext.broadcast(tree)  # at most SAMPLE_MOST / SAMPLE_PER_SHARD vectors
    step = max(64, min(4096, (16 << 20) // shards))  # bounds the matrix of vectors and shards

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = shared.value.home(_matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], ["key", "vector", "members", "cell"])

    index = scratch.save(index.mapInArrow(put, "key bigint, vector array<float>, members array<bigint>, cell bigint"), "index")

    def own_shard(table: pa.Table) -> pa.Table:
        x = _matrix(table["vector"], dim)
        at, best = VantageTree(x).search(x, k, factor, own=np.arange(len(x)))
        q, near, s = _answers(table["key"].to_numpy(), table["members"].to_pylist(), at, best, k)
        return pa.table([q, near, s], schema=_FOUND)

    found = scratch.save(index.groupBy("cell").applyInArrow(own_shard, "key bigint, near bigint, score double"), "home")

    def other_shard(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return _FOUND.empty_table()
        x, q, bar = _matrix(held["vector"], dim), _matrix(asking["vector"], dim), asking["score"].to_numpy().astype(np.float32)
        at, best = VantageTree(x).search(q, k, factor, within=_distance(bar.astype(np.float64)))
        at = np.where(best >= bar[:, None], at, -1)
        a, near, s = _answers(asking["key"].to_numpy(), held["members"].to_pylist(), at, best, k)
        return pa.table([a, near, s], schema=_FOUND)

    def visit(found: DataFrame, name: str, first: bool) -> DataFrame:
        """Answers of the FIRST shards nearest to each vector, or of the others that may still hold something closer."""
        kth = F.try_element_at(F.sort_array(F.collect_list("score"), False), F.lit(k))
        bound = found.groupBy(F.col("key").alias("q_key")).agg(kth.alias("q_s"))
        asked = index.join(bound, F.col("key") == F.col("q_key"), "left").select("key", "vector", "cell", F.coalesce("q_s", F.lit(-1.0)).alias("score"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    b = batch.slice(a, step)
                    need = shared.value.needed(_matrix(b.column(1), dim))
                    need[np.arange(len(need)), b.column(2).to_numpy()] = np.inf
                    on = need <= _distance(b.column(3).to_numpy().astype(np.float64))[:, None] * factor + _EPS
                    n = min(FIRST, shards - 1)
                    near = np.zeros_like(on)
                    np.put_along_axis(near, np.argpartition(need, n - 1, axis=1)[:, :n], True, axis=1)
                    rows, cells = np.nonzero(on & (near if first else ~near))
                    for c in range(0, len(rows), 20_000):
                        some = b.take(pa.array(rows[c : c + 20_000]))
                        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(cells[c : c + 20_000], pa.int64()), some.column(3)], ["key", "vector", "cell", "score"])

        sent = scratch.save(asked.mapInArrow(send, "key bigint, vector array<float>, cell bigint, score double"), f"sent-{name}")
        loads = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        chunks = F.lit([-(-loads.get(c, 0) // CHUNK_ROWS) or 1 for c in range(shards)]).cast("array<int>")
        size = F.element_at(chunks, F.col("cell").cast("int") + 1)
        queries = sent.withColumn("q_chunk", F.pmod(F.xxhash64("key"), size).cast("int"))
        sides = index.withColumn("q_chunk", F.explode(F.sequence(F.lit(0), size - 1)))
        far = queries.groupBy("cell", "q_chunk").cogroup(sides.groupBy("cell", "q_chunk")).applyInArrow(other_shard, "key bigint, near bigint, score double")
        far = scratch.save(far, f"far-{name}")
        scratch.drop(f"sent-{name}")
        return found.unionByName(far)

    if shards > 1:
        found = visit(visit(found, "first", True), "rest", False)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "near")
    best_of = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # equal vectors come first in each other's lists
    many = groups.where(F.size("members") > 1)
    asked_by = many.select(F.col("rep").alias("q_rep"), "members")
    spread = best_of.join(asked_by, F.col("key") == F.col("q_rep"), "left")
    spread = spread.withColumn("q_member", F.explode(F.coalesce("members", F.array("key")))).withColumn("rank", F.col("rank") + F.when(F.col("members").isNull(), 0).otherwise(F.size("members") - 1))
    spread = spread.where(F.col("rank") <= k).select(F.col("q_member").alias("key"), "near", "rank")
    inside = many.select(F.explode("members").alias("key"), "members").select("key", F.posexplode(F.slice(F.array_except("members", F.array("key")), 1, k)).alias("q_pos", "near")).select("key", "near", (F.col("q_pos") + 1).alias("rank"))
    rest = all_rows.select("key", "q_h1", "q_h2").join(many.where(F.size("members") == k + 1).select(F.col("q_h1").alias("q_g1"), F.col("q_h2").alias("q_g2"), "members"), (F.col("q_h1") == F.col("q_g1")) & (F.col("q_h2") == F.col("q_g2")))
    rest = rest.where(~F.array_contains("members", F.col("key"))).select("key", F.posexplode(F.slice("members", 1, k)).alias("q_pos", "near")).select("key", "near", (F.col("q_pos") + 1).alias("rank"))
    return spread.unionByName(inside).unionByName(rest)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of which at least one names the other."""
    return near.select(F.least("key", "near").alias("vec_a"), F.greatest("key", "near").alias("vec_b")).distinct()
