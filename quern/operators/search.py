"""Nearest-neighbour search of a stated query set against all rows.

Candidates come from matrix products over blocks and are then measured exactly, so results equal
the row-by-row expression. A query set within BROADCAST_BYTES is broadcast and the base is only
scanned; a larger one meets the base in a grid of blocks of bounded size. Either way only the k
best per block and query are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import kernels
from quern.storage import Scratch

#: Largest query set that is broadcast, and rows of a block of queries and of base vectors otherwise.
BROADCAST_BYTES = 32 << 20
QUERY_ROWS, BASE_ROWS = 4096, 65_536
_HITS = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("d2", pa.float64())])
_KIND = "qid bigint, vec_id bigint, d2 double"


def valid(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(vec_id, embedding): rows with a key and a vector of full length without nulls."""
    v = F.col(vector)
    return df.where(F.col(key).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull())).select(F.col(key).cast("long").alias("vec_id"), v.cast("array<float>").alias("embedding"))


Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, score: Score | None, root: bool) -> list[np.ndarray]:
    """Per query the k best of a block, ties by id; without ``score`` exact squared distances."""
    out: list[list[np.ndarray]] = [[], [], []]
    step = max(1, min(256, 65_536 // (2 * k + 8)))  # bounds the candidates that are measured at once
    for a in range(0, len(q), step):
        part, pid = q[a : a + step], qids[a : a + step]
        s = (score or kernels.approximate_squared)(part, b)
        s[pid[:, None] == ids[None, :]] = np.inf
        n = min(len(ids), k if score else 2 * k + 8)
        cand = np.argpartition(s, n - 1, axis=1)[:, :n] if n < len(ids) else np.broadcast_to(np.arange(len(ids)), s.shape)
        if n < len(ids):  # everything that ties with the last candidate stays in
            edge = np.take_along_axis(s, cand, 1).max(axis=1)
            more = (s <= edge[:, None] + (0 if score else 1e-9)).sum(axis=1).max()
            if more > n:
                cand = np.argsort(s, axis=1, kind="stable")[:, :more]
        found = np.take_along_axis(s, cand, 1)
        exact = found if score else np.where(np.isinf(found), np.inf, kernels.squared(part[:, None, :], b[cand]))
        key = np.sqrt(exact) if root else exact
        order = np.lexsort((ids[cand], key), axis=1)[:, :k]
        near = np.take_along_axis(exact, order, 1)
        ok = ~np.isinf(near)
        out[0].append(np.repeat(pid, ok.sum(axis=1)))
        out[1].append(ids[np.take_along_axis(cand, order, 1)][ok])
        out[2].append(near[ok])
    return [np.concatenate(x) if x else np.empty(0) for x in out]


def _merged(kept: list[np.ndarray] | None, new: list[np.ndarray], k: int, by: int = 2) -> list[np.ndarray]:
    """The k best per query of two lists of (qid, vec_id, ...), by column ``by``, ties by id."""
    if kept is None:
        return new
    both = [np.concatenate(x) for x in zip(kept, new)]
    order = np.lexsort((both[1], both[by], both[0]))
    q = both[0][order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, dtype=bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.empty(0)
    return [x[order[place < k]] for x in both]


def _rows(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.float64))], schema=_HITS)


def block_search(base: DataFrame, queries: DataFrame, dim: int, k: int, score: Score | None = None, root: bool = False) -> DataFrame:
    """(qid, vec_id, d2) with at least the k best of every query among the rows; a query never finds its own id.

    ``base``, ``queries``: (vec_id, embedding) as ``valid`` gives them. ``score`` replaces the exact
    squared distance; ``root``: ties are those of the distance, not of its square.
    """
    spark = base.sparkSession
    n = queries.count()
    if n * dim * 8 <= BROADCAST_BYTES:
        t = queries.toArrow()
        held = spark.sparkContext.broadcast((t["vec_id"].to_numpy(), kernels.matrix(t["embedding"], dim)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = held.value
            kept: list[np.ndarray] | None = None  # k per query, however many batches there are
            for batch in batches:
                if batch.num_rows and len(qids):
                    new = _best(qids, q, batch.column(0).to_numpy(), kernels.matrix(batch.column(1), dim), k, score, root)
                    kept = _merged(kept, new, k)
            if kept is not None:
                yield _rows(kept)

        return base.mapInArrow(scan, _KIND)
    rows, columns = -(-n // QUERY_ROWS), max(1, -(-base.count() // BASE_ROWS))
    hashed = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # names of their own: both sides may come from one table
    q = queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vector"), hashed(rows).alias("q_row")).withColumn("q_col", every(columns))
    b = base.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vector"), hashed(columns).alias("b_col")).withColumn("b_row", every(rows))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HITS.empty_table()
        return pa.Table.from_batches([_rows(_best(left["qid"].to_numpy(), kernels.matrix(left["q_vector"], dim), right["b_id"].to_numpy(), kernels.matrix(right["b_vector"], dim), k, score, root))])

    return q.groupBy("q_row", "q_col").cogroup(b.groupBy("b_row", "b_col")).applyInArrow(cell, _KIND)


def ranked(hits: DataFrame, k: int, by: str = "d2") -> DataFrame:
    """(qid, rank, vec_id, d2): the k best per query, ties by id. Partial limits run before the shuffle."""
    key = F.sqrt("d2") if by == "dist" else F.col(by)
    w = Window.partitionBy("qid").orderBy(key, "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "d2")


def exact_knn(base: DataFrame, queries: DataFrame, dim: int, k: int = 10, root: bool = False) -> DataFrame:
    return ranked(block_search(base, queries, dim, k, root=root), k, "dist" if root else "d2")


def rerank(hits: DataFrame, base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact squared distances of candidate (qid, vec_id) rows, then the k best; candidates without a vector drop out."""
    from quern.functions.vector import l2_squared

    c = hits.select("qid", "vec_id").join(base.select("vec_id", F.col("embedding").alias("q_b")), "vec_id")
    c = c.join(queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_q")), "qid")
    return ranked(c.select("qid", "vec_id", l2_squared(F.col("q_q"), F.col("q_b")).alias("d2")), k)


def rotated_centroid(base: DataFrame, dim: int) -> np.ndarray:
    """Mean of the rotated vectors: sums per partition, added on the driver (one row per partition)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                r = kernels.rotate(kernels.matrix(b.column(1), dim)).sum(axis=0)
                total, n = r if total is None else total + r, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    parts = base.mapInArrow(sums, "n bigint, total array<double>").collect()
    width = 1 << max(0, (dim - 1).bit_length())
    n = sum(r.n for r in parts)
    return np.sum([r.total for r in parts], axis=0) / n if n else np.zeros(width)


#: Candidates of the two-stage search: twice the reference's, for a recall of at least 0.9 at 64 dimensions.
CANDIDATES = 256


def build_codes(base: DataFrame, dim: int, centre: np.ndarray) -> DataFrame:
    """The stored index of the two-stage search: (vec_id, embedding, code, sq, l1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs, sq, l1 = kernels.encode_bits(kernels.rotate(kernels.matrix(b.column(1), dim)), centre)
            packed = [bytes(x) for x in kernels.pack_bits(signs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary()), pa.array(sq), pa.array(l1)], ["vec_id", "embedding", "code", "sq", "l1"])

    coded = base.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, embedding array<float>, code binary, sq double, l1 double")
    return Scratch(base.sparkSession, "codes").save(coded, "index")


def search_codes(index: DataFrame, queries: DataFrame, dim: int, centre: np.ndarray, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """(qid, rank, vec_id, d2): codes choose ``candidates`` per query, exact distances order them; one pass over the index.

    A task keeps its ``candidates`` best by code and measures them at once, so nothing is looked up
    again; which are the best of all is settled after the shuffle.
    """
    spark = index.sparkSession
    t = queries.toArrow()
    if t.num_rows * dim * 8 > BROADCAST_BYTES:
        raise ValueError("the coded search takes query sets up to BROADCAST_BYTES; cut the set in parts")
    held = spark.sparkContext.broadcast((t["vec_id"].to_numpy(), kernels.matrix(t["embedding"], dim)))
    width = 1 << max(0, (dim - 1).bit_length())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        qc = kernels.rotate(q) - centre
        kept: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows or not len(qids):
                continue
            ids, x = b.column(0).to_numpy(), kernels.matrix(b.column(1), dim)
            packed = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            signs = np.unpackbits(packed, axis=1, bitorder="little")[:, :width] * 2.0 - 1.0
            for a in range(0, len(qids), 256):
                est = kernels.estimate_bits(qc[a : a + 256], signs, b.column(3).to_numpy(), b.column(4).to_numpy())
                est[qids[a : a + 256, None] == ids[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(ids, est.shape), est), axis=1)[:, :candidates]
                near = np.take_along_axis(est, order, 1)
                ok = ~np.isinf(near)
                rows, at = np.nonzero(ok)[0] + a, order[ok]
                exact = kernels.squared(q[rows], x[at])
                kept = _merged(kept, [qids[rows], ids[at], near[ok], exact], candidates) if kept is not None or a else [qids[rows], ids[at], near[ok], exact]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], ["qid", "vec_id", "est", "d2"])

    hits = index.mapInArrow(scan, "qid bigint, vec_id bigint, est double, d2 double")
    w = Window.partitionBy("qid").orderBy("est", "vec_id")
    return ranked(hits.withColumn("q_c", F.row_number().over(w)).where(F.col("q_c") <= candidates), k)


def two_stage_knn(base: DataFrame, queries: DataFrame, dim: int, k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """1-bit codes choose ``candidates`` per query, exact distances order them."""
    centre = rotated_centroid(base, dim)
    return search_codes(build_codes(base, dim, centre), queries, dim, centre, k, candidates)


def quantised_knn(base: DataFrame, queries: DataFrame, dim: int, bits: int, k: int = 10, extended: bool = False) -> DataFrame:
    """Order by B-bit codes alone."""
    centre = rotated_centroid(base, dim)

    def score(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        qc, c = kernels.rotate(q) - centre, kernels.rotate(b) - centre
        if extended:
            return kernels.estimate_extended(qc, c, bits)
        return kernels.estimate_levels(qc, *kernels.encode_levels(c, bits), (c * c).sum(axis=1), bits)

    return ranked(block_search(base, queries, dim, k, score), k)


def graph_knn(base: DataFrame, queries: DataFrame, dim: int, k: int = 10, width: int = 64, shard_rows: int = 512) -> DataFrame:
    """A graph per block of ids, built and searched inside one task, answers merged over the blocks.

    Every block sees every query, so the query set is checked to fit a broadcast.
    """
    spark = base.sparkSession
    if queries.count() * dim * 8 > BROADCAST_BYTES:
        raise ValueError("the graph search takes query sets up to BROADCAST_BYTES; cut the set in parts")
    t = queries.toArrow()
    held = spark.sparkContext.broadcast((t["vec_id"].to_numpy(), kernels.matrix(t["embedding"], dim)))

    def shard(table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), kernels.matrix(table["embedding"], dim)
        graph, entry = kernels.build_graph(x), kernels.medoid(x)
        out: list[tuple[int, int, float]] = []
        for qid, q in zip(*held.value):
            found = kernels.walk(x, graph, q, entry, max(width, k + 1))[0]
            out += [(int(qid), int(ids[i]), d) for d, i in found if ids[i] != qid][:k]
        return pa.table([list(c) for c in zip(*out)] if out else [[], [], []], schema=_HITS)

    blocks = base.withColumn("q_shard", F.floor(F.col("vec_id") / shard_rows))
    return ranked(blocks.groupBy("q_shard").applyInArrow(shard, _KIND), k)


def robust_prune(base: DataFrame, dim: int, keep: int, alpha: float = 1.2, near: int = 64) -> DataFrame:
    """(node, slot, nbr): robust pruning of every vector's neighbours among all others.

    Nearest come first and only nearer ones can drop a candidate, so ``keep`` found among the
    ``near`` nearest are those of the whole table. A node that has fewer is asked again for eight
    times as many, in the end for all.
    """
    scratch = Scratch(base.sparkSession, "prune")
    base = scratch.save(base, "base")
    ids = base.agg(F.countDistinct("vec_id")).first()[0]
    kind = "node bigint, slot int, nbr bigint, n int"

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        x = kernels.matrix(t["q_b"], dim)
        dist, alive, out = np.sqrt(t["d2"].to_numpy()), np.ones(t.num_rows, dtype=bool), []
        while len(out) < keep and alive.any():
            i = int(np.argmax(alive))
            out.append(i)
            alive[i] = False
            alive &= ~(alpha * np.sqrt(kernels.squared(x[i][None, :], x)) <= dist)
        n = len(out)
        return pa.table([t["qid"].take(out), pa.array(range(1, n + 1), pa.int32()), t["vec_id"].take(out), pa.array([n] * n, pa.int32())], names=["node", "slot", "nbr", "n"])

    asked, done, r = base, None, 0
    while True:
        near = min(near, max(1, ids - 1))
        c = exact_knn(base, asked, dim, near).join(base.select("vec_id", F.col("embedding").alias("q_b")), "vec_id")
        rows = scratch.save(c.groupBy("qid").applyInArrow(one, kind), f"kept{r}")
        whole = near >= ids - 1
        ready = (rows if whole else rows.where(F.col("n") == keep)).select("node", "slot", "nbr")
        done = ready if done is None else done.unionByName(ready)
        asked = base.join(rows.where(F.col("n") < keep).select(F.col("node").alias("q_id")).distinct(), F.col("vec_id") == F.col("q_id"), "left_semi")
        if whole or asked.isEmpty():
            return done
        near, r = near * 8, r + 1


def federated(hits: DataFrame, k: int) -> DataFrame:
    """Merges (qid, shard, ext_id, d2): by distance, then id as text; an id that several shards hold counts once."""
    once = hits.groupBy("qid", "ext_id").agg(F.min("d2").alias("d2"))
    w = Window.partitionBy("qid").orderBy("d2", "ext_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k)).select("qid", "rank", "ext_id", "d2")


def per_shard(hits: DataFrame, k: int) -> DataFrame:
    """The k best of every query in every shard of (qid, shard, vec_id, d2)."""
    w = Window.partitionBy("qid", "shard").orderBy("d2", "vec_id")
    return hits.withColumn("q_rank", F.row_number().over(w)).where(F.col("q_rank") <= k).drop("q_rank")
