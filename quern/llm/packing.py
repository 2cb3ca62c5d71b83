"""Filling containers of fixed capacity with documents.

Bulk-synchronous best fit. Documents are range-sorted by size, largest first, and so are the gaps
of the open containers. In a round all documents of one size look up the successor of their size
among the gaps, the smallest gap that takes them; where several want the same gap the rank of the
document decides, the others go on to the next gap, and those left over open containers. Then the
gaps are updated and the next smaller size has its round.

Documents of one size are interchangeable and so are containers with one gap, and both sizes and
gaps are whole numbers up to the capacity. The sweeps therefore work on runs of ranks ("documents
421 to 977 of size 300 go to containers 12 to 568"): the plan's length depends on the capacity,
not on the number of documents, and the driver may hold it. The documents themselves stay
distributed: each finds its rank by counts of (size, hash bucket) and its container by binary
search in the broadcast plan.

Defined results: null and empty texts are left out; a text larger than the capacity is cut into
full containers and a rest that is packed like a document; nothing else is cut; equal keys with
equal sizes are ranked in any order but each is packed once; an empty table gives no containers.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.storage import Scratch

CAPACITY = 2048
#: Expected documents per ranked bucket of the largest possible size class.
BUCKET_ROWS = 200_000
#: Most runs of the plan in one broadcast (24 bytes each), unless a single size has more.
PLAN_RUNS = 1_000_000


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (size, first rank, number, first container) and the number of containers.

    ``counts`` has the number of documents of each size from 1 to ``capacity``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gaps that some container has, ascending
    runs: list[tuple[int, int, int, int]] = []
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        heapq.heappush(gaps[gap], (first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(order, size)
            if at == len(order):
                break
            gap = order[at]
            first, n = heapq.heappop(gaps[gap])
            k = min(n, left)
            if k < n:
                heapq.heappush(gaps[gap], (first + k, n - k))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            runs.append((size, rank, k, first))
            give(gap - size, first, k)
            left, rank = left - k, rank + k
        if left:
            each = capacity // size
            full, some = divmod(left, each)
            for _ in range(each if full else 0):
                runs.append((size, rank, full, opened))
                rank += full
            if full:
                give(capacity - each * size, opened, full)
                opened += full
            for _ in range(some):
                runs.append((size, rank, 1, opened))
                rank += 1
            if some:
                give(capacity - some * size, opened, 1)
                opened += 1
    return np.array(runs, dtype=np.int64).reshape(-1, 4), opened


def pieces(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, start, n_tokens): full pieces of texts larger than the capacity, and what is left of every text."""
    n = F.col("n_tokens")
    parts = F.ceil(n / F.lit(capacity)).cast("int")
    rows = sizes.where(n > 0).select(key, n, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    start = F.col("part").cast("long") * capacity
    return rows.select(key, "part", start.alias("start"), F.least(F.lit(capacity).cast("long"), n - start).alias("n_tokens"))


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(container, key, part, start, n_tokens) for ``sizes`` of (key, n_tokens)."""
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    items = scratch.save(pieces(sizes, key, capacity).where(F.col("n_tokens") > 0), "items")
    buckets = 1 + items.count() // BUCKET_ROWS
    bucket = F.pmod(F.xxhash64(key, "part"), F.lit(buckets)).cast("long")
    items = items.withColumn("q_b", bucket)
    # capacity x buckets counts at most; their running sums are the first ranks of the buckets
    cells = items.groupBy(F.col("n_tokens").alias("q_s"), F.col("q_b").alias("q_cb")).agg(F.count("*").alias("q_n"))
    cells = scratch.save(cells, "cells")
    counts = {r.q_s: r.n for r in cells.groupBy("q_s").agg(F.sum("q_n").alias("n")).collect()}
    runs, _ = best_fit_plan(counts, capacity)
    before = Window.partitionBy("q_s").orderBy("q_cb").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("q_s", "q_cb", F.coalesce(F.sum("q_n").over(before), F.lit(0)).alias("q_first"))
    inside = F.row_number().over(Window.partitionBy("n_tokens", "q_b").orderBy(key, "part"))
    ranked = items.withColumn("q_in", inside.cast("long") - 1).join(first, (F.col("n_tokens") == F.col("q_s")) & (F.col("q_b") == F.col("q_cb")))
    ranked = ranked.select(key, "part", "start", "n_tokens", (F.col("q_first") + F.col("q_in")).alias("q_rank"))
    parts = None
    for low, high, lookup in _slices(spark, runs, max([1, *counts.values()])):
        rows = ranked.where(F.col("n_tokens").between(low, high)).select(lookup("n_tokens", "q_rank").alias("container"), key, "part", "start", "n_tokens")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _slices(spark: SparkSession, runs: np.ndarray, most: int) -> Iterator[tuple[int, int, Callable]]:
    """(least size, largest size, look-up of the container) of slices of the plan, each broadcast with at most PLAN_RUNS runs.

    All runs of a size are in one slice. Runs of one size are in order of rank, so one number sorts them all.
    """
    ordered = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sizes, first = np.unique(ordered[:, 0], return_index=True)
    edges = [0]
    for a, b in zip(first, [*first[1:], len(ordered)]):
        if b - edges[-1] > PLAN_RUNS and a > edges[-1]:
            edges.append(int(a))
    width = np.int64(most)

    def lookup(part: np.ndarray) -> Callable:
        plan = spark.sparkContext.broadcast((part[:, 0] * width + part[:, 1], part[:, 1], part[:, 3]))

        @F.pandas_udf("long")
        def container(size: pd.Series, rank: pd.Series) -> pd.Series:
            at, ranks, containers = plan.value
            i = np.searchsorted(at, size.to_numpy() * width + rank.to_numpy(), side="right") - 1
            return pd.Series(containers[i] + rank.to_numpy() - ranks[i])

        return container

    for a, b in zip(edges, [*edges[1:], len(ordered)]):
        part = ordered[a:b]
        yield (int(part[0, 0]), int(part[-1, 0]), lookup(part)) if len(part) else (0, 0, F.greatest)


def contents(packed: DataFrame, key: str) -> DataFrame:
    """(container, used, n_docs, docs): a container holds at most as many documents as its capacity."""
    docs = F.sort_array(F.collect_list(F.struct(key, "part", "start", "n_tokens")))
    return packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_docs"), docs.alias("docs"))
