"""The measurement protocol: build, warm up, recall once per setting, timed windows, one row each.

Queries are never in the base. Recall is measured once per setting because answers do not depend
on concurrency. A window has a closed loop of clients, each of which sends the next block of
queries as soon as its last one is answered; at concurrency 1 the whole query set is swept.
"""

from __future__ import annotations

import json
import math
import os
import time
from abc import ABC, abstractmethod
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import search as S
from quern.plans.settings import storage_medium


def percentile_linear(xs: list[float], p: float) -> float:
    """Interpolated; 0 for no values."""
    if not xs:
        return 0.0
    s = sorted(xs)
    at = min(max(p, 0.0), 1.0) * (len(s) - 1)
    low = math.floor(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def percentile_floor(xs: list[float], p: float) -> float:
    """The value at the truncated index; 0 for no values."""
    return sorted(xs)[int(min(max(p, 0.0), 1.0) * (len(xs) - 1))] if xs else 0.0


def recall(got: list, want: list) -> float:
    """Hits per wanted id; ids that are returned twice count twice, nothing wanted is 0."""
    return sum(x in set(want) for x in got) / len(want) if want else 0.0


def overlap(got: list, want: list, k: int) -> float:
    """Common ids per min(k, wanted); 0 where that is none."""
    n = min(k, len(want))
    return len(set(got) & set(want)) / n if n > 0 else 0.0


class VectorEngine(ABC):
    """What the protocol measures. ``build`` gets (vec_id, embedding), ``search`` gives (qid, rank, vec_id, d2)."""

    name = "engine"
    mode = "batch"

    def __init__(self, dim: int) -> None:
        self.dim, self.param = dim, 0

    def build(self, base: DataFrame) -> None:
        self.base = base.persist()
        self.base.count()

    def set_param(self, value: int) -> None:
        self.param = value

    @abstractmethod
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def close(self) -> None:
        self.base.unpersist()


class ExactEngine(VectorEngine):
    name = "exact"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.exact_knn(self.base, queries, self.dim, k)


class TwoStageEngine(VectorEngine):
    """``param``: candidates that the 1-bit codes leave for exact distances."""

    name = "two-stage"

    def build(self, base: DataFrame) -> None:
        """Stores the codes beside the vectors; searches only scan them."""
        self.base = base
        self.centre = S.rotated_centroid(base, self.dim)
        self.codes = S.build_codes(base, self.dim, self.centre)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.search_codes(self.codes, queries, self.dim, self.centre, k, max(k, self.param))


class GraphEngine(VectorEngine):
    """``param``: width of the beam."""

    name = "graph"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.graph_knn(self.base, queries, self.dim, k, max(k, self.param))


class AutoEngine(VectorEngine):
    """Exact up to ``threshold`` vectors, two stages above."""

    name = "auto"

    def __init__(self, dim: int, threshold: int = 50_000) -> None:
        super().__init__(dim)
        self.threshold = threshold

    def build(self, base: DataFrame) -> None:
        super().build(base)
        self.exact = self.base.count() <= self.threshold

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.exact_knn(self.base, queries, self.dim, k) if self.exact else S.two_stage_knn(self.base, queries, self.dim, k, max(k, self.param or 128))


def ground_truth(spark: SparkSession, base: DataFrame, queries: DataFrame, dim: int, k: int, cache: str | None = None) -> DataFrame:
    """(qid, rank, vec_id, d2), read from ``cache`` where it was made for the same k and numbers of rows."""
    if cache is None:
        return S.exact_knn(base, queries, dim, k, root=True)
    meta = {"k": k, "n_base": base.count(), "n_queries": queries.count()}
    try:
        with open(f"{cache}.json") as f:
            if json.load(f) == meta:
                return spark.read.parquet(cache)
    except (OSError, ValueError):
        pass
    S.exact_knn(base, queries, dim, k, root=True).write.mode("overwrite").parquet(cache)
    with open(f"{cache}.json.tmp", "w") as f:
        json.dump(meta, f)
    os.replace(f"{cache}.json.tmp", f"{cache}.json")
    return spark.read.parquet(cache)


def recalls(found: DataFrame, truth: DataFrame, k: int) -> tuple[float, float]:
    """(mean, least) recall over the queries; (0, 0) without queries."""
    want = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    got = found.select(F.col("qid").alias("q_q"), F.col("vec_id").alias("q_v"))
    per = want.join(got, (F.col("qid") == F.col("q_q")) & (F.col("vec_id") == F.col("q_v")), "left").groupBy("qid").agg((F.count("q_v") / F.count("*")).alias("r"))
    r = per.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean"), F.coalesce(F.min("r"), F.lit(0.0)).alias("low")).first()
    return r.mean, r.low


def window(engine: VectorEngine, queries: DataFrame, k: int, concurrency: int, seconds: float = 3.0, blocks: int = 4) -> tuple[float, list[float]]:
    """(queries per second, milliseconds per block) of one timed window; the first error ends it."""
    n = queries.count()
    parts = [queries] if concurrency == 1 else [queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) for i in range(blocks)]
    counts = [n] if concurrency == 1 else [p.count() for p in parts]
    times: list[float] = []
    done, turn, lock = 0, 0, Lock()
    began = time.monotonic()

    def client(_: int) -> None:
        nonlocal done, turn
        while time.monotonic() - began < seconds:
            with lock:
                i, turn = turn % len(parts), turn + 1
            t = time.monotonic()
            engine.search(parts[i], k).write.format("noop").mode("overwrite").save()
            with lock:
                times.append((time.monotonic() - t) * 1000)
                done += counts[i]

    with ThreadPoolExecutor(concurrency) as pool:
        list(pool.map(client, range(concurrency)))
    return done / (time.monotonic() - began), times


def memory_mb(spark: SparkSession) -> float:
    """Memory in use: the heap of the driver's JVM, and the resident set of this Python process."""
    r = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    pages = 0
    if os.path.exists("/proc/self/statm"):
        with open("/proc/self/statm") as f:
            pages = int(f.read().split()[1])
    return (r.totalMemory() - r.freeMemory() + pages * os.sysconf("SC_PAGE_SIZE")) / (1 << 20)


def run_protocol(engine: VectorEngine, base: DataFrame, queries: DataFrame, k: int = 10, sweep: tuple[int, ...] = (64, 128), concurrency: tuple[int, ...] = (1,), seconds: float = 3.0, dataset: str = "", truth: DataFrame | None = None, path: str = "/tmp") -> list[dict]:
    """One row per setting and concurrency."""
    spark = base.sparkSession
    t = time.monotonic()
    engine.build(base)
    build_s, n = time.monotonic() - t, base.count()
    truth = (truth if truth is not None else ground_truth(spark, engine.base, queries, engine.dim, k)).persist()
    out = []
    for value in sweep:
        engine.set_param(value)
        engine.search(queries.limit(20), k).write.format("noop").mode("overwrite").save()
        mean, low = recalls(engine.search(queries, k), truth, k)
        for c in concurrency:
            qps, times = window(engine, queries, k, c, seconds)
            out.append({"engine": engine.name, "dataset": dataset, "param": str(value), "mode": engine.mode, "medium": storage_medium(path), "n": n, "dim": engine.dim, "k": k, "concurrency": c, "build_s": build_s, "insert_qps": n / build_s if build_s else 0.0, "recall_mean": mean, "recall_min": low, "qps": qps, "p50_ms": percentile_linear(times, 0.5), "p99_ms": percentile_linear(times, 0.99), "mem_mb": memory_mb(spark)})
    truth.unpersist()
    engine.close()
    return out


def emit(rows: list[dict]) -> str:
    """JSON lines, one per row."""
    return "\n".join(json.dumps(r) for r in rows)
