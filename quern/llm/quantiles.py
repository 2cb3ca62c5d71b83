"""Percentiles of very large numeric columns, per group, with a bounded error, from mergeable parts.

A sketch is a hierarchy of compactors. Level h holds values that each stand for 2**h values. When
a level is full it is sorted and every second value, the odd or the even ones by a fair coin, goes
up a level; the others are forgotten. Sketches merge level by level, so partitions, and the days
of a set, are added up without their values.

Error bound: one compaction at level h changes the rank of any value by 2**h or by nothing, up or
down with the same chance, and independently of the others. By Hoeffding's inequality the rank of
an answer is off by at most ``sqrt(2 * V * ln(2 / delta))`` with probability 1 - delta, V being the
sum of 4**h over the compactions made. V is kept in the sketch and adds up in merges, so the bound
that is stated belongs to the sketch at hand; it is 0 while nothing has been forgotten. Delta is
shared out among the percentiles that are asked for, so the stated confidence holds for all of
them together.

Defined results: null, NaN and infinite values take no part, nor do those below ``least``; rows with null keys form
groups of their own; repeated rows count as often as they occur; groups without values, and empty
tables, give no row. A percentile is the smallest value whose rank is at least p * n.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Capacity of the highest level; the levels below shrink by DECAY, to LEAST.
K, DECAY, LEAST = 1024, 2 / 3, 8
DELTA = 0.01
#: Values a worker gathers before it folds them in, and values it keeps before it hands its sketches on.
GATHER, HOLD = 262_144, 4_000_000
#: Partial sketches of a group and day meet in so many parts first.
SALTS = 32

SKETCH = "q_n bigint, q_var double, q_levels array<array<double>>"


class Sketch:
    """A compactor hierarchy. ``coins`` is seeded by where the sketch is made, so a repeated task repeats it."""

    def __init__(self, coins: np.random.Generator, k: int = K) -> None:
        self.k, self.coins, self.n, self.var = k, coins, 0, 0.0
        self.levels: list[np.ndarray] = [np.empty(0)]

    def capacity(self, h: int) -> int:
        return max(LEAST, math.ceil(self.k * DECAY ** (len(self.levels) - 1 - h)))

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compact()

    def merge(self, n: int, var: float, levels: Sequence[np.ndarray]) -> None:
        self.n += n
        self.var += var
        while len(self.levels) < len(levels):
            self.levels.append(np.empty(0))
        for h, v in enumerate(levels):
            if len(v):
                self.levels[h] = np.concatenate([self.levels[h], v])
        self._compact()

    def _compact(self) -> None:
        while sum(map(len, self.levels)) > sum(self.capacity(h) for h in range(len(self.levels))):
            h = next(h for h in range(len(self.levels)) if len(self.levels[h]) > self.capacity(h))
            if h + 1 == len(self.levels):
                self.levels.append(np.empty(0))
            v = np.sort(self.levels[h])
            rest = v[len(v) // 2 * 2 :]
            kept = v[int(self.coins.integers(2)) : len(v) // 2 * 2 : 2]
            self.levels[h], self.levels[h + 1] = rest, np.concatenate([self.levels[h + 1], kept])
            self.var += 4.0**h

    def quantiles(self, ps: Sequence[float]) -> list[float | None]:
        if not self.n:
            return [None] * len(ps)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 2**h, dtype=np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        return [float(values[min(len(values) - 1, np.searchsorted(upto, p * upto[-1] * (1 - 1e-15)))]) for p in ps]

    def rank_error(self, delta: float = DELTA) -> float:
        return math.sqrt(2 * self.var * math.log(2 / delta)) / self.n if self.n else 0.0


def _seed(*parts: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(parts).encode()))


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys)


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow_schema(df: DataFrame, keys: Sequence[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = df.select(*keys).schema
    fields = [*to_arrow_schema(spark_schema)]
    return pa.schema([*fields, pa.field("q_n", pa.int64()), pa.field("q_var", pa.float64()), pa.field("q_levels", pa.list_(pa.list_(pa.float64())))])


def day_sketches(df: DataFrame, keys: Sequence[str], day: Column, value: str, k: int = K, least: float | None = 0.0) -> DataFrame:
    """(*keys, day, q_n, q_var, q_levels): what is kept of each day.

    Every partition folds its rows into one sketch per group and day before anything is shuffled;
    a group that holds a third of all rows then costs as many small rows as there are partitions,
    which meet in SALTS parts and then in one. ``least``: smaller values take no part; None keeps all.
    """
    v = F.col(value).cast("double")
    used = ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.where(used if least is None else used & (v >= least)).select(*keys, day.cast("date").alias("day"), v.alias("q_value"))
    by = [*keys, "day"]
    arrow = _arrow_schema(rows, by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: dict[tuple, Sketch] = {}
        gathered: list[pa.RecordBatch] = []
        size = flushed = 0

        def fold_in() -> None:
            t = pa.Table.from_batches(gathered)
            codes = np.zeros(t.num_rows, dtype=np.int64)
            columns = []
            for c in by:
                d = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
                codes = codes * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
                columns.append((d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()))
            values = t.column("q_value").to_numpy()
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0, True])
            for a, b in zip(edges[:-1], edges[1:]):
                first = order[a]
                key = tuple(names[idx[first]] for idx, names in columns)
                if key not in held:
                    held[key] = Sketch(_seed(part, flushed, key), k)
                held[key].add(values[order[a:b]])

        def flush() -> pa.RecordBatch:
            return _to_batch([(*key, s.n, s.var, s.levels) for key, s in held.items()], arrow)

        for b in batches:
            gathered.append(b)
            size += b.num_rows
            if size >= GATHER:
                fold_in()
                gathered, size = [], 0
                if sum(sum(map(len, s.levels)) for s in held.values()) > HOLD:
                    yield flush()
                    held, flushed = {}, flushed + 1
        if gathered:
            fold_in()
        if held:
            yield flush()

    schema = f"{_schema(rows, by)}, {SKETCH}"
    parts = rows.mapInArrow(fold, schema).withColumn("q_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return merge_sketches(merge_sketches(parts, [*by, "q_salt"], k), by, k)


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """(*keys, q_n, q_var, q_levels): the sketches of each group of ``keys`` as one."""
    arrow = _arrow_schema(sketches, keys)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        names = tuple(x.as_py() for x in key)
        s = Sketch(_seed("merge", names), k)
        for n, var, levels in zip(table["q_n"].to_pylist(), table["q_var"].to_pylist(), table["q_levels"].to_pylist()):
            s.merge(n, var, [np.asarray(v, dtype=np.float64) for v in levels])
        return pa.Table.from_batches([_to_batch([(*names, s.n, s.var, s.levels)], arrow)])

    spark = sketches.sparkSession
    # a stated number of partitions, because sketches are small and would be gathered in a few tasks
    rows = sketches.select(*keys, "q_n", "q_var", "q_levels").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    return rows.groupBy(*keys).applyInArrow(merge, f"{_schema(sketches, keys)}, {SKETCH}")


def percentiles(sketches: DataFrame, keys: Sequence[str], ps: Sequence[float] = (0.5, 0.95, 0.99), days: Column | None = None, k: int = K, delta: float = DELTA) -> DataFrame:
    """(*keys, n, p50, p95, p99, rank_error, confidence) over the days that ``days`` selects, all by default."""
    rows = sketches if days is None else sketches.where(days)
    names = [f"p{round(p * 100):d}" if abs(p * 100 - round(p * 100)) < 1e-9 else f"p{p * 100:g}".replace(".", "_") for p in ps]

    @F.pandas_udf(", ".join([*[f"{n} double" for n in names], "rank_error double"]))
    def ask(n: pd.Series, var: pd.Series, levels: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(n, var, levels):
            s = Sketch(_seed(0), k)
            s.n, s.var, s.levels = int(a), float(b), [np.asarray(v, dtype=np.float64) for v in c]
            out.append((*s.quantiles(ps), s.rank_error(delta / len(ps))))
        return pd.DataFrame(out, columns=[*names, "rank_error"])

    merged = merge_sketches(rows, keys, k).withColumn("q_a", ask("q_n", "q_var", "q_levels"))
    return merged.select(*keys, F.col("q_n").alias("n"), *[F.col("q_a")[n].alias(n) for n in names], F.col("q_a")["rank_error"].alias("rank_error"), F.lit(1 - delta).alias("confidence"))
