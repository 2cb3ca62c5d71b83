"""Per-key results when a few keys hold most records.

Fragment and replicate by estimated load. One scan of the key column estimates the loads of the
heavy keys with mergeable Misra-Gries summaries; the keys are bin-packed to tasks, a key larger
than a task's share is split into shards in proportion to its load, and of a matching side only
the rows of such keys are replicated, to that key's shards.

Defined results: a null key is no key (its rows count for the total only); repeated rows count
as often as they occur; an empty table gives no rows; a plan never drops or samples rows, it only
says where a row goes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it may hold more than this part of a task's share of the rows.
HEAVY_PART = 0.25
#: Light keys are packed in this many hash buckets a task.
BUCKETS_PER_TASK = 8


@dataclass
class LoadPlan:
    """Where rows go. ``heavy``: key to its tasks, one per shard; ``buckets``: task of each bucket of light keys; ``loads``: expected rows per task."""

    tasks: int
    total: int
    heavy: dict[int, list[int]] = field(default_factory=dict)
    buckets: list[int] = field(default_factory=list)
    loads: list[float] = field(default_factory=list)


def _reduced(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """At most ``capacity`` keys: the next largest count is taken off all of them."""
    if len(counts) <= capacity:
        return counts
    cut = heapq.nlargest(capacity + 1, counts.values())[-1]
    return {k: v - cut for k, v in counts.items() if v > cut}


def _summaries(capacity: int):
    """Misra-Gries per input partition: every key above rows/capacity is in it, short of at most rows/capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for b in batches:
            for x in pc.value_counts(b.column(0).drop_null()).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            if len(counts) > 4 * capacity:
                counts = _reduced(counts, capacity)
        counts = _reduced(counts, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["q_key", "q_rows"])

    return run


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Estimates loads and packs them to tasks.

    At most ``tasks / HEAVY_PART`` keys can be heavy and the driver gets only these, so what it
    collects and what the plan broadcasts is bounded by the number of tasks, not by the data.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = int(4 * tasks / HEAVY_PART)
    total = df.count()
    part = df.select(F.col(key).cast("long").alias("q_key")).mapInArrow(_summaries(capacity), "q_key long, q_rows long")
    sums = part.groupBy("q_key").agg(F.sum("q_rows").alias("q_rows"))
    rows = sums.where(F.col("q_rows") > total * HEAVY_PART * 0.75 / tasks).collect()
    plan = LoadPlan(tasks, total)
    heavy = {r.q_key: r.q_rows for r in rows}
    share = max(1.0, total / tasks)
    items: list[tuple[float, object]] = []
    for k, n in heavy.items():
        shards = max(1, round(n / (share * HEAVY_PART)))
        items += [(n / shards, k)] * shards
    buckets = tasks * BUCKETS_PER_TASK
    light = max(0, total - sum(heavy.values())) / buckets
    items += [(light, ("bucket", i)) for i in range(buckets)]
    heap = [(0.0, t) for t in range(tasks)]
    plan.buckets, plan.loads = [0] * buckets, [0.0] * tasks
    for load, what in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        has, t = heapq.heappop(heap)
        heapq.heappush(heap, (has + load, t))
        plan.loads[t] = has + load
        if isinstance(what, tuple):
            plan.buckets[what[1]] = t
        else:
            plan.heavy.setdefault(what, []).append(t)
    return plan


def _heavy_frame(spark, plan: LoadPlan) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in plan.heavy.items()], "q_heavy long, q_tasks array<int>")


def place(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """``df`` with ``q_shard`` (number of the row's shard of its key) and ``q_task``.

    The broadcast table has at most ``tasks / HEAVY_PART`` rows. Rows of a heavy key take its
    shards in turn, whatever they hold, so repeated rows are spread as well.
    """
    heavy = F.broadcast(_heavy_frame(df.sparkSession, plan))
    turn: Column = F.xxhash64(F.monotonically_increasing_id())
    rows = df.withColumn("q_turn", turn).join(heavy, F.col(key).cast("long") == F.col("q_heavy"), "left")
    rows = rows.withColumn("q_shard", F.when(F.col("q_heavy").isNull(), 0).otherwise(F.pmod("q_turn", F.size("q_tasks"))).cast("int"))
    bucket = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(len(plan.buckets))).cast("int")
    light = F.element_at(F.lit(plan.buckets).cast("array<int>"), bucket + 1)
    task = F.when(F.col("q_heavy").isNull(), light).otherwise(F.element_at("q_tasks", F.col("q_shard") + 1))
    return rows.withColumn("q_task", task.cast("int")).drop("q_turn", "q_heavy", "q_tasks")


def _partials(key: str, aggs: Sequence[tuple[str, str, str]]):
    """Per-task partial aggregates over Arrow batches; memory follows the distinct keys of a task."""
    how = [(c, f) for c, f, _ in aggs]
    again = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = [key, *[n for _, _, n in aggs]]
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(key).aggregate([(c, f, pc.CountOptions("all")) if f == "count" else (c, f) for c, f in how])
            t = t.select([key, *[f"{c}_{f}" for c, f in how]]).rename_columns(names)
            if held is not None:
                t = pa.concat_tables([held, t]).group_by(key).aggregate([(n, again[f]) for _, f, n in aggs])
                t = t.select([key, *[f"{n}_{again[f]}" for _, f, n in aggs]]).rename_columns(names)
            held = t
        if held is not None:
            yield from held.to_batches()

    return run


def aggregate_by_key(df: DataFrame, key: str, aggs: Sequence[tuple[str, str, str]], plan: LoadPlan | None = None) -> DataFrame:
    """(key, *names): ``aggs`` are (column, 'count' | 'sum' | 'min' | 'max', name).

    Each task folds the rows packed to it; only shards of heavy keys have more than one partial
    row, which the last aggregation merges.
    """
    plan = plan or plan_loads(df, key)
    used = list(dict.fromkeys([key, *[c for c, _, _ in aggs]]))
    rows = df.select(*used).where(F.col(key).isNotNull())
    types = dict(rows.dtypes)
    placed = place(rows, key, plan).repartitionById(plan.tasks, F.col("q_task")).select(*used)
    kind = lambda c, f: "bigint" if f == "count" or (f == "sum" and types[c] in ("int", "bigint", "smallint")) else types[c]
    schema = ", ".join([f"`{key}` {types[key]}", *[f"`{n}` {kind(c, f)}" for c, f, n in aggs]])
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    return placed.mapInArrow(_partials(key, aggs), schema).groupBy(key).agg(*[again[f](n).alias(n) for _, f, n in aggs])


def fragment_replicate_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, plan: LoadPlan, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on the keys, heavy keys of ``left`` cut into their shards.

    A row of ``right`` is copied once for each shard of its key, one copy for all other keys, so
    the copies are bounded by the number of shards in the plan. ``how``: 'inner' or 'left'.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep their meaning when the right side is replicated")
    heavy = F.broadcast(_heavy_frame(left.sparkSession, plan))
    r = right.join(heavy, F.col(right_key).cast("long") == F.col("q_heavy"), "left")
    r = r.withColumn("q_rshard", F.explode(F.when(F.col("q_heavy").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("q_tasks") - 1))))
    r = r.drop("q_heavy", "q_tasks")
    placed = place(left, left_key, plan).drop("q_task")
    return placed.join(r, (F.col(left_key) == F.col(right_key)) & (F.col("q_shard") == F.col("q_rshard")), how).drop("q_shard", "q_rshard")
