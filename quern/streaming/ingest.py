"""Incremental ingestion: two cursors with budgets, idempotent batches, run log.

``Ingest.cycle`` takes ids from a feed in two phases: first (head, newest], then (backfill,
head_origin]. ``head_origin`` is fixed when ingestion starts, so the phases never overlap. A cursor
moves once its rows are published; a failure in between takes the same ids again. ``Ingest.run``
takes deliveries from a stream, whose checkpoint is the cursor.

Replaying a batch changes nothing, because rows whose id and content the target already holds are
anti-joined away first. Of several deliveries of an id the one that was fetched last counts, also
across batches. A deletion of a stored item is stored as such; ``Ingest.live`` leaves it out.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quern.functions.text import text_or_title
from quern.operators.incremental import VersionedTarget, content_version
from quern.sources.files import FEED

CONTENT = ["type", "time", "title", "text", "parent", "dead", "deleted"]


def _is_alive() -> Column:
    return ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))


def alive(feed: DataFrame) -> DataFrame:
    """Deliveries that name a live item; the others are skipped."""
    return feed.where(F.col("id").isNotNull() & _is_alive())


def embed_column(df: DataFrame, key: str, text: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], dim: int, attempts: int = 8, wait: float = 0.25) -> DataFrame:
    """(key, embedding): ``embed`` maps texts to vectors in order; a busy embedder is asked again, waiting longer each time.

    A short answer, or a vector of another length, fails the task.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                for n in range(attempts):
                    try:
                        got = embed(part)
                        break
                    except BlockingIOError:
                        if n + 1 == attempts:
                            raise
                        time.sleep(min(4.0, wait * 2**n))
                if len(got) != len(part) or any(len(v) != dim for v in got):
                    raise ValueError(f"{len(part)} texts, {len(got)} vectors")
                flat = np.asarray(got, dtype=np.float32).ravel()
                offsets = np.arange(0, (len(part) + 1) * dim, dim, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


@dataclass
class Ingest:
    """Folders of one ingestion: ``items`` and ``vectors`` are versioned targets, ``runs`` the run log."""

    spark: SparkSession
    folder: str
    embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]
    dim: int

    @property
    def items(self) -> VersionedTarget:
        return VersionedTarget(self.spark, f"{self.folder}/items", ["id"])

    @property
    def vectors(self) -> VersionedTarget:
        return VersionedTarget(self.spark, f"{self.folder}/vectors", ["id"])

    def live(self) -> DataFrame | None:
        """The items without those that were deleted at the source."""
        held = self.items.read()
        return None if held is None else alive(held)

    def batch(self, feed: DataFrame, number: int, phase: str = "stream", pos: int | None = None) -> None:
        """One batch: the last delivery of each id, if the target does not hold it; vectors, then items, then the log.

        Vectors are published first, so an item that is visible has its vector; after a crash in
        between the same rows are taken again and replace themselves. Dead rows count only if
        their item is stored, and then take its place without a vector.
        """
        began = time.time()
        when = [c for c, _ in _DELIVERY if c in feed.columns]
        for c, kind in _DELIVERY:
            if c not in when:
                feed = feed.withColumn(c, F.lit(None).cast(kind))
        rows = feed.where(F.col("id").isNotNull()).withColumn("version", content_version(CONTENT))
        order = F.struct("fetched_at", "seq", "time", "version")
        kept = [*CONTENT, "version", "fetched_at", "seq"]
        rows = rows.groupBy("id").agg(F.max_by(F.struct(*kept), order).alias("r"), F.count("*").alias("q_n")).select("id", "r.*", "q_n")
        held = self.items.read()
        dead = ~_is_alive()
        if held is None:
            taken = rows.where(~dead)
        else:
            old = held.select(F.col("id").alias("q_id"), F.col("fetched_at").alias("q_at"), F.col("version").alias("q_v"))
            rows_ = rows.join(old, F.col("id") == F.col("q_id"), "left")
            known, later = F.col("q_id").isNotNull(), F.coalesce(F.col("fetched_at") >= F.col("q_at"), F.lit(True))
            taken = rows_.where(F.when(known, later & (F.col("version") != F.col("q_v"))).otherwise(~dead))
        new = taken.select("id", *kept).withColumn("q_text", text_or_title(F.col("text"), F.col("title"))).persist()
        try:
            n = new.count()
            if n:
                vectors = embed_column(new.where(_is_alive()), "id", "q_text", self.embed, self.dim)
                self.vectors.publish(vectors.join(new.select("id", "version"), "id"))
                self.items.publish(new.drop("q_text"))
            total = rows.agg(F.coalesce(F.sum("q_n"), F.lit(0))).first()[0]
            self.log(number, began, n, "ok", "", total - n, phase, pos)
        except Exception as e:
            self.log(number, began, 0, "error", str(e)[:500], 0, phase, pos)
            raise
        finally:
            new.unpersist()

    def log(self, number: int, began: float, ingested: int, status: str, error: str, skipped: int = 0, phase: str = "stream", pos: int | None = None) -> None:
        row = [(number, began, time.time(), ingested, skipped, phase, pos, status, error)]
        df = self.spark.createDataFrame(row, "batch bigint, began double, ended double, ingested bigint, skipped bigint, phase string, pos bigint, status string, error string")
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def run(self, feed: DataFrame) -> None:
        """Takes everything the stream has, then stops; the next call goes on where this one ended."""
        q = feed.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    # --- two cursors ---

    @property
    def _cursors(self) -> VersionedTarget:
        return VersionedTarget(self.spark, f"{self.folder}/cursors", ["name"])

    def cursors(self) -> dict[str, int]:
        held = self._cursors.read()
        return {} if held is None else {r.name: r.pos for r in held.collect()}

    def _move(self, **positions: int) -> None:
        self._cursors.publish(self.spark.createDataFrame(list(positions.items()), "name string, pos bigint"))

    def cycle(self, newest: int, fetch: Callable[[int], tuple | None], head_budget: str | None = None, backfill_budget: str | None = None, floor: int = 0, per_batch: int = 100_000, tasks: int | None = None) -> dict[str, int]:
        """One run: the head phase up to ``newest``, then the backfill phase; returns the cursors.

        The first run fixes head_origin at ``newest`` and backfills from ``floor``. ``fetch`` gives
        a row of the feed or None and runs in the executors, ``tasks`` id ranges at a time. Budgets
        as in ``parse_budget``; None is unbounded. A budget of time is looked at between batches.
        """
        at = self.cursors()
        if not at:
            self._move(head=newest, head_origin=newest, backfill=floor)
            at = self.cursors()
        up, back = id_ranges(at["head"], newest, at["backfill"], at["head_origin"], None, None)
        for name, ids, budget in (("head", up, head_budget), ("backfill", back, backfill_budget)):
            kind, most = parse_budget(budget) if budget is not None else ("items", len(ids))
            until = time.time() + most if kind == "seconds" else None
            ids = ids[: int(most)] if kind == "items" else ids
            for a in range(0, len(ids), per_batch):
                if until is not None and time.time() >= until:
                    break
                part = ids[a : a + per_batch]
                self.batch(fetched(self.spark, part, fetch, tasks), part[-1], name, part[-1])
                self._move(**{name: part[-1]})
        return self.cursors()


_DELIVERY = (("fetched_at", "timestamp"), ("seq", "bigint"))


def fetched(spark: SparkSession, ids: range, fetch: Callable[[int], tuple | None], tasks: int | None = None) -> DataFrame:
    """Rows of the feed for a range of ids, fetched by many tasks; ids without a row are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in map(fetch, b.column(0).to_pylist()) if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], FEED).schema)
    tasks = tasks or spark.sparkContext.defaultParallelism
    return spark.range(ids.start, ids.stop, 1, tasks).mapInArrow(run, FEED)


def feed_files(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """NDJSON deliveries as a stream."""
    return spark.readStream.schema(f"{FEED}, fetched_at timestamp, seq bigint").option("maxFilesPerTrigger", per_batch).json(folder)


@dataclass
class IdRange(InputPartition):
    first: int
    last: int


def feed_source(max_id: Callable[[], int], fetch: Callable[[int], tuple | None], per_batch: int = 1000) -> type[DataSource]:
    """A streaming source over ids: ``max_id`` tells the newest, ``fetch`` gives a row or None for an id.

    The offset is the last id taken, so a restart neither skips nor repeats one. A batch goes up to
    the newest id and is fetched by the executors, ``per_batch`` ids a task. Option: ``start``
    (first id).
    """

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.start = int(options.get("start", 1))

        def initialOffset(self) -> dict:
            return {"next": self.start}

        def latestOffset(self) -> dict:
            return {"next": max(self.start, max_id() + 1)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [IdRange(a, min(a + per_batch, end["next"])) for a in range(start["next"], end["next"], per_batch)]

        def read(self, partition: IdRange) -> Iterator[tuple]:
            return (r for r in map(fetch, range(partition.first, partition.last)) if r is not None)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "idfeed"

        def schema(self) -> str:
            return FEED

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(dict(self.options))

    return Feed


def id_ranges(head: int, newest: int, backfill: int, head_origin: int, head_budget: int | None, backfill_budget: int | None) -> tuple[range, range]:
    """The ids of one cycle: (head, newest] and then (backfill, head_origin], each cut to its budget.

    ``head_origin`` is frozen when ingestion starts, so the two never overlap. A budget of None is
    unbounded, one of 0 takes nothing.
    """
    up = range(head + 1, newest + 1)
    back = range(backfill + 1, head_origin + 1)
    return (up if head_budget is None else up[:head_budget]), (back if backfill_budget is None else back[:backfill_budget])


def parse_budget(text: str) -> tuple[str, float]:
    """('seconds', s) for '90s' or '2m', ('items', n) for a number; nothing below zero, and zero takes nothing."""
    t = text.strip()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m|h)", t):
        return "seconds", float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[m[2]]
    if re.fullmatch(r"\d+", t):
        return "items", int(t)
    raise ValueError(f"no budget: {text!r}")
