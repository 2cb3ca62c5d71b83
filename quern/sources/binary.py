"""Binary vector formats as data sources, and their writers.

Formats (all little endian):

* ``fvecs``: per row an int32 dimension and that many float32; ``ivecs``: the same with int32.
* ``arena``: 24 bytes (8 bytes magic, uint32 version, uint32 dimension, uint64 count), then count
  rows of float16.
* ``ids``: one uint64 per row of an arena. The id of a row is looked up here, never computed.
* ``adjacency``: uint32 neighbours, ``degree`` per row (option ``degree``, or a JSON file beside it).

Rows have a fixed stride, so a file is read in ranges of rows by as many tasks as it has ranges.
Every worker opens the path, which has to be on a file system that all of them see.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the formats.
ARENA_MAGIC = b"HVARENA1"
ARENA_HEADER = struct.Struct("<8sIIQ")
MAX_DIM = 1_000_000

SCHEMAS = {
    "fvecs": "row bigint, embedding array<float>",
    "ivecs": "row bigint, ids array<int>",
    "arena": "rank bigint, embedding array<float>",
    "ids": "rank bigint, ext_id decimal(20,0)",
    "adjacency": "src bigint, slot int, dst bigint",
}


@dataclass
class Layout:
    """Where the rows of a file are: ``skip`` bytes, then ``rows`` rows of ``stride`` bytes with ``dim`` values."""

    skip: int
    stride: int
    dim: int
    rows: int


def layout(kind: str, path: str, degree: int = 0) -> Layout:
    """Reads the header and checks it against the file's size."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if kind in ("fvecs", "ivecs"):
            if not size:
                return Layout(0, 4, 0, 0)
            (dim,) = struct.unpack("<i", f.read(4))
            if not 0 < dim <= MAX_DIM:
                raise ValueError(f"{path}: dimension {dim}")
            stride = 4 + 4 * dim
            if size % stride:
                raise ValueError(f"{path}: {size} bytes are no whole number of rows of dimension {dim}")
            return Layout(0, stride, dim, size // stride)
        if kind == "arena":
            magic, _, dim, count = ARENA_HEADER.unpack(f.read(ARENA_HEADER.size))
            if magic != ARENA_MAGIC:
                raise ValueError(f"{path}: no arena")
            if size < ARENA_HEADER.size + count * dim * 2:
                raise ValueError(f"{path}: shorter than its {count} rows")
            return Layout(ARENA_HEADER.size, 2 * dim, dim, count)
        if kind == "ids":
            if size % 8:
                raise ValueError(f"{path}: {size} bytes are no whole number of ids")
            return Layout(0, 8, 1, size // 8)
    if degree <= 0 or size % (4 * degree):
        raise ValueError(f"{path}: {size} bytes are no whole number of rows of degree {degree}")
    return Layout(0, 4 * degree, degree, size // (4 * degree))


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    ROWS = 65_536

    def __init__(self, options: dict) -> None:
        self.kind, self.path = options.get("kind", "fvecs"), options["path"]
        degree = int(options.get("degree") or 0)
        if self.kind == "adjacency" and not degree:
            with open(options.get("meta") or self.path + ".json") as f:
                degree = int(json.load(f)["degree"])
        self.layout = layout(self.kind, self.path, degree)
        limit = options.get("limit")
        self.rows = min(self.layout.rows, int(limit)) if limit else self.layout.rows

    def partitions(self) -> list[RowRange]:
        return [RowRange(a, min(a + self.ROWS, self.rows)) for a in range(0, self.rows, self.ROWS)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        at = self.layout
        with open(self.path, "rb") as f:
            for a in range(part.first, part.last, 4096):
                n = min(4096, part.last - a)
                f.seek(at.skip + a * at.stride)
                raw = f.read(n * at.stride)
                yield self._batch(a, n, raw)

    def _batch(self, first: int, n: int, raw: bytes) -> pa.RecordBatch:
        at, rows = self.layout, np.arange(first, first + n, dtype=np.int64)
        if self.kind == "ids":
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.frombuffer(raw, "<u8")).cast(pa.decimal128(20, 0))], ["rank", "ext_id"])
        if self.kind == "adjacency":
            dst = np.frombuffer(raw, "<u4").astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, at.dim)), pa.array(np.tile(np.arange(at.dim, dtype=np.int32), n)), pa.array(dst)], ["src", "slot", "dst"])
        if self.kind == "arena":
            flat, name = pa.array(np.frombuffer(raw, "<f2").astype(np.float32)), ["rank", "embedding"]
        else:
            words = np.frombuffer(raw, "<i4").reshape(n, at.dim + 1)
            if n and not (words[:, 0] == at.dim).all():
                raise ValueError(f"{self.path}: rows of different dimension")
            body = np.ascontiguousarray(words[:, 1:]).ravel()
            flat = pa.array(body.view("<f4") if self.kind == "fvecs" else body)
            name = ["row", "embedding" if self.kind == "fvecs" else "ids"]
        offsets = pa.array(np.arange(0, (n + 1) * at.dim, at.dim, dtype=np.int32) if at.dim else np.zeros(n + 1, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(offsets, flat)], name)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int
    dim: int


class _Writer(DataSourceArrowWriter):
    """Each task writes a part; the commit joins them in order under a name of its own and renames."""

    def __init__(self, options: dict) -> None:
        self.kind, self.path = options.get("kind", "arena"), options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        path, rows, dim = f"{self.path}.part-{number}-{TaskContext.get().taskAttemptId()}", 0, 0
        with open(path, "wb") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                rows += b.num_rows
                if self.kind == "ids":
                    f.write(b.column(1).cast(pa.uint64()).to_numpy(zero_copy_only=False).astype("<u8").tobytes())
                    continue
                lists = b.column(1)
                sizes = set(np.diff(lists.offsets.to_numpy()).tolist())
                if len(sizes) != 1 or (dim and sizes != {dim}) or lists.null_count:
                    raise ValueError("vectors of different dimension")
                dim = sizes.pop()
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                if self.kind == "arena":
                    f.write(x.astype("<f2").tobytes())
                else:
                    head = np.full((len(x), 1), dim, dtype="<i4")
                    f.write(np.hstack([head, x.view("<i4")]).astype("<i4").tobytes())
        return Part(number, path, rows, dim)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        dims = {p.dim for p in parts if p.rows and self.kind != "ids"}
        if len(dims) > 1:
            self.abort(messages)
            raise ValueError("vectors of different dimension")
        tmp = self.path + ".tmp"
        with open(tmp, "wb") as out:
            if self.kind == "arena":
                out.write(ARENA_HEADER.pack(ARENA_MAGIC, 1, dims.pop() if dims else 0, sum(p.rows for p in parts)))
            for p in parts:
                with open(p.path, "rb") as f:
                    while block := f.read(1 << 22):
                        out.write(block)
            out.flush()
            os.fsync(out.fileno())
        os.replace(tmp, self.path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class VectorFile(DataSource):
    """``spark.read.format("vectorfile").option("kind", "fvecs").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "fvecs")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFile)


def read_binary(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    register(spark)
    r = spark.read.format("vectorfile").option("kind", kind)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def write_binary(df: DataFrame, path: str, kind: str, order: str, value: str, partitions: int | None = None) -> None:
    """Writes ``value`` in the order of the ``order`` column; ranks are then the rows' places."""
    register(df.sparkSession)
    rows = df.select(order, value)
    rows = (rows.repartitionByRange(partitions, order) if partitions else rows.repartitionByRange(order)).sortWithinPartitions(order)
    rows.write.format("vectorfile").option("kind", kind).mode("overwrite").save(path)


def with_ids(arena: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of an arena with their external ids, by rank; ranks without an id drop out."""
    return arena.join(ids, "rank")


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(vec_id, embedding): values in [0, 1) from a hash of seed, row and place; the same for any partitioning."""
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("vec_id"), i), 11) / F.lit(float(1 << 53))).cast("float"))
    return spark.range(n).select(F.col("id").alias("vec_id")).withColumn("embedding", x)
