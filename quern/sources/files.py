"""Text formats: vectors as JSON lines, items as NDJSON, query batches, result rows; and shards."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.binary import read_binary

ITEM = "id bigint, ts bigint, type string, title string, parent bigint, text string"
FEED = "id bigint, type string, time bigint, title string, text string, parent bigint, dead boolean, deleted boolean"
RESULT = "engine string, dataset string, param string, mode string, medium string, n bigint, dim int, k int, concurrency int, build_s double, insert_qps double, recall_mean double, recall_min double, qps double, p50_ms double, p99_ms double, mem_mb double"


def read_jsonl_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(embedding): one JSON array per line; blank lines are skipped, other broken lines fail."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.from_json("value", "array<double>")
    checked = F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), F.raise_error(F.concat(F.lit("not a vector: "), F.substring("value", 1, 80)))).otherwise(v)
    return lines.select(F.transform(checked, lambda x: x.cast("float")).alias("embedding"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """By extension: JSON lines, fvecs, parquet; a path that names fvecs is read as such."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".jsonl", ".json", ".ndjson"):
        return read_jsonl_vectors(spark, path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext == ".fvecs" or "fvecs" in path:
        return read_binary(spark, path, "fvecs").select("embedding")
    return read_jsonl_vectors(spark, path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON items; a line that cannot be read fails the job."""
    return spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Measurement rows; older files have no mode and medium, which are then null."""
    return spark.read.schema(RESULT).json(path)


def read_query_batch(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, vector) of a batch document; qid keeps its JSON form."""
    doc = spark.read.text(path, wholetext=True)
    q = F.from_json("value", "struct<queries: array<struct<text: string, vector: array<double>>>>")["queries"]
    rows = doc.select("value", F.posexplode(q).alias("pos", "q"))
    keep = F.expr("get_json_object(value, concat('$.queries[', cast(pos as string), '].qid'))")
    return rows.select(keep.alias("qid"), F.col("q.text").alias("text"), F.transform("q.vector", lambda x: x.cast("float")).alias("vector"))


def check_vectors(df: DataFrame, column: str = "embedding") -> int:
    """The common dimension; an empty set, an empty vector or mixed dimensions are errors."""
    n = F.size(column)
    r = df.agg(F.count("*").alias("rows"), F.min(n).alias("low"), F.max(n).alias("high")).first()
    if not r.rows:
        raise ValueError("no vectors")
    if r.low is None or r.low <= 0 or r.low != r.high:
        raise ValueError(f"dimensions from {r.low} to {r.high}")
    return r.high


def split_holdout(df: DataFrame, key: str, holdout: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, queries): the last ``holdout`` keys are the queries, the first ``limit`` others the base."""
    n = df.count()
    if not 0 < holdout < n:
        raise ValueError(f"holdout {holdout} of {n} rows")
    q = df.orderBy(F.col(key).desc()).limit(holdout)
    base = df.join(q.select(F.col(key).alias("q_key")), F.col(key) == F.col("q_key"), "left_anti")
    return (base.orderBy(key).limit(limit) if limit and limit < n - holdout else base), q


def discover_shards(folder: str) -> list[tuple[str, str, str]]:
    """(label, index, arena) of the pairs X.db and X.db.arena or X.arena, by label; files without a partner are left out."""
    names = set(os.listdir(folder))
    out = []
    for name in sorted(names):
        if name.endswith(".db"):
            stem = name[:-3]
            arena = next((a for a in (f"{name}.arena", f"{stem}.arena") if a in names), None)
            if arena:
                out.append((f"month:{stem}", f"{folder}/{name}", f"{folder}/{arena}"))
    return sorted(out)


def month_bounds(months: list[str]) -> list[tuple[str, int, int]]:
    """(label, first second, second after the last) of 'YYYY-MM' labels, UTC."""
    import calendar

    out = []
    for m in months:
        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", m):
            raise ValueError(f"no month: {m}")
        y, n = int(m[:4]), int(m[5:])
        nxt = (y + n // 12, n % 12 + 1)
        out.append((m, calendar.timegm((y, n, 1, 0, 0, 0)), calendar.timegm((*nxt, 1, 0, 0, 0))))
    return out


def write_manifest(path: str, fields: dict) -> None:
    """One JSON document, published by a rename after its bytes are on disk."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "w") as f:
        json.dump(fields, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def read_manifest(path: str, magic: str) -> dict:
    with open(path) as f:
        fields = json.load(f)
    if fields.get("magic") != magic:
        raise ValueError(f"{path}: magic {fields.get('magic')!r}")
    return fields
