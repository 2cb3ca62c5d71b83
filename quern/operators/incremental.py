"""Processing only new or changed records.

The target is the state: every row that a run writes carries the source's key and a version of
its content, so the rows still to be processed are the source anti-joined with the target on key
and version. There is no position that could run ahead of the rows. A run becomes visible by one
rename of a manifest, so a run that fails leaves nothing that a later one would see.

Defined results: null equals null in keys and content; of several deliveries of a key the latest
counts (largest order columns); equal rows are one row; an empty source or target is allowed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import _fs, delete


def content_version(columns: Sequence[str]) -> Column:
    """A digest of the columns, 16 bytes, in which null differs from '' and equals null.

    The JSON text leaves null fields out and names the others, so it is one-to-one.
    """
    return F.substring(F.unhex(F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)), 1, 16)


def latest_version(deliveries: DataFrame, keys: Sequence[str], order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """(*keys, version) of the latest delivery of each key, by map-side combined aggregation."""
    rows = deliveries.select(*keys, F.struct(*order).alias("q_order"), content_version(content).alias("q_version"))
    return rows.groupBy(*keys).agg(F.max_by("q_version", "q_order").alias("version"))


def changed(source: DataFrame, target: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Rows of ``source`` whose key is not in ``target`` with the same version."""
    t = target.select(*[F.col(c).alias(f"q_t_{c}") for c in [*keys, version]])
    on = None
    for c in [*keys, version]:
        one = F.col(c).eqNullSafe(F.col(f"q_t_{c}"))
        on = one if on is None else on & one
    return source.join(t, on, "left_anti")


def last_good_runs(runs: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, head_pos, ended_at) of the run with status 'ok' and the largest id of each shard."""
    ok = runs.where(F.col("status") == "ok").select(shard, "id", "head_pos", "ended_at")
    return ok.groupBy(shard).agg(F.max_by(F.struct("head_pos", "ended_at"), "id").alias("q_run")).select(shard, "q_run.head_pos", "q_run.ended_at")


def published_at_last_run(deliveries: DataFrame, runs: DataFrame, content: Sequence[str]) -> DataFrame:
    """The target as the last good run of each shard left it: (shard, id, version).

    A run that ended at E with head position P has published, of each id up to P, the latest
    delivery fetched up to E. Shards without a good run have published nothing.
    """
    good = last_good_runs(runs).select(F.col("shard").alias("q_shard"), "head_pos", "ended_at")
    seen = deliveries.join(good, F.col("shard") == F.col("q_shard")).where(F.col("fetched_at") <= F.col("ended_at"))
    seen = seen.where(F.col("head_pos").isNull() | (F.col("id") <= F.col("head_pos")))
    return latest_version(seen, ["shard", "id"], ["fetched_at", "seq"], content)


#: Parts of a target after which the next run writes them as one.
COMPACT_PARTS = 16
#: Seconds between the claim of a number and its manifest after which the run is taken for dead.
CLAIM_SECONDS = 600


class VersionedTarget:
    """A target table whose versions are published atomically.

    ``path/parts/<uuid>`` holds the rows of one run, ``path/manifests/<n>.json`` the parts of
    version n. A run claims its number by creating ``claims/<n>`` with overwriting off, which one of
    two racing runs cannot, and the version exists once its manifest has its name, by one rename.
    Rows of a key in a later part replace those in an earlier one; after COMPACT_PARTS parts they
    are written as one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "parts": [], "schema": None}
        n = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/manifests/{n:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, one per key; None before the first one."""
        m = self.manifest(version)
        if not m["parts"]:
            return None
        rows = None
        for i, part in enumerate(m["parts"]):
            df = self.spark.read.parquet(f"{self.path}/parts/{part}").withColumn("q_part", F.lit(i))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in (*self.keys, "q_part")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "q_part").alias("q_row"))
        return latest.select(*self.keys, *[F.col("q_row")[c].alias(c) for c in rest])

    def pending(self, source: DataFrame, version: str = "version") -> DataFrame:
        """What a run has to process: the source's rows that the target does not hold."""
        target = self.read()
        return source if target is None else changed(source, target, self.keys, version)

    def publish(self, rows: DataFrame, compact: bool = False) -> int:
        """Writes ``rows`` as a part and publishes the next version; returns its number."""
        m = self.manifest()
        part = uuid.uuid4().hex
        compact = compact or len(m["parts"]) >= COMPACT_PARTS
        old = self.read() if compact else None
        if old is not None:
            rows = changed(old, rows, self.keys[:-1], self.keys[-1]).unionByName(rows, allowMissingColumns=True)
        rows.write.parquet(f"{self.path}/parts/{part}")
        n = self._claim(m["version"])
        text = json.dumps({"version": n, "parts": [part] if compact else [*m["parts"], part]})
        fs, tmp = _fs(self.spark, f"{self.path}/manifests/.{part}.tmp")
        fs.mkdirs(tmp.getParent())
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = _fs(self.spark, f"{self.path}/manifests/{n:010d}.json")
        if fs.exists(final) or not fs.rename(tmp, final):
            delete(self.spark, f"{self.path}/manifests/.{part}.tmp")
            delete(self.spark, f"{self.path}/parts/{part}")
            raise RuntimeError(f"version {n} was published by another run")
        return n

    def _claim(self, version: int) -> int:
        """The number after ``version``, for one run only; a claim that led to nothing for CLAIM_SECONDS is taken over."""
        n = version + 1
        fs, p = _fs(self.spark, f"{self.path}/claims/{n:010d}")
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > CLAIM_SECONDS:
            fs.delete(p, False)
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"version {n} was claimed by another run") from e
        return n

    def run(self, source: DataFrame, transform=lambda df: df, version: str = "version") -> int:
        """One incremental run: anti-join, transform, publish. A failure before the rename publishes nothing."""
        return self.publish(transform(self.pending(source, version)))
