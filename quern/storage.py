"""Written intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it back, so that a lost
executor costs at most the step that is running. The folder is ``spark.checkpoint.dir`` of the
session; only where that is unset in local mode (tests, a laptop) a temporary folder is made and
set. On a cluster an unset folder is an error, because executors would write to their own disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Scratch:
    """Tables of one run of an operator.

    ``save`` writes a table and returns a reader of it; ``drop`` removes one that no later step
    reads. What is left when the Python process ends is removed then, because the operator's
    result is lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.read(name, df)

    def read(self, name: str | list[str], like: DataFrame) -> DataFrame:
        """One scan over a table, or over several of one schema."""
        names = [name] if isinstance(name, str) else name
        return self.spark.read.schema(like.schema).parquet(*[f"{self.root}/{n}" for n in names])

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def _clean(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
