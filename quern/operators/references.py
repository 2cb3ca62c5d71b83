"""References to records that do not exist.

The state of the operator is a ledger with one row per key: how often the key is referred to and
how often it exists. Every change of a source table is a signed delta on one of the two counts,
so the ledger of a day is the ledger of the day before plus the sums of the day's deltas; nothing
is recounted. The keys with positive references and zero existence are the orphan report.

Defined results: a null or zero reference refers to nothing; a null key exists nowhere; repeated
rows count as often as they occur; an empty table gives an empty ledger. Columns other than the
named ones are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def existence_deltas(df: DataFrame, key: str, sign: Column | int = 1) -> DataFrame:
    """(ref_key, refs, present): ``sign`` per row of ``df``, on the key's existence."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    return df.select(F.col(key).cast("long").alias("ref_key"), F.lit(0).cast("long").alias("refs"), s.cast("long").alias("present")).where(F.col("ref_key").isNotNull())


def reference_deltas(df: DataFrame, parent: str, sign: Column | int = 1) -> DataFrame:
    """(ref_key, refs, present): ``sign`` per row of ``df``, on the references to its parent."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    refs = df.select(F.col(parent).cast("long").alias("ref_key"), s.cast("long").alias("refs"), F.lit(0).cast("long").alias("present"))
    return refs.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != 0))


def apply_deltas(ledger: DataFrame | None, deltas: Sequence[DataFrame]) -> DataFrame:
    """The ledger after the deltas; keys whose counts are both zero leave it.

    One aggregation with map-side combine: a key that a third of all rows refer to arrives as one
    row per input partition.
    """
    parts = [*([ledger.select("ref_key", "refs", "present")] if ledger is not None else []), *deltas]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.groupBy("ref_key").agg(F.sum("refs").alias("refs"), F.sum("present").alias("present"))
    return sums.where((F.col("refs") != 0) | (F.col("present") != 0))


def change_deltas(rows: DataFrame, latest: DataFrame, key: str = "id", parent: str = "parent") -> list[DataFrame]:
    """Deltas of a batch of changes against the stored ``rows`` of (key, parent).

    ``latest``: (key, parent, deleted), one row per changed key. A deleted key takes its rows and
    their references away, a new parent moves the reference of every row of its key, a key that is
    not stored comes in with one row. Nothing else of ``rows`` is counted again.
    """
    new = latest.where(F.col(key).isNotNull()).select(F.col(key).alias("q_key"), F.col(parent).alias("q_parent"), F.coalesce("deleted", F.lit(False)).alias("q_gone"))
    hit = rows.join(new, F.col(key) == F.col("q_key"))
    gone = hit.where("q_gone")
    moved = hit.where(~F.col("q_gone") & ~F.col(parent).eqNullSafe(F.col("q_parent")))
    come = new.where(~F.col("q_gone")).join(rows.select(F.col(key).alias("q_have")).distinct(), F.col("q_key") == F.col("q_have"), "left_anti")
    return [
        existence_deltas(gone, key, -1), reference_deltas(gone, parent, -1),
        reference_deltas(moved, parent, -1), reference_deltas(moved, "q_parent", 1),
        existence_deltas(come, "q_key", 1), reference_deltas(come, "q_parent", 1),
    ]


def orphan_keys(ledger: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return ledger.where((F.col("refs") > 0) & (F.col("present") <= 0)).select("ref_key")


def orphan_records(ledger: DataFrame, sources: dict[str, DataFrame], key: str = "id", parent: str = "parent", keep: Sequence[str] = ()) -> DataFrame:
    """(src, key, *keep) of the records whose reference is in the orphan report, one row per distinct one.

    The join's small side is the report; adaptive execution broadcasts it below the session's
    threshold and splits a skewed parent's partition above it. The distinct runs on what is left.
    """
    found = None
    for name, df in sources.items():
        rows = df.select(F.lit(name).alias("src"), F.col(key).alias("id"), F.col(parent).cast("long").alias("ref_key"), *keep)
        rows = rows.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != 0))
        found = rows if found is None else found.unionByName(rows)
    return found.join(orphan_keys(ledger), "ref_key", "left_semi").select("src", "id", *keep).distinct()
