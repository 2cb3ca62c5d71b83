"""Exact percentiles per group, without gathering a group.

Values are counted per group and order-preserving bucket; the running sums of the buckets say in
which bucket a rank lies, and only the distinct values of that bucket are ranked. Two rules:
'floor' takes the value at index floor(p * (n - 1)), 'linear' interpolates between the two values
around p * (n - 1).

Defined results: null and NaN take no part; groups without values give no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import Scratch


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float], rule: str = "linear") -> DataFrame:
    """(*keys, n, *ps): ``ps`` maps column names to fractions from 0 to 1."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("q_v"))
    size = F.floor(F.ln(F.abs("q_v") + 1) * 256)
    counts = rows.groupBy(*keys, "q_v").agg(F.count("*").alias("q_n")).withColumn("q_b", F.when(F.col("q_v") < 0, -size).otherwise(size))
    buckets = counts.groupBy(*keys, "q_b").agg(F.sum("q_n").alias("q_m"))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("q_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*keys, "q_b", "q_m", F.coalesce(F.sum("q_m").over(before), F.lit(0)).alias("q_start"), F.sum("q_m").over(Window.partitionBy(*group)).alias("n"))
    wanted = {}
    for name, p in ps.items():
        at = F.lit(min(max(p, 0.0), 1.0)) * (F.col("n") - 1)
        wanted[name] = (F.floor(at), F.ceil(at) if rule == "linear" else F.floor(at), at)
    hit = F.lit(False)
    for low, high, _ in wanted.values():
        for r in (low, high):
            hit = hit | ((r >= F.col("q_start")) & (r < F.col("q_start") + F.col("q_m")))
    buckets = buckets.where(hit)
    on = None
    for k in [*keys, "q_b"]:
        one = F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = one if on is None else on & one
    near = counts.alias("c").join(buckets.alias("b"), on).select(*[F.col(f"b.{k}").alias(k) for k in keys], "b.q_b", "q_start", "n", "q_v", "q_n")
    inside = Window.partitionBy(*group, "q_b").orderBy("q_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("q_first", F.col("q_start") + F.coalesce(F.sum("q_n").over(inside), F.lit(0)))
    has = lambda r: (r >= F.col("q_first")) & (r < F.col("q_first") + F.col("q_n"))
    aggs = []
    for name, (low, high, at) in wanted.items():
        aggs += [F.max(F.when(has(low), F.col("q_v"))).alias(f"q_lo_{name}"), F.max(F.when(has(high), F.col("q_v"))).alias(f"q_hi_{name}"), F.max(at - low).alias(f"q_w_{name}")]
    out = near.groupBy(*keys, "n").agg(*aggs)
    return out.select(*keys, "n", *[(F.col(f"q_lo_{m}") + (F.col(f"q_hi_{m}") - F.col(f"q_lo_{m}")) * F.col(f"q_w_{m}")).alias(m) if rule == "linear" else F.col(f"q_lo_{m}").alias(m) for m in ps])


def ordered_places(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(key, place): the place of every row in the order of ``key``, from 0, without one task for all rows.

    Rows are range-partitioned; the counts of the ranges, one per partition, give each range its
    first place. Equal keys are numbered in any order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "places")
    ranged = scratch.save(df.select(key).repartitionByRange(n, key).withColumn("q_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("q_p").agg(F.count("*").alias("q_n"))
    before = Window.orderBy("q_p").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("q_p").alias("q_fp"), F.coalesce(F.sum("q_n").over(before), F.lit(0)).alias("q_first"))
    inside = F.row_number().over(Window.partitionBy("q_p").orderBy(key))
    rows = ranged.withColumn("q_in", inside - 1).join(F.broadcast(first), F.col("q_p") == F.col("q_fp"))
    return rows.select(key, (F.col("q_first") + F.col("q_in")).alias("place"))
