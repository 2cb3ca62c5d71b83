"""The vector functions for SQL users: scalar SQL functions, and a table function for search."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Each is one expression, so Catalyst inlines it.
SCALARS = {
    "vec_l2_squared": "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)",
    "vec_dot": "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)",
    "vec_norm": "(a ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt(aggregate(transform(a, x -> double(x) * double(x)), 0D, (s, x) -> s + x))",
}


@udtf(returnType="rank int, vec_id bigint, d2 double")
class NearestOf:
    """The k nearest of a list of candidates: for SQL over candidate lists that fit one row."""

    def eval(self, q: list, ids: list, vectors: list, k: int):
        if q is None or ids is None or vectors is None:
            return
        found = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(q, v)), i) for i, v in zip(ids, vectors) if v is not None and len(v) == len(q))
        for n, (d2, i) in enumerate(found[: max(0, k)]):
            yield n + 1, i, d2


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("vec_nearest_of", NearestOf)
