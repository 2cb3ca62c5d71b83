"""SQL functions, look-up tables, caches, codecs, places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import cache, kernels, sql, text
from quern.functions import vector as V
from quern.operators.percentile import ordered_places


def test_sql_functions(spark, rows):
    sql.register(spark)
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [4.0, 6.0]), (3, None)], "id long, v array<float>").createOrReplaceTempView("vecs")
    got = spark.sql("SELECT a.id, vec_l2_squared(a.v, b.v) AS d, vec_dot(a.v, b.v) AS p, vec_norm(a.v) AS n FROM vecs a JOIN vecs b ON b.id = 2")
    assert rows(got) == [(1, 25.0, 16.0, pytest.approx(5**0.5)), (2, 0.0, 52.0, pytest.approx(52**0.5)), (3, None, None, None)]
    got = spark.sql("SELECT rank, vec_id, d2 FROM (SELECT collect_list(id) AS ids, collect_list(v) AS vs FROM vecs WHERE v IS NOT NULL) c, LATERAL vec_nearest_of(array(1.0D, 2.0D), c.ids, c.vs, 5)")
    assert rows(got) == [(1, 1, 0.0), (2, 2, 25.0)]


def test_tables_of_codes_equal_products():
    x = kernels.rotate(np.random.default_rng(3).normal(size=(40, 64)))
    code, sq, l1 = kernels.encode_bits(x, x.mean(axis=0))
    l1[4] = 0
    q = x[:1] - x.mean(axis=0)
    assert np.allclose(kernels.estimate_table(q[0], kernels.pack_bits(code), sq, l1), kernels.estimate_bits(q, code, sq, l1)[0], rtol=1e-9)


def test_cache_expires_and_is_bounded():
    now = [0.0]
    c = cache.ExpiringCache(2, 10, lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.put("c", 3)
    assert c.get("a") is None and c.get("b") == 2 and len(c) == 2
    now[0] = 10
    assert c.get("b") is None and len(c) == 1


def test_ids_dates_and_folding(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (2**40 + 7,), (None,)], "id long")
    assert all(a == b for a, b in rows(df.select("id", text.bytes_to_id(text.id_to_bytes(F.col("id"))))))
    assert df.select(text.bytes_to_id(F.lit(b"123"))).first()[0] is None
    d = spark.createDataFrame([("9 Oct 2006",), ("",), ("x",), (None,)], "s string")
    assert [str(r[0]) for r in d.select(text.parse_short_date(F.col("s"))).collect()] == ["2006-10-09", "None", "None", "None"]
    assert spark.createDataFrame([("Éa Ñ",)], "s string").select(text.fold(F.col("s"))).first()[0] == "ea n"
    assert len(text.MARKED) == len(text.UNMARKED)


def test_places_number_all_rows(spark, rows):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert rows(ordered_places(df, "k")) == [(i, i) for i in range(1000)]
    assert ordered_places(df.limit(0), "k").count() == 0


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0],), ([0.0, 0.0, 0.0],), (None,)], "v array<float>")
    got = df.select(V.normalize(F.col("v")), V.truncate(F.col("v"), 1), V.pattern(F.lit(3), 3)).collect()
    assert got[0][0] == [pytest.approx(0.6), pytest.approx(0.8), 0.0] and got[0][1] == [1.0] and got[1][0] == [0.0, 0.0, 0.0] and got[2][0] is None and got[0][2] == [21.0, 34.0, 47.0]
    level, a = V.scalar_levels(F.col("v"), 2)
    assert [tuple(r) for r in df.limit(2).select(level, a).collect()] == [([3, 3, 2], 4.0), ([2, 2, 2], 1e-9)]
