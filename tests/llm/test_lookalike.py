"""The exploded form of texts against the brute force, characters of other scripts, classes and hot classes."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import lookalike

PIECES = ["a", "é", "e\u0301\u0323", "ﬁ", "Ａ", "\u200d", "👩\u200d🔬", "❤\ufe0f\u200d🔥", "ﾊﾞ", "\u1112\u1161\u11ab", "한", "Я", "сω", "ⲟⵔ", "𝖺𝗕", " ", "\u3000", "日本", "\n", "x1", "½", "\U000e0041"]


def brute(spark, texts):
    return lookalike.canonical_texts(texts, {**lookalike._ALIKE, **lookalike.confusable_letters(spark)})


def test_columns_equal_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 3)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "plain", "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("q_pos", F.lit(1))
    got = dict(map(tuple, lookalike.canonical_column(df, "doc_id").collect()))
    want = dict(enumerate(brute(spark, texts)))
    assert got == want
    again = spark.createDataFrame(list(got.items()), "doc_id long, text string")
    assert dict(map(tuple, lookalike.canonical_column(again, "doc_id").collect())) == want


@pytest.mark.parametrize("pair", ["ⲞO", "ⲣp", "ⵔO", "ᑭP", "ᗅA", "ꮃw", "ꮯc", "𝖺a", "𝙰A", "ニ二", "カ力", "𐊠A", "ꓲI"])
def test_letters_of_other_scripts(spark, pair):
    one, two = brute(spark, [f"x{pair[0]}é", f"x{pair[1]}é"])
    assert one == two


@pytest.mark.parametrize("pair", ["σο", "пн", "ᗞᗪ", "0O", "1l", "Il", "𝐚a", "ΣE", "ßb", "ıi"])
def test_letters_that_stay_apart(spark, pair):
    one, two = brute(spark, [f"x{pair[0]}é", f"x{pair[1]}é"])
    assert one != two


def test_classes_and_hot_classes(spark, rows, monkeypatch):
    monkeypatch.setattr(lookalike, "CLASS_ROWS", 4)
    data = [(i, "file" if i % 3 else "ﬁle") for i in range(30)] + [(100, "other"), (101, "other"), (102, None), (103, " "), (None, "file"), (0, "ﬁle")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    pairs = rows(lookalike.same_to_a_reader(df, "doc_id"))
    want = sorted((a, b) for a in range(30) for b in range(a + 1, 30) if (a % 3 == 0) != (b % 3 == 0))
    assert pairs == want
    got = {r[0]: r[1:] for r in rows(lookalike.classes(df, "doc_id"))}
    assert got == {**{i: (0, 10 if i % 3 else 20) for i in range(30)}, 100: (100, 0), 101: (100, 0)}
    assert lookalike.classes(df.limit(0), "doc_id").count() == 0
