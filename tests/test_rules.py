"""Tagging by a table of rules against the compiled form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedlens.operators import tagging

WORDS = ["python", "ai", "c++", "보안", "보안 위협", "a.b", "ſun", "sun", "Kelvin", "½ai", "über", "x_y", "İzmir", "izmir", "++", "+", "한", "go lang", ".net", "net.", "ıce", "ice"]
RULES = "rule long, name string, keywords array<string>"


def texts(n: int) -> list[tuple]:
    pick = random.Random(1)
    rows = [(i, " ".join(pick.choice(WORDS + [w.upper() for w in WORDS]) for _ in range(pick.randrange(5))), pick.choice(["", " ", ", ", "-", "x"]).join(pick.choice(WORDS) for _ in range(pick.randrange(8)))) for i in range(n)]
    return rows + [(9_001, None, None), (9_002, "python", None), (9_003, "", "PYTHON python. Ｐ")]


def rules(n: int) -> list[tuple[str, list[str]]]:
    pick = random.Random(2)
    return [(f"n{pick.randrange(n)}", [pick.choice([*WORDS, "", f"none{i}"]) for _ in range(3)]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 100])
def test_table_gives_what_the_compiled_form_gives(spark, n):
    own = rules(n)
    articles = spark.createDataFrame(texts(150), "link long, title string, summary string")
    table = spark.createDataFrame([(i, name, words) for i, (name, words) in enumerate(own)], RULES)
    got = {r["link"]: r["matched_entities"] for r in tagging.tag_by_table(articles, table).collect()}
    want = articles.select("link", tagging.matched_entities(F.col("title"), F.col("summary"), own).alias("m"))
    assert got == {r["link"]: r["m"] for r in want.collect()}
    assert [list(got[i]) for i in range(150)] == [list(r["m"]) for r in want.orderBy("link").collect()[:150]]


def test_ten_thousand_rules(spark):
    own = [(i, f"n{i}", [f"word{i}", f"낱말{i}끝"]) for i in range(10_000)]
    articles = spark.createDataFrame([(i, f"word{i * 7} and Word{i}", f"x낱말{i * 3}끝") for i in range(500)], "link long, title string, summary string")
    found = tagging.tag_by_table(articles, spark.createDataFrame(own, RULES)).where("link = 11").first()["matched_entities"]
    assert found == {"n11": ["word11"], "n33": ["낱말33끝"], "n77": ["word77"]}


def test_no_rules(spark):
    articles = spark.createDataFrame([(1, "a", "b")], "link long, title string, summary string")
    assert tagging.tag_by_table(articles, spark.createDataFrame([], RULES)).first()["matched_entities"] == {}
