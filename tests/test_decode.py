"""Stored values and rules against plain Python."""

from __future__ import annotations

import json
import unicodedata
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from feedlens.functions import decode, text
from feedlens.operators import clustering, ontology, quality, tagging
from feedlens.sources import html


def values(spark, column, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    return [r["v"] for r in rows.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_json_value_by_value(spark):
    cells = [None, "", "{bad", "[1]", "3", "{}", '{"a": ["x", 2, null, true, false], "b": "no list", "c": []}', '{"\uc778\uacf5": ["\uc9c0\ub2a5"]}']
    want = []
    for c in cells:
        try:
            found = json.loads(c) if c else {}
        except ValueError:
            found = {}
        found = found if isinstance(found, dict) else {}
        want.append({k: [str(x) for x in v] for k, v in found.items() if isinstance(v, list)})
    assert values(spark, decode.decode_entities, cells) == want
    assert values(spark, decode.decode_ontology, [None, "{bad", "[]", '{" ": 1, "a": "x", "n": 2}']) == [{}, {}, {}, {"a": "x", "n": "2"}]


def test_dates(spark):
    cells = [None, "", "2024", "2024-01-02", "2024-01-02T03:04:05", "2024-01-02 03:04", "2024-01-02T03", "2024-01-02T03:04:05.25+09:00", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+0530", "2024-13-02", "soon"]
    for cell, got in zip(cells, values(spark, lambda c: F.unix_micros(decode.iso_datetime(c)), cells), strict=True):
        try:
            when = datetime.fromisoformat(cell) if cell != "2024" else None
        except (ValueError, TypeError):
            when = None
        want = None if when is None else when.replace(tzinfo=when.tzinfo or UTC).timestamp() * 1e6
        assert got == want, cell
    mails = ["Tue, 02 Jan 2024 03:04:05 +0900", "2 Jan 2024 03:04:05 GMT", "Tue, 2 Jan 2024 03:04:05 -0000", "Tue, 2 Jan 2024 03:04 +0100", "2 Jan 2024 03:04:05"]
    got = values(spark, lambda c: F.unix_seconds(decode.mail_datetime(c)), mails)
    assert got == [int(x.replace(tzinfo=x.tzinfo or UTC).timestamp()) for x in map(parsedate_to_datetime, mails)]
    assert values(spark, decode.mail_datetime, ["never", "", None]) == [None] * 3


def test_rules_of_one_name(spark):
    rules = [("lang", ["python"]), ("other", ["java"]), ("lang", ["java"])]
    found = lambda t: values(spark, lambda c: tagging.matched_entities(c, F.lit(""), rules), [t])[0]
    assert found("python") == {"lang": ["python"]}
    assert found("python java") == {"lang": ["java"], "other": ["java"]}
    assert found("none") == {}


def test_blanks_placeholders_and_composition(spark):
    assert values(spark, html.is_placeholder, ["#view", "#", " ", None, "javascript:;", "javascript:", "#x"]) == [True, True, True, True, True, False, False]
    cells = ["\uff21\uff22 e\u0301y", "ABC de"]
    assert values(spark, text.title_tokens, cells) == [unicodedata.normalize("NFKC", cells[0]).lower().split(), ["abc", "de"]]
    rows = spark.createDataFrame([("\t\u3000", "http://a.org/x", "s", "a", "b")], "title string, link string, summary string, source string, category string")
    assert rows.select(quality.validation_errors().alias("e")).first()["e"] == ["title is empty"]


def test_gate(spark):
    contract = {"event_model_mappings": {"release": "em.release"}, "source_role_mappings": {}}
    rows = spark.createDataFrame([("u1", "s", {"event_model_id": "em.release"}), ("u2", "s", {"event_model_id": "em.other"}), ("u3", "s", None)], "link string, source string, ontology map<string,string>")
    nothing = F.create_map().cast("map<string,string>")
    found = ontology.violations(rows, nothing, contract, "repo").collect()
    assert [(r["repo"], r["link"], r["source"], len(r["errors"])) for r in found] == [("repo", "u2", "s", 1)]
    assert ontology.gated(rows, nothing, contract).count() == ontology.gated(rows, nothing, None, strict=True).count() == 3
    try:
        ontology.gated(rows, nothing, contract, strict=True).collect()
    except Exception as e:
        assert "ontology validation failed for u2" in str(e)
    else:
        raise AssertionError("a strict gate let a violation pass")


def test_clusters_of_a_window_are_written_back(spark):
    rows = [("a1", "AI safety board report", "tech", "2024-01-30 00:00:00", "old"), ("a2", "AI safety board report", "tech", "2024-01-29 00:00:00", None), ("a3", "AI safety board report", "tech", "2023-01-01 00:00:00", "old"), ("b1", "Mortgage rates rise", "tech", "2024-01-30 00:00:00", None), ("c1", "Mortgage rates rise", "game", "2024-01-30 00:00:00", None)]
    df = spark.createDataFrame(rows, "link string, title string, category string, at string, cluster_id string").withColumn("event_ts", F.col("at").cast("timestamp_ntz"))
    found = {r["link"]: r["cluster_id"] for r in clustering.with_clusters(df, F.lit("2024-01-31").cast("timestamp_ntz"), category="tech").collect()}
    assert found["a1"] == found["a2"] != found["b1"] and found["a3"] == "old" and found["c1"] is None and len(found["a1"]) == 12
