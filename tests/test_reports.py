"""Dates, charts, chains of extractors, summaries' counts and contract folders on small cases, and what else no query reaches."""

from __future__ import annotations

import json
import os
from datetime import UTC, date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedlens.functions import decode
from feedlens.operators import articles, ontology, quality, reports, tagging
from feedlens.sources import html, listings


def plain_day(row: dict) -> date | None:
    """The definition: the first field with a time, or with a text of one of three forms in its first 19 characters."""
    for name in decode.DATE_FIELDS:
        value = row.get(name)
        if isinstance(value, datetime):
            return value.date()
        for form in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"):
            try:
                return datetime.strptime((value or "")[:19], form).date()
            except ValueError:
                continue
    return None


TEXTS = [
    None, "", "2024-01-05", "2024-1-5", "2024-02-30", "2024-01-05T10:11:12", "2024-01-05 10:11:12.5+09:00", "2024-01-05T25:00:00", "2024-01-05T10:11",
    "05.01.2024", "2024-01-05T", " 2024-01-05", "2023-02-29T00:00:00", "2024-02-29 23:59:60", "20240105",
]


def test_days_of_articles(spark):
    rows = [{"i": i, "published_at": a, "published": b, "date": "2001-02-03"} for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(rows, "i long, published_at string, published string, date string")
    found = {r["i"]: r["day"] for r in df.select("i", decode.article_day(df).alias("day")).collect()}
    assert found == {r["i"]: plain_day(r) for r in rows}
    assert spark.range(1).select(decode.article_day(spark.range(1)).alias("d")).first()["d"] is None


def test_utc_without_a_zone(spark):
    told = ["2024-01-05T10:11:12.25+09:00", "2024-01-05T10:11:12", "1969-12-31T23:59:59.5Z", "x", None]
    df = spark.createDataFrame(list(enumerate(told)), "i int, t string").select("i", decode.utc_ntz(F.col("t")).alias("u"))
    found = [r["u"] for r in df.orderBy("i").collect()]
    assert found[:2] == [datetime(2024, 1, 5, 1, 11, 12, 250000), datetime(2024, 1, 5, 10, 11, 12)]
    assert found[2:] == [datetime(1969, 12, 31, 23, 59, 59, 500000), None, None]


def test_chart_ties_stand_by_first_place_and_empty_charts_are_none(spark):
    rows = [(1, "2024-01-30", "x Zeta alpha", {}), (2, "2024-01-30", None, {"beta": ["b"], "q": ["q"]}), (3, None, "lost", {}), (4, "2023-01-01", None, {"beta": ["b"]})]
    df = spark.createDataFrame(rows, "doc_id long, d string, title string, matched_entities map<string,array<string>>")
    days = tagging.entity_or_word_days(df, F.to_date("d"), "doc_id")
    chart = tagging.entity_matrix(days, F.lit("2024-01-31").cast("date"), width=2, top=3).orderBy("position", "label").collect()
    assert [(r["position"], r["entity"], r["label"], r["n"]) for r in chart] == [
        (1, "beta", "01-30", 1), (1, "beta", "01-31", 0), (2, "Zeta", "01-30", 1), (2, "Zeta", "01-31", 0), (3, "alpha", "01-30", 1), (3, "alpha", "01-31", 0)
    ]
    assert tagging.entity_matrix(days, F.lit("2022-01-31").cast("date")).collect() == []
    assert tagging.entity_matrix(days.where("false"), F.lit("2024-01-31").cast("date")).collect() == []


def test_quality_of_no_rows(spark):
    df = spark.createDataFrame([], "link string, t string, lang string, at timestamp")
    found = quality.quality_report(df, {"t": "t = ''"}, ["t"], "lang", ["en"], "link", "at", F.current_timestamp()).collect()
    told = {(r["check"], r["key"], r["metric"]): r["value"] for r in found}
    assert told[("total", None, "n")] == 0 and told[("missing", "t", "ratio")] is None and told[("length", "t", "avg")] is None
    assert {c for c, _, _ in told} == {"total", "missing", "length", "date"}


def test_strict_chain_fails_and_empty_text_is_a_result(spark):
    df = spark.createDataFrame([("u", "", None), ("v", None, None)], "url string, a string, b string")
    found = df.select(html.extracted(F.col("url"), {"a": F.col("a"), "b": F.col("b")}).alias("x")).collect()
    assert [tuple(r["x"]) for r in found] == [("", "a", [], None), (None, None, ["a>b"], "All extractors failed for v. Tried: ['a', 'b']")]
    with pytest.raises(PySparkException, match="All extractors failed for v"):
        df.select(html.extracted(F.col("url"), {"a": F.col("a")}, strict=True).alias("x")).collect()


def test_summaries_of_pages(spark):
    pages = ["<p>caf&eacute;</p>\n\n<b>x</b> ", "charset=euc-kr \xc7", "<meta charset='EUC-KR'> \xc7\xd1 &amp;", "", None, "a" * 5000]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", html.html_summary(F.col("h")).alias("s"))
    assert [r["s"] for r in df.orderBy("i").collect()] == ["café x", "charset=euc-kr Ç", "<meta charset='EUC-KR'> 한 &", "", None, "a" * 4000]


def test_addresses_of_listings(spark):
    df = spark.createDataFrame([("http://reddit.com/r/a.rss/",), ("https://old.reddit.com/r/a",)], "u string")
    assert [r[0] for r in df.select(listings.listing_url(F.col("u"), "hot", 500)).collect()] == [
        "http://www.reddit.com/r/a/hot.json?limit=100&raw_json=1",
        "https://www.reddit.com/r/a/hot.json?limit=100&raw_json=1",
    ]


def test_given_counts_stand(spark):
    df = spark.createDataFrame([(1, "a", {"x": ["k"]})], "doc_id long, source string, matched_entities map<string,array<string>>")
    found = {(r["section"], r["name"]): r["count"] for r in reports.summary_rows(df, "doc_id", given={"article_count": 7}).collect()}
    assert found == {("article_count", ""): 7, ("source_count", ""): 1, ("matched_count", ""): 1, ("sources", "a"): 1, ("top_entities", "x"): 1}


def test_summary_is_written_by_section(spark, tmp_path):
    df = spark.createDataFrame([("sources", "a", 2), ("top_entities", "x", 1)], "section string, name string, count long")
    reports.write_summary(df, f"{tmp_path}/s", "news", F.lit("2024-01-31 01:02:03").cast("timestamp_ntz"))
    back = spark.read.json(f"{tmp_path}/s").where("section = 'sources'").collect()
    assert [(r["category"], r["generated_at"], r["name"], r["count"]) for r in back] == [("news", "2024-01-31T01:02:03", "a", 2)]


def test_sections_without_body_are_left_out(spark):
    form = "id string, title string, body_html string, panel_title string, subtitle string, nav_label string, aria_label string, badges array<string>"
    df = spark.createDataFrame([(" a ", "T", "<p>", " ", None, "N", None, [" b ", ""]), ("b", "", "x", None, None, None, None, None), (None, "T", "x", None, None, None, None, None)], form)
    found = reports.extra_sections(df).collect()
    assert [r.asDict() for r in found] == [
        {"id": "a", "title": "T", "body_html": "<p>", "panel_title": "T", "subtitle": "", "nav_label": "N", "aria_label": "T", "badges": ["b"]}
    ]


def test_runs_and_snapshots(spark, tmp_path):
    at = datetime(2024, 1, 31, 1, 2, 3, tzinfo=UTC)
    assert articles.make_run_id(at, "feed", "17") == "feed-gh-17"
    assert articles.make_run_id(at, "feed").startswith("feed-20240131T010203Z-") and articles.make_run_id(at, "feed") != articles.make_run_id(at, "feed")
    df = spark.createDataFrame([("l", 1)], "link string, n int")
    for _ in range(2):
        path = articles.write_snapshot(df, str(tmp_path), date(2024, 1, 31))
    assert path.endswith("/snapshots/2024-01-31") and [tuple(r) for r in spark.read.parquet(path).collect()] == [("l", 1)]
    files = spark.createDataFrame([("raw", "2024-01-01")], "kind string, name string")
    row = articles.retention_policy(files, F.lit("2024-01-31").cast("date"), 7, 7, run_id="r", version="1.0").first()
    assert row.asDict() == {"raw_removed": 1, "report_removed": 0, "snapshots_removed": 0, "run_id": "r", "collector_version": "1.0"}


def test_merge_of_an_empty_batch_changes_nothing(spark):
    stored = spark.createDataFrame([("l", "t", "s")], "link string, title string, source string")
    empty = spark.createDataFrame([], "link string, title string, source string, seq long")
    assert [tuple(r) for r in articles.upsert(stored, empty).select("link", "title", "source").collect()] == [("l", "t", "s")]


CONTRACT = {
    "repo": "r", "category": " c ", "ontology_version": "2", "event_model_mappings": {"b": "m2", "a": "m1", "c": "m1"}, "evidence_policy_ids": ["p2", "p1"],
    "event_model_field_specs": {"a": {"required_fields": [" x ", "", 3], "optional_fields": "no list", "field_enums": {" f ": ["u", " "], "": ["v"], "g": "w"}}, "b": 1},
}


def test_contracts_are_found_by_folder(tmp_path, monkeypatch):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    held = tmp_path / "runtime_contracts"
    assert ontology.find_contract("news", [None, " "], [str(deep)], ("no-such-folder-name",)) is None
    held.mkdir()
    (held / "news.json").write_text(json.dumps(CONTRACT))
    (held / "bad.json").write_text("[1")
    (held / "list.json").write_text("[1]")
    assert ontology.contract_dir([], [str(deep / "file.py")]) == os.path.realpath(held)
    assert ontology.find_contract("news", [], [str(deep)]) == CONTRACT
    assert [ontology.find_contract(n, [], [str(deep)]) for n in ("bad", "list", "none")] == [None, None, None]
    monkeypatch.setenv("HOME", str(tmp_path))
    assert ontology.contract_dir([None, f"{tmp_path}/gone", "~/x"], [str(deep)]) == os.path.realpath(tmp_path / "x")


def test_specs_and_metadata_of_contracts():
    assert ontology.field_spec(CONTRACT, " a ") == {"required_fields": ["x", "3"], "optional_fields": [], "field_enums": {"f": ["u"]}}
    assert ontology.field_spec(CONTRACT, "b") is None and ontology.field_spec(None, "a") is None and ontology.field_spec({}, "a") is None
    told = ontology.summary_metadata(CONTRACT, "news")
    assert told == {
        "repo": "news", "category": "c", "ontology_version": "2", "event_model_ids": ["m1", "m2"],
        "event_model_mappings": {"b": "m2", "a": "m1", "c": "m1"}, "evidence_policy_ids": ["p2", "p1"],
    }
    assert ontology.summary_metadata(None, "news") is None
