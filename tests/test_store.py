"""Versioned tables, the stored index, the raw log, long chains and payload overrides."""

from __future__ import annotations

import os
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from feedlens.operators import articles as store
from feedlens.operators import clustering, index, ontology, search
from feedlens.plans.graph import components
from feedlens.plans.versions import Versions
from feedlens.sources import html
from feedlens.streaming import rawlog


def files(path: str) -> set[str]:
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_failing_batch_leaves_the_old_version(spark, tmp_path):
    table = Versions(str(tmp_path / "t"), "link", 8)
    cols = "link string, title string, source string, seq int"
    assert table.read(spark) is None and table.version(spark) is None
    store.merge_stored(table, spark.createDataFrame([(f"l{i}", "old", "s", i) for i in range(50)], cols))
    before = files(f"{tmp_path}/t/data")
    with pytest.raises(Exception, match="article without a link"):
        store.merge_stored(table, spark.createDataFrame([("l1", "new", "s", 1), (None, "x", "s", 2)], cols))
    assert table.version(spark) == 1 and table.read(spark).where("title = 'new'").count() == 0
    assert before <= files(f"{tmp_path}/t/data")
    assert store.merge_stored(table, spark.createDataFrame([], cols)) is None


def test_a_change_rewrites_its_buckets_only_and_readers_keep_their_version(spark, tmp_path):
    table = Versions(str(tmp_path / "t"), "link", 16)
    cols = "link string, title string, source string, seq int"
    store.merge_stored(table, spark.createDataFrame([(f"l{i}", "old", "s", i) for i in range(200)], cols))
    old, reader = table.folders(spark), table.read(spark)
    store.merge_stored(table, spark.createDataFrame([("l3", "new", "t", 1), ("l3", "newer", "u", 2)], cols))
    new = table.folders(spark)
    assert sum(old[b] != new[b] for b in old) == 1
    assert reader.where("title = 'old'").count() == 200
    assert [tuple(r) for r in table.read(spark).where("title <> 'old'").select("link", "title", "source").collect()] == [("l3", "newer", "s")]
    assert table.read(spark).count() == 200 and table.read(spark, version=1).where("title = 'old'").count() == 200


def test_backfill_of_a_stored_table(spark, tmp_path):
    table = Versions(str(tmp_path / "t"), "doc_id", 16)
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.create_map(F.lit("event_model_id"), F.lit("a")).alias("ontology"), F.lit("x").alias("title"))
    table.replace(rows)
    newer = rows.withColumn("ontology", F.when(F.col("doc_id") == 7, F.create_map(F.lit("event_model_id"), F.lit("b"))).otherwise(F.col("ontology")))
    changed, counters = ontology.backfill(table.read(spark), newer, "doc_id")
    assert counters.first()["updated"] == 1
    before = table.folders(spark)
    ontology.stored_backfill(table, changed.union(changed.withColumn("doc_id", F.lit(1_000).cast("long"))))
    after = table.folders(spark)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert [r["doc_id"] for r in table.read(spark).where("ontology['event_model_id'] = 'b'").collect()] == [7] and table.read(spark).count() == 100
    assert ontology.stored_backfill(table, changed.where("false")) is None


def _texts(n: int, seed: int = 3) -> list[tuple[int, str, str]]:
    pick = random.Random(seed)
    words = ["alpha", "alphabet", "beta", "gamma", "delta", "Beta", "zürich", "a", "ab", "x9"]
    return [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(4))), ", ".join(pick.choice(words) for _ in range(pick.randrange(12)))) for i in range(n)]


SEARCHES = [
    search.Term("alpha"),
    search.Term("alph", prefix=True),
    search.Term("a", prefix=True),
    search.Term("beta gamma"),
    search.Term("beta alph", prefix=True),
    search.Term("delta", column="title"),
    search.All((search.Term("beta"), search.Any((search.Term("gamma delta"), search.Term("zürich"))))),
    search.But(search.Term("beta"), search.Term("gamma")),
    search.All((search.Term("beta"), search.Term("nowhere"))),
    search.Any((search.Term("beta beta"), search.Term("nowhere"))),
]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """An index in three segments, in which later ones replace documents of earlier ones."""
    found = index.Index(str(tmp_path_factory.mktemp("index")), "doc_id")
    cols = "doc_id long, title string, body string"
    rows = _texts(120)
    found.add(spark.createDataFrame([(i, "alpha old", "beta gamma old") for i in range(60)], cols))
    found.add(spark.createDataFrame(rows[:80], cols))
    found.add(spark.createDataFrame([*rows[80:], (5, "delta", "alpha")], cols))
    rows[5] = (5, "delta", "alpha")
    return found, spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("match", SEARCHES, ids=str)
def test_index_finds_what_a_scan_finds(spark, held, match):
    found, docs = held
    want = [(r[0], round(r[1], 9)) for r in search.search(docs, "doc_id", match, 500).collect()]
    got = [(r[0], round(r[1], 9)) for r in index.search(found, spark, match, 500).collect()]
    assert got == want


def test_index_reads_the_folders_of_its_words_only(spark, held):
    found, _ = held
    plan = found.postings(spark, [search.Term("gamma")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket" in plan.split("PartitionFilters")[1] and "EqualTo(token,gamma)" in plan
    assert {r["token"] for r in found.postings(spark, [search.Term("alphabe", prefix=True)]).collect()} == {"alphabet"}


def test_empty_searches(spark, held, tmp_path):
    found, _ = held
    assert index.search(found, spark, search.Term("!!")).count() == 0
    assert index.search(found, spark, search.Term("beta"), 0).count() == 0
    assert index.search(index.Index(str(tmp_path / "none"), "doc_id"), spark, search.Term("beta")).count() == 0


def test_raw_log_batches_once(spark, tmp_path):
    path = str(tmp_path / "log")
    cols = "link string, source string, title string, logged_at timestamp_ntz"
    from datetime import datetime

    at, later = datetime(2024, 1, 5, 10), datetime(2024, 1, 6, 10)
    first = spark.createDataFrame([("a", "s/1", "t", at), ("a", "s/1", "again", at), ("b", "s\\2", "t", at)], cols)
    second = spark.createDataFrame([("a", "s/1", "t", at), ("c", "s/1", "t", at), ("a", "s/1", "t", later)], cols)
    for rows, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        rawlog.log_batch(rows, number, path, "run1")
    held = rawlog.logged(first, path)
    assert sorted((r["link"], r["source_file"], r["day"], r["batch"]) for r in held.collect()) == [
        ("a", "s_1", "2024-01-05", 0), ("a", "s_1", "2024-01-06", 1), ("b", "s_2", "2024-01-05", 0), ("c", "s_1", "2024-01-05", 1),
    ]
    rawlog.log_batch(first, 0, path, None)
    rawlog.log_batch(first, 0, path, None)
    assert rawlog.logged(first, path).where("run_id = 'none'").count() == 3


def test_raw_log_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"l{i}", "s", f"2024-01-0{1 + i % 3} 00:00:00") for i in range(30)], "link string, source string, at string")
    rows.select("link", "source", F.col("at").cast("timestamp_ntz").alias("logged_at")).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("link string, source string, logged_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for progress in ("p1", "p2"):
        # a lost checkpoint replays all batches
        rawlog.log_stream(stream, f"{tmp_path}/log", f"{tmp_path}/{progress}", "r").awaitTermination()
    assert spark.read.json(f"{tmp_path}/log").count() == 30


@pytest.mark.parametrize("small", [200_000, 10])
def test_leaders_of_a_chain(spark, small):
    """A chain whose links go up in key order, beside other components, however it is decided."""
    n = 150 if small > 10 else 24
    rows = [(f"k{i:04}", f"k{i + 1:04}") for i in range(n)] + [("m1", "m2"), ("m1", "m3"), ("m2", "m3"), ("m3", "m4")]
    got = {r["member"]: r["leader"] for r in clustering.leaders(spark.createDataFrame(rows, "a string, b string"), small).collect()}
    assert got == {f"k{i:04}": f"k{i - 1:04}" for i in range(1, n + 1, 2)} | {"m2": "m1", "m3": "m1"}


def test_leaders_without_pairs(spark):
    assert clustering.leaders(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_of_a_long_chain(spark):
    pick = random.Random(1)
    names = list(range(10_000))
    pick.shuffle(names)
    rows = list(zip(names[:-1], names[1:], strict=True))
    found = components(spark.createDataFrame(rows, "a long, b long").repartition(8))
    assert found.where("component <> 0").count() == 0 and found.count() == 9_999


CONTRACT = {
    "repo": "own",
    "event_model_mappings": {"release": "em.release", "other": "em.other"},
    "source_role_mappings": {"s1": "role.named"},
    "evidence_policy_ids": ["p1", "p2"],
    "event_model_field_specs": {"release": {"required_fields": ["headline", "kind"], "optional_fields": ["owner"], "field_enums": {"kind": ["a", "b"]}}},
}


def _payloads(spark, explicit=None, strict=False):
    articles = spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t3"), ("s4", None), (None, "t5")], "source string, title string")
    models = spark.createDataFrame([("s1", "release", None), (" s2", "release", None), ("s3", "other", None), ("s4", "release", None)], "name string, event_model string, role string")
    over = spark.createDataFrame([("s1", {"kind": "a", "unknown": "x"}), ("s2", {"kind": "zzz"}), ("s4", {"owner": None})], f"name string, overrides {ontology.OVERRIDES}")
    rows = ontology.annotate(articles, CONTRACT, models, repo="given")
    return {r["source"]: r for r in ontology.payloads(rows, CONTRACT, over, explicit, strict).collect()}


def test_payload_overrides_of_the_sources(spark):
    got = _payloads(spark)
    assert got["s1"]["event_model_payload"] == {"headline": "t1", "kind": "a"}
    assert got["s2"]["event_model_payload"] is None and tuple(got["s2"]["violation"]) == ("kind", "zzz", ["a", "b"])
    assert got["s3"]["event_model_payload"] is None and got["s3"]["violation"] is None
    assert got["s4"]["event_model_payload"] is None and got[None]["event_model_payload"] is None
    assert got["s1"]["ontology"]["repo"] == "given" and got["s1"]["ontology"]["source_role_id"] == "role.named"
    assert got["s1"]["evidence_policy_ids"] == ["p1", "p2"]


def test_explicit_overrides_come_before_the_sources(spark):
    empty = spark.createDataFrame([], f"source string, overrides {ontology.OVERRIDES}")
    assert _payloads(spark, empty)["s1"]["event_model_payload"] == {"headline": "t1"}
    given = spark.createDataFrame([("s2", {"headline": None, "kind": " b "})], f"source string, overrides {ontology.OVERRIDES}")
    got = _payloads(spark, given, strict=True)
    assert got["s2"]["event_model_payload"] == {"kind": "b"} and got["s1"]["event_model_payload"] == {"headline": "t1"}


def test_strict_payloads_fail_the_write(spark):
    with pytest.raises(Exception, match="value 'zzz' not allowed for kind"):
        _payloads(spark, strict=True)


BASES = ["http://a.org/b/c/d?q#f", "http://a.org", "https://a.org/", "http://a.org/b/c/", "http://a.org/b"]
REFERENCES = (
    "../d ./d d/../e a:b ../../..//g /x/./y/../z //h.org/p ?y #s g;x=1/../y http:g http://o.org/a/../b .. . ./ ../ / g?y/./x g#s/../x "
    "/.. /a//b a//b g/ ? ../../../g x/. x/.. é/ü"
).split() + ["", "d e", " s "]


@pytest.mark.parametrize("base", BASES)
def test_links_like_urljoin(spark, base):
    rows = spark.createDataFrame([(r,) for r in REFERENCES], "r string")
    got = {x["r"]: x["u"] for x in rows.select("r", html.join_url(F.col("r"), F.lit(base)).alias("u")).collect()}
    assert got == {r: urljoin(base, r.strip()) for r in REFERENCES}


def test_script_links_by_template(spark):
    rows = spark.createDataFrame([("javascript:go('x 1')",), ("JavaScript:void(0)",), ("javascript:other('2')",), ("mailto:a@b",), ("#",)], "h string")
    got = [r[0] for r in rows.select(html.resolve_link(F.col("h"), F.lit("http://a.org/"), {"go": "http://a.org/v/{id}"})).collect()]
    assert got == ["http://a.org/v/x%201", None, None, None, None]


def test_postings_against_plain_python_and_without_a_shuffle_of_words(spark):
    rows = [(None, None, "x"), (1, "Alpha beta", "beta, alpha beta"), (2, "", ""), (3, "é1 É1", "gamma " * 50), *_texts(60)[4:]]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    want = {}
    for key, *texts in rows:
        for field, text in zip(("title", "body"), texts, strict=True):
            for place, token in enumerate(re.findall(r"[^\W_]+", (text or "").lower())):
                want.setdefault((key, field, token), []).append(place)
    for limit in (1, 40, 1 << 20):
        found = search.postings(docs, "doc_id", limit)
        got = [(tuple(r[:3]), r["places"]) for r in found.collect()]
        assert dict(got) == want and len(got) == len(want)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
