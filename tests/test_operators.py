"""Reference expectations of the engine's own operators, on small inputs."""

from __future__ import annotations

import math
import random
import sqlite3
from datetime import datetime

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from feedlens.functions import text as texts
from feedlens.functions import urls
from feedlens.operators import articles as store
from feedlens.operators import clustering, health, ontology, quality, search, tagging
from feedlens.sources import html, listings


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("https://Example.com/a?utm_source=x&b=1", "https://example.com/a?b=1"),
        ("HTTP://example.com:80/a/", "http://example.com/a"),
        ("https://example.com:443/", "https://example.com/"),
        ("https://user:Pw@Example.com:8443/a", "https://user:Pw@example.com:8443/a"),
        ("https://example.com/a?b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("  https://example.com/a  ", "https://example.com/a"),
        ("https://example.com/?gclid=1&fbclid=2", "https://example.com/"),
        ("https://example.com/a%20b?q=x+y", "https://example.com/a%20b?q=x+y"),
        ("https://example.com/a?b=", "https://example.com/a"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, raw, expected):
    assert one(spark, urls.canonical_url(F.col("u")), u=raw) == expected


def test_title_tokens(spark):
    assert one(spark, texts.title_tokens(F.col("t")), t="The Quick Brown Fox") == ["quick", "brown", "fox"]
    assert one(spark, texts.title_tokens(F.col("t")), t="AI 보안 위협 보고서 (2026)") == ["ai", "보안", "위협", "보고서", "2026"]
    assert one(spark, texts.title_tokens(F.col("t"), compose=True), t="ＡＩ ｎｅｗｓ") == ["ai", "news"]
    assert one(spark, texts.title_tokens(F.col("t")), t=None) == []


@pytest.mark.parametrize(
    ("text", "keyword", "hit"),
    [("Python release notes", "python", True), ("CHAIR design trends", "ai", False), ("새 인공지능 소식", "인공지능", True), ("an AI, again", "ai", True), ("½ai", "ai", False)],
)
def test_keywords(spark, text, keyword, hit):
    assert one(spark, texts.holds_keyword(F.lower("t"), texts.folded(F.col("t")), keyword), t=text) is hit


def test_matched_entities(spark):
    rules = [("lang", ["", "python", ""]), ("maker", ["nintendo"])]
    got = one(spark, tagging.matched_entities(F.col("t"), F.col("s"), rules), t="Python", s=None)
    assert got == {"lang": ["python"]}
    assert one(spark, tagging.matched_entities(F.col("t"), F.col("s"), []), t="a", s="b") == {}


def test_nl_query(spark):
    got = one(spark, texts.parse_query(F.col("q")), q="last 2 weeks top 10 security")
    assert (got.search_text, got.days, got.limit) == ("security", 14, 10)
    got = one(spark, texts.parse_query(F.col("q")), q="최근 3개월 보안 5개")
    assert (got.search_text, got.days, got.limit) == ("보안", 90, 5)


def test_upsert_last_wins_but_first_source(spark):
    cols = "link string, title string, source string, category string, seq int"
    old = store.upsert(None, spark.createDataFrame([("a", "Original", "s1", "c1", 1), ("b", "B", "s", "c", 2)], cols))
    new = spark.createDataFrame([("a", "Newer", "s2", "c2", 1), ("a", "Updated", "s3", "c3", 2)], cols)
    got = {r["link"]: (r["title"], r["source"], r["category"]) for r in store.upsert(old, new).collect()}
    assert got == {"a": ("Updated", "s1", "c1"), "b": ("B", "s", "c")}


def test_upsert_rejects_null_links(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "link string, seq int")
    with pytest.raises(Exception, match="article without a link"):
        store.require_links(rows).collect()


def test_reliability(spark):
    rows = [("A", "ok", datetime(2026, 5, 13, 11))] * 9 + [("A", "timeout", datetime(2026, 5, 13, 11))] + [("B", "ok", datetime(2026, 4, 23, 12))]
    rows += [("C", "ok", datetime(2026, 5, 13, 11))] + [("C", "error", datetime(2026, 5, 13, 11))] * 4 + [(None, "ok", datetime(2026, 5, 13, 11))]
    log = spark.createDataFrame(rows, "source string, fetch_status string, collected_at timestamp_ntz")
    got = {r["source"]: r for r in health.reliability(log, F.lit("2026-05-13 12:00:00").cast("timestamp_ntz")).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"].article_count, got["A"].success_rate) == (9, 0.9) and got["A"].score > 80
    assert (got["B"].staleness_days, got["B"].score) == (20.0, 70.0)
    assert got["C"].success_rate == 0.2 and got["C"].score < 50


def test_throttle(spark):
    rows = [("a", 1, "error"), ("b", 1, "error"), ("b", 2, "ok"), ("c", 1, "error"), ("c", 2, "error")]
    log = spark.createDataFrame(rows, "source string, seq int, fetch_status string")
    got = {r["source"]: r["delay"] for r in health.throttle_fold(log, success=0.8).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(0.9), "c": 2.0}


@pytest.mark.parametrize("width", [1, 16, 64, 4096])
def test_throttle_over_stretches(spark, width):
    rng = random.Random(width)
    rows = [("often", i, "error" if rng.random() < 0.5 else "ok") for i in range(3000)]
    rows += [("seldom", 7 * i, "timeout" if rng.random() < 0.02 else None) for i in range(2500)]
    # never settles: a step down from a delay between the bounds, and up again
    rows += [("between", i, "error" if i % 40 == 0 and i < 200 else "ok") for i in range(300)] + [(None, 5, "error"), (None, 9, "error")]
    rng.shuffle(rows)
    found = health.throttle_fold(spark.createDataFrame(rows, "source string, seq long, fetch_status string"), width=width)
    got = {r["source"]: (r["delay"], r["n_events"]) for r in found.collect()}
    want = {}
    for source, _, status in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        delay, n = want.get(source, (0.5, 0))
        bad = status in ("error", "timeout")
        want[source] = (max(0.5, min(60.0, delay * 2.0)) if bad else max(0.5, delay - 0.5 * (1.0 - 0.9)), n + 1)
    assert got == want


@pytest.mark.parametrize(("value", "want"), [("12", 12.0), ("Wed, 01 May 2024 10:00:30 GMT", 30.0), ("900", 60.0), ("soon", 0.5)])
def test_retry_after(spark, value, want):
    assert one(spark, health.retry_after(F.col("v"), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"), 0.5, 60.0), v=value) == want


def test_breaker(spark):
    at = lambda s: datetime(2026, 1, 1, 0, s // 60, s % 60)
    rows = [("a", i, "error", at(i)) for i in range(5)] + [("a", 9, "ok", at(10)), ("a", 10, "ok", at(70)), ("a", 11, "ok", at(71)), ("b", 1, "ok", at(0))]
    log = spark.createDataFrame(rows, "source string, seq int, fetch_status string, collected_at timestamp_ntz")
    got = {r["source"]: (r["state"], r["refused"], r["opened"]) for r in health.breaker_fold(log).collect()}
    assert got == {"a": ("closed", 1, 1), "b": ("closed", 0, 0)}


def test_health_merge_keeps_disabled(spark):
    cols = "source string, success_count long, failure_count long, last_delay double, last_error string, disabled boolean"
    old = spark.createDataFrame([("a", 1, 10, 1.0, "error", True)], cols)
    new = spark.createDataFrame([("a", 5, 0, 2.0, None, False), ("b", 1, 0, 0.5, None, False)], cols)
    got = {r["source"]: (r["success_count"], r["failure_count"], r["last_delay"], r["last_error"], r["disabled"]) for r in health.merge_counters(old, new).collect()}
    assert got == {"a": (6, 10, 2.0, "error", True), "b": (1, 0, 0.5, None, False)}


def _greedy(rows, threshold):
    """Naive scan in key order over token lists."""

    def cosine(a, b):
        dot = sum(a.count(w) * b.count(w) for w in set(a))
        return dot / (math.sqrt(sum(a.count(w) ** 2 for w in set(a))) * math.sqrt(sum(b.count(w) ** 2 for w in set(b)))) if a and b else 0.0

    leader = {}
    keys = sorted(rows)
    for i, k in enumerate(keys):
        if k in leader:
            continue
        leader[k] = k
        for j in keys[i + 1 :]:
            if j not in leader and cosine(rows[k], rows[j]) >= threshold:
                leader[j] = k
    return leader


def test_leader_clustering_against_scan(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    rows = {f"k{i:03d}": [rng.choice(words) for _ in range(rng.randint(0, 5))] for i in range(120)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "link string, title string")
    got = {r["link"]: r["leader"] for r in clustering.clusters(df, 0.7).collect()}
    assert got == _greedy(rows, 0.7)


def _shuffled(spark):
    """Records that the session's stages have shuffled so far."""
    store, total, number, missing = spark.sparkContext._jsc.sc().statusStore(), 0, 0, 0
    while missing < 30:
        try:
            total, missing = total + store.lastStageAttempt(number).shuffleWriteRecords(), 0
        except Py4JJavaError:
            missing += 1
        number += 1
    return total


def test_similar_titles_of_common_words(spark):
    """Titles of common words, some of them repeated: only similar ones leave a task, as no candidates are shuffled."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    titles = [[rng.choice(words) for _ in range(rng.choice((2, 9, 30, 30, 30)))] for _ in range(2000)]
    titles += [[*t[:-2], rng.choice(words), "again"] for t in titles[:300]]
    titles += [[rng.choice(words)] * rng.randint(20, 40) + rng.sample(words, 12) for _ in range(100)] + [[w] for w in words[:60]]
    counts = np.zeros((len(titles), 151))
    for i, t in enumerate(titles):
        for w in t:
            counts[i, 150 if w == "again" else int(w[1:])] += 1
    counts /= np.linalg.norm(counts, axis=1)[:, None]
    cosines = counts @ counts.T
    reps = spark.createDataFrame([(f"k{i:05}", sorted(t)) for i, t in enumerate(titles)], "rep string, signature array<string>").repartition(8)
    before = _shuffled(spark)
    found = {(r["a"], r["b"]): r["cosine"] for r in clustering.similar_pairs(reps, 0.7).collect()}
    assert _shuffled(spark) - before < 20 * len(titles)
    left, right = np.nonzero(np.triu(cosines > 0.7 + 1e-9, 1))
    want = {(f"k{i:05}", f"k{j:05}"): cosines[i, j] for i, j in zip(left, right, strict=True)}
    assert len(want) > 300 and all(abs(found[x] - want[x]) < 1e-9 for x in want)
    assert all(x in want or abs(found[x] - 0.7) < 1e-9 for x in found)


def test_similar_titles_of_no_titles(spark):
    assert clustering.similar_pairs(spark.createDataFrame([], "rep string, signature array<string>"), 0.7).count() == 0


def test_search_against_fts5(spark):
    docs = [("1", "alpha news", "beta gamma alpha"), ("2", "beta", "gamma gamma delta"), ("3", "delta epsilon", "alpha beta gamma delta"), ("4", "zeta", "eta theta"), ("5", "eta", "general public license"), ("6", "iota", "kappa")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(link unindexed, title, body)")
    con.executemany("insert into f values (?, ?, ?)", docs)
    df = spark.createDataFrame(docs, "link string, title string, body string")
    term = search.Term
    cases = {
        "epsilon": term("epsilon"),
        "alpha delta": search.All((term("alpha"), term("delta"))),
        '"public license"': term("public license"),
        "alpha NOT epsilon": search.But(term("alpha"), term("epsilon")),
        "kap*": term("kap", prefix=True),
        "title:eta": term("eta", column="title"),
        "theta OR kappa": search.Any((term("theta"), term("kappa"))),
        "beta gamma OR kappa": search.Any((search.All((term("beta"), term("gamma"))), term("kappa"))),
        "kappa OR alpha NOT epsilon": search.Any((term("kappa"), search.But(term("alpha"), term("epsilon")))),
    }
    for match, wanted in cases.items():
        want = con.execute("select link, bm25(f) from f where f match ? order by 2, 1", (match,)).fetchall()
        got = [(r["link"], r["rank"]) for r in search.search(df, "link", wanted).collect()]
        assert [x[0] for x in got] == [x[0] for x in want], match
        if "*" not in match and ":" not in match:
            assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-6), match


def test_html(spark):
    page = "<html><head><TITLE> A b </TITLE><style>p{}</style><script>x('</p>')</script></head><body><p>One &amp; two</p><div>Three</div></body></html>"
    assert one(spark, html.html_title(F.col("h"), F.col("u")), h=page, u="u") == "A b"
    assert one(spark, html.html_title(F.col("h"), F.col("u")), h="<p>", u="u") == "u"
    assert "One & two" in one(spark, html.html_text(F.col("h")), h=page)
    assert one(spark, html.markdown_title(F.col("m"), F.col("u")), m="x\n# Head\n", u="u") == "Head"
    for href, want in (("/x", "https://a.org/x"), ("y.html", "https://a.org/d/y.html"), ("mailto:a@b", None), ("#", None), ("//b.org/z", "https://b.org/z")):
        assert one(spark, html.resolve_link(F.col("h"), F.col("b")), h=href, b="https://a.org/d/i.html") == want
    assert one(spark, html.script_link(F.col("h"), {"go": "https://a.org/{id}/{arg1}"}), h="javascript:go('4 2','b')") == "https://a.org/4%202/b"


def test_feed(spark):
    body = "<rss><channel><item><title>A</title><link>https://a.org/1</link><description>d</description><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item><item><title>B</title><link></link></item></channel></rss>"
    rows = listings.parse_feeds(spark.createDataFrame([("s", "c", body)], "source string, category string, body string")).collect()
    assert [(r["title"], r["link"], r["summary"]) for r in rows] == [("A", "https://a.org/1", "d")]
    assert rows[0]["published"] == datetime(2024, 5, 1, 10)


def test_validation(spark):
    row = spark.createDataFrame([(" ", "nope", "s", None, "c")], "title string, link string, summary string, source string, category string")
    got = row.select(quality.validation_errors().alias("x")).first()["x"]
    assert got == ["title is empty", "link has invalid URL format: nope", "source is missing or not a string"]


def test_similar_articles(spark):
    rows = [("Big news today", "https://a.org/story/1", "Big news today!", "https://a.org/story/2"), ("Big news", "https://a.org/x", "Big news", "https://b.org/x")]
    pairs = spark.createDataFrame(rows, "title1 string, url1 string, title2 string, url2 string")
    assert quality.similar_articles(pairs).count() == 1


def test_reports_expire(spark):
    today = F.lit("2026-02-01").cast("date")
    for name, want in (("x_20260101.html", True), ("2026-01-31.html", False), ("index.html", False), ("notes.html", False)):
        assert one(spark, store.is_expired_report(F.col("n"), today, 7), n=name) is want
    assert one(spark, store.is_expired_folder(F.col("n"), today, -3), n="2026-01-31") is False


def test_ontology(spark):
    contract = {"event_model_mappings": {"r": "em.r"}, "source_role_mappings": {}, "event_model_field_specs": {"r": {"required_fields": ["headline", "owner"]}}}
    df = spark.createDataFrame([("t", "s")], "title string, source string")
    values = ontology.payload(contract["event_model_field_specs"]["r"], df.columns)
    known = F.create_map(F.lit("event_model_id"), F.lit("em.r"))
    got = df.select(ontology.validate(known, values, contract).alias("x")).first()["x"]
    assert got == ["event_model_payload missing required field 'owner' for 'em.r'"]


def test_stream_matches_batch(spark, tmp_path):
    from feedlens.sources.adapters import fetch_log
    from feedlens.streaming import health as streaming

    rows = spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 9), i % 7, ("error", "view", "signup")[i % 3], float(i), "{}") for i in range(300)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    rows.repartition(6).write.parquet(str(tmp_path / "events"))
    log = fetch_log(streaming.read_events(spark, str(tmp_path / "events")))
    streaming.merge_health(log, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name[1:]))
    pick = lambda df: {r["source"]: (r["success_count"], r["failure_count"], r["disabled"]) for r in df.collect()}
    assert pick(spark.read.parquet(str(last))) == pick(health.counters(fetch_log(rows)))


def test_select_sources(spark):
    from feedlens.operators import reports

    rows = spark.createDataFrame([(0, "a1", "Alpha"), (1, None, " Beta "), (2, "c3", None), (3, "", "Delta"), (4, None, None)], "pos int, id string, name string")
    pick = lambda **k: [r["pos"] for r in reports.select_sources(rows, **k).orderBy("pos").collect()]
    assert pick() == [0, 1, 2, 3, 4]
    assert pick(exclude=["", "  "]) == [0, 1, 2, 3, 4]
    assert pick(exclude=["ALPHA", "beta", " C3 "]) == [3, 4]
    assert pick(exclude=["a1"], most=2) == [1, 2]
    assert pick(most=0) == [0, 1, 2, 3, 4]


def test_report_index(spark):
    from feedlens.operators import reports

    names = ["game_20240102.html", "about_us.html", "index.html", "2024-01-03/index.html", "drafts/index.html", "game_20240102_summary.json", "_20240102.html", None]
    rows = reports.report_index(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {tuple(r) for r in rows} == {
        ("game_20240102.html", "game - 2024-01-02", "2024-01-02"),
        ("about_us.html", "About Us", ""),
        ("2024-01-03/index.html", "2024-01-03", "2024-01-03"),
        ("_20240102.html", " 20240102", ""),
    }
    assert reports.report_index(spark.createDataFrame([], "name string")).count() == 0


def test_notification_text(spark):
    from pyspark.sql import functions as F

    from feedlens.operators import reports

    rows = spark.createDataFrame([("game", "https://x.example/r"), ("x" * 5000, None), ("game", "")], "category string, url string")
    at = F.lit("2024-01-31 08:00:00").cast("timestamp_ntz")
    numbers = [F.lit(i) for i in (3, 42, 35, 0)]
    got = [r["t"] for r in rows.select(reports.notification_text(F.col("category"), at, *numbers, F.col("url")).alias("t")).collect()]
    assert got[0].endswith("  Errors: 0\n\n[Report](https://x.example/r)") and "*Timestamp:* 2024-01-31T08:00:00\n" in got[0]
    assert len(got[1]) == 4096 and got[1].endswith("...")
    assert got[2].endswith("  Errors: 0")
