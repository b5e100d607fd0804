"""Page, feed and listing texts against html.unescape and the definition in plain Python."""

from __future__ import annotations

import html as stdlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from feedlens import catalog
from feedlens.sources import html, listings

SF = os.environ.get("FEEDLENS_TEST_SF", "/root/testdata/sf0.001")


def plain_text(page: str) -> str:
    text = re.sub(r"<(script|style)[^>]*>.*?</\1>", "", page, flags=re.IGNORECASE | re.DOTALL)
    text = re.sub(r"</?(p|div|section|article|li|ul|ol|h[1-6]|br|tr|td|th)[^>]*>", "\n", text, flags=re.IGNORECASE)
    text = stdlib.unescape(re.sub(r"<[^>]+>", "", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text)).strip()


PAGES = [
    None,
    "",
    "<p>&copy; 2024 &middot; caf&eacute; &#8212; &#x27;x&#x27; &hellip; &notin; &notit; &amp;lt; &lt &#0; &#128; &bogus; A&B</p>",
    "&nbsp;<p>one&nbsp;two</p>&#x3000;&nbsp;",
    "a&#13;&#10;&#10;&#10;b&#13;c&#28;",
]


def test_page_text_decodes_all_references(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i long, h string")
    found = {r["i"]: r["t"] for r in df.select("i", html.html_text(F.col("h")).alias("t")).collect()}
    assert found == {i: None if p is None else plain_text(p) for i, p in enumerate(PAGES)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_page_text_length_of_a_table(spark):
    import hashlib

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {r["page_id"]: (len(t := plain_text(r["html"])), hashlib.md5(t.encode()).hexdigest()) for r in pages}
    assert {r["page_id"]: (r["n_chars"], r["text_md5"]) for r in catalog.QUERIES["page_text_length"](spark, SF).collect()} == want


def test_feed_and_listing_decode_all_references(spark):
    body = "<rss><channel><item><title>A &amp;copy; &amp;#8212;</title><link>https://a.org/1</link><description> d &amp;eacute; </description></item></channel></rss>"
    row = listings.parse_feeds(spark.createDataFrame([("s", "c", body)], "source string, category string, body string")).first()
    assert (row["title"], row["summary"]) == ("A \u00a9 \u2014", "d \u00e9")
    child = {"kind": "t3", "data": {"title": "T &copy;", "selftext": "x &#8212; y", "permalink": "/r/x/1/", "subreddit": "x"}}
    raw = spark.createDataFrame([("s", "c", json.dumps({"kind": "Listing", "data": {"children": [child]}}))], "source string, category string, body string")
    row = listings.parse_listings(raw).first()
    assert row["title"] == "T \u00a9" and row["summary"].endswith("x \u2014 y")


def test_page_text_length_as_its_sql(spark, tmp_path):
    """References without a semicolon, unknown and numeric ones, and blanks that only one of two engines strips."""
    import duckdb

    rows = [(i, p) for i, p in enumerate([*PAGES, "<b>x&amp&amp;&amp;&amp</b> &copy &copy; &#8212; &ampx; &amp;lt;", "\u2002 a &ensp;", "&apos;&#39;&#x27;\x0b"])]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT page_id, n_chars, text_md5 FROM ({catalog.ORACLES['page_text_length']})").fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["page_text_length"](spark, str(tmp_path)).select("page_id", "n_chars", "text_md5").collect()) == want
