"""The queries with SQL against DuckDB, on test tables and on odd documents; empty tables for all."""

from __future__ import annotations

import os

import duckdb
import pytest

from feedlens.llm import oracles, queries

from .fixtures import frame, texts

SF = os.environ.get("FEEDLENS_TEST_SF", "/root/testdata/sf0.001")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def held_against_sql(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for entry in sorted(os.listdir(folder)):
        path = f"{folder}/{entry}"
        con.execute(f"CREATE VIEW {entry.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(oracles.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_tables(spark, name):
    held_against_sql(spark, SF, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, repeats, long texts and clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    licences = [(500, "All Rights  Reserved. cc by CC-BY general public license"), (501, "released under the MIT License"), (502, "cc by nc 4 0 cc by"), (503, "licensed under the gnu general public license version 3")]
    secrets = [(600, "AKIA" + "A1" * 12 + "\U0001f600 token = 'abcdef12' " + "ab12" * 9), (601, "api_key=short API-KEY secret\":\"qwertz.uiop= passwd: x"), (602, "ghp_" + "a" * 40 + " xoxb-1234567890ab")]
    rows = [x for x in texts() if x[0] != 307] + licences + secrets
    long = " ".join(["filler"] * 30_000)
    item = next(t for i, t in rows if i == 203)
    rows += [(700, f"{long} {item} {long}"), (701, item.upper())]
    frame(spark, rows).repartition(5).write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, ""), (3, None), (4, "one two"), (5, next(t for i, t in rows if i == 211))]
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.example.com/en/x?y#z"), (4, "http://A.example.com/en/x?y#z"), (None, "x://net")]
    spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>"), (None, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS window_id").write.parquet(f"{folder}/conversations.parquet")
    return folder


def no_null_ids(folder: str, spark, tmp_path_factory) -> str:
    """The same documents without null doc_ids, which SQL's plain joins can't hold."""
    out = str(tmp_path_factory.mktemp("known"))
    spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id", "text"]).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").drop("doc_id").write.parquet(f"{out}/benchmark.parquet")
    spark.read.parquet(f"{folder}/conversations.parquet").write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_odd_documents_against_sql(spark, odd, tmp_path_factory, name):
    held_against_sql(spark, no_null_ids(odd, spark, tmp_path_factory), name)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_documents_keep_all_rows(spark, odd, name):
    found = queries.QUERIES[name](spark, odd)
    if name in ("op1_language", "op2_licenses", "op4_fingerprints", "op5_near_duplicates", "op7_secrets"):
        assert found.count() == spark.read.parquet(f"{odd}/documents.parquet").count()
    elif name == "op3_url_filter":
        assert found.count() == 6
    elif name == "op8_chat":
        assert found.count() == 4
    else:
        found.collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = str(tmp_path_factory.mktemp("empty"))
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string",
    }
    for table, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{table}.parquet")
    assert len(queries.QUERIES[name](spark, folder).collect()) == (1 if name == "op8_chat" else 0)
