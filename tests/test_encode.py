"""JSON text against json.dumps, and snippets."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from feedlens.functions.encode import json_text
from feedlens.operators import search

SCHEMA = "s string, n long, b boolean, a array<string>, m map<string,array<string>>, x struct<p:string,q:struct<r:array<int>>>, e array<map<string,string>>"


def test_json_text(spark):
    control = "".join(map(chr, range(32)))
    rows = [
        ("plain", 1, True, ["a", None, "ü한\U0001f600"], {"": ["v", "w"]}, ("p", ([1, None],)), [{"a": "b"}, {}]),
        (f'q"\\u000b\\\\n{control}\x7f', -(1 << 62), False, [], {}, None, []),
        (None, None, None, None, None, (None, None), None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = F.struct(*df.columns)
    kind = df.select(whole.alias("w")).schema["w"].dataType
    got = [r["t"] for r in df.select(json_text(whole, kind).alias("t")).collect()]
    want = []
    for r in rows:
        told = dict(zip(df.columns, r, strict=True))
        if r[5] is not None:
            told["x"] = {"p": r[5][0], "q": None if r[5][1] is None else {"r": r[5][1][0]}}
        want.append(json.dumps(told, ensure_ascii=False))
    assert got == want


def test_snippet_takes_the_window_with_most_hits(spark):
    body = " ".join(["hit", *["x"] * 50, "a", "hit", "b", "Hit,", *["y"] * 50])
    rows = spark.createDataFrame([(body,), ("one hit only",), ("none",), (None,), (" ".join(["z"] * 40 + ["hit"]),)], "body string")
    got = [r[0] for r in rows.select(search.snippet(F.col("body"), ["hit"])).collect()]
    assert got[0] == "...<b>hit</b> b <b>Hit</b>, " + " ".join(["y"] * 29) + "..."
    assert got[1:4] == ["one <b>hit</b> only", "none", None]
    assert got[4] == "..." + " ".join(["z"] * 31) + " <b>hit</b>"
