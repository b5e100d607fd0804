"""Texts of many secrets, against plain Python."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from feedlens.llm import secretscan


def _plain_spans(text):
    found = []
    for rank, rule in enumerate(secretscan.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.at_least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return sorted(found)


def _plain_redacted(text, spans):
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[REDACTED]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _text(rng, n):
    makers = (
        lambda: f"password='{rng.randrange(10**9):09d}'",
        lambda: "AKIA" + "".join(rng.choices("ABCDEF0123456789", k=rng.randint(10, 24))),
        lambda: "".join(rng.choices("abcdef0123456789", k=rng.randint(12, 40))),
        lambda: "token=" + "".join(rng.choices("abcdef0123456789", k=40)),
        lambda: "secret: é" + "x" * rng.randint(0, 9),
        lambda: rng.choice(["word", "naïve", "日本語", "😀", "-" * 30]),
    )
    return "".join(rng.choice(makers)() + rng.choice([" ", "\n", ";"]) for _ in range(n))


def test_many_secrets_against_plain_python(spark):
    rng = random.Random(7)
    # counts about the edges of blocks, and none
    texts = [_text(rng, n) for n in (0, 1, 2, 100, 127, 128, 129, 160, 200, 260, 400)] + ["", "clean", "password=abcdef" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = rows.select("doc_id", "text", secretscan.text_spans(F.col("text")).alias("spans"))
    got = {r["doc_id"]: r for r in spans.withColumn("clean", secretscan.redact(F.col("text"), F.col("spans"))).collect()}
    for i, text in enumerate(texts):
        plain = _plain_spans(text)
        assert [tuple(s) for s in got[i]["spans"]] == plain
        assert got[i]["clean"] == _plain_redacted(text, plain)


def test_work_does_not_grow_with_the_square_of_secrets(spark):
    text = _text(random.Random(3), 20_000)
    rows = spark.createDataFrame([(text,)], "text string").select("text", secretscan.text_spans(F.col("text")).alias("spans"))
    begin = time.monotonic()
    clean = rows.select(secretscan.redact(F.col("text"), F.col("spans")).alias("clean")).first()["clean"]
    # a square took minutes at a tenth of this
    assert time.monotonic() - begin < 60
    assert clean == _plain_redacted(text, _plain_spans(text))
