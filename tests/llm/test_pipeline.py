"""The corpus pipeline, stage by stage, against plain-Python versions of the stages."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from feedlens.llm import queries

from .fixtures import LETTER_WORD, near_components, shingle_set
from .test_methods import held_packing

SF = os.environ.get("FEEDLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_and_run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    text = documents.where("n_chars > 2000").orderBy("doc_id").first()["text"]
    turned = " ".join(reversed(text.split()))
    more = [(900_001, f"{turned} password: hunter22x", "en", "s", 0), (900_002, "#### 123 ####", "en", "s", 13), (900_003, None, None, None, None), (None, text, "en", "s", 1)]
    documents.union(spark.createDataFrame(more, documents.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, folder).cache()
    assert spoken.columns == docs.columns
    ids = {r["doc_id"] for r in spoken.select("doc_id").collect()}
    assert not ids & {900_002, 900_003}
    lost = docs.where("lang is not null and n_chars > 200 and doc_id < 900000").join(spoken, "doc_id", "left_anti")
    assert lost.where("text rlike '([a-z]+ ){30}'").count() == 0

    rows = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    firsts = {i for i, (_, c) in near_components(rows, 80).items() if i == c}
    single = stages["near_dedup"](spark, spoken, folder).cache()
    assert {r["doc_id"] for r in single.collect()} - {None} == firsts

    items = [shingle_set(r["text"], LETTER_WORD) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = stages["decontaminate"](spark, single, folder).cache()
    want = set()
    for i, own in ((r["doc_id"], shingle_set(r["text"], LETTER_WORD)) for r in single.collect()):
        if not any(x and 10 * len(x & own) >= 8 * len(x) for x in items):
            want.add(i)
    assert {r["doc_id"] for r in clean.collect()} == want

    safe = stages["secret_scan"](spark, clean, folder).cache()
    assert safe.columns == docs.columns and safe.count() == clean.count()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    changed = [r for r in safe.collect() if r["text"] != before[r["doc_id"]]]
    assert changed and all("[REDACTED]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    assert queries.secretscan.scan(safe).where("exists(spans, s -> s.kind in ('assign', 'access', 'hex'))").count() == 0

    held_packing([(r["doc_id"], r["text"]) for r in safe.collect()], stages["pack"](spark, safe, folder).collect())
    found = corpus_pipeline.run(spark, folder).collect()
    held_packing([(r["doc_id"], r["text"]) for r in safe.collect()], found)
