"""Ids above 2**53 beside nulls, words longer than a slice, and licence notices."""

from __future__ import annotations

import pytest

import corpus_pipeline
from feedlens.llm import chat, decontam, digest, langid, licenses, neardup, packing, textkit
from feedlens.llm.queries import tokenizer_path

from .fixtures import SPACE_WORD, frame, prose, words_of

BIG = (1 << 62) + 1
IDS = [BIG, None, BIG + 1, 7]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, [(i, prose(n, 90)) for n, i in enumerate(IDS)]).coalesce(1)


@pytest.mark.parametrize("name", ["op4", "op5", "op6", "op8", "op10"])
def test_large_ids_beside_null(spark, docs, name):
    if name == "op4":
        found = digest.fingerprints(docs)
    elif name == "op5":
        found = neardup.near_duplicates(docs)
    elif name == "op6":
        found = decontam.contaminated(docs, docs.selectExpr("doc_id AS item_id", "text"))
        assert {r["item_id"] for r in found.collect()} == set(IDS)
    elif name == "op8":
        windows = chat.format_chats(docs.selectExpr("doc_id AS conv_id", "0 AS turn", "'user' AS role", "text"), tokenizer_path())
        found = chat.read_back(windows).withColumnRenamed("conv_id", "doc_id")
    else:
        found = packing.pack(docs, tokenizer_path())
    assert {r["doc_id"] for r in found.collect()} == set(IDS)


def test_pipeline_stages_keep_large_ids(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large"))
    rows = [(i, f"{prose(n, 90)} password: hunter22x", "aa", 1, "mine") for n, i in enumerate([*IDS, *range(100, 130)])]
    rows += [(7, rows[3][1], "aa", 1, "mine"), (BIG + 9, f"{prose(500, 60)} {prose(77, 30)} {prose(501, 60)}", "aa", 1, "mine")]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score string").coalesce(1)
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = {x[0] for x in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{folder}/{name}"
        stage(spark, held, folder).write.parquet(out)
        held = spark.read.parquet(out)
        if name == "decontaminate":
            want.remove(BIG + 9)
        assert {r["doc_id"] for r in held.collect()} == want
        if name == "near_dedup":
            assert held.where("doc_id = 7").count() == 1
        if name == "secret_scan":
            assert held.where("text like '%hunter22x%'").count() == 0 and held.where("n_chars <> length(text)").count() == 0


def test_stages_of_empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    held = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, held, folder).count() == 0


@pytest.mark.parametrize("slice_size", [5, 16, 61])
def test_words_longer_than_a_slice(monkeypatch, slice_size):
    texts = ["x" * 300, "a " + "b" * 90 + " c" * 40, " " * 70 + "d", "e" * 16 + " " + "f" * 16, "", prose(3, 60)]
    want = [w.tolist() for w in textkit.WordHasher().words(texts)]
    monkeypatch.setattr(textkit, "CHUNK", slice_size)
    found = [w.tolist() for w in textkit.WordHasher().words(texts)]
    assert found == want and [len(w) for w in want] == [len(words_of(t, SPACE_WORD)) for t in texts]


def test_trigrams_do_not_depend_on_slices(monkeypatch):
    texts = ["", "a", prose(5, 40), "\u00e91x \u00df", " ab "]

    def grams():
        out = [[] for _ in texts]
        for owner, pieces in langid._pieces(texts):
            found, piece = langid._grams(pieces)
            for g, i in zip(found.tolist(), owner[piece].tolist(), strict=True):
                out[i].append(g)
        return [sorted(x) for x in out]

    want = grams()
    assert len(want[2]) == sum(c.isalpha() for c in texts[2])
    for size in (1, 3, 10):
        monkeypatch.setattr(langid, "_SLICE", size)
        assert grams() == want


def test_digests_do_not_depend_on_slices(monkeypatch):
    texts = ["", "=", "ab" * 300, prose(5, 400), "x" * 383, "x" * 384]
    want = digest.features(texts)
    assert [len(x) > 0 for x in want] == [False, True, True, True, True, True]
    assert digest.likeness(*digest.digests(["x" * 383, "x" * 384])) > 0.9
    monkeypatch.setattr(digest, "_SLICE", 100)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(want, digest.features(texts), strict=True))


def test_digest_features_against_plain_python():
    """Ranks by entropy, votes by neighbourhood and popularity, one window at a time."""
    from collections import Counter
    from math import log2

    text = prose(9, 120)
    data = text.encode()
    n = len(data)
    circle = data * 3
    windows = [circle[i : i + digest.WINDOW] for i in range(n)]

    def rank(w: bytes) -> int:
        return abs(sum(int(round(k * log2(k) * 4096)) for k in Counter(w).values()) - digest._USUAL)

    ranks = [rank(w) for w in windows]
    rarest = []
    for i in range(n):
        near = [(i + j) % n for j in range(digest.NEIGHBOURS)]
        most = max(ranks[j] for j in near)
        rarest.append({windows[j] for j in near if ranks[j] == most})
    sure = [next(iter(x)) for x in rarest if len(x) == 1]
    long_runs, run = set(), 0
    for i in range(1, n):
        run = run + 1 if len(rarest[i]) == 1 and rarest[i] == rarest[i - 1] else 0
        if run + 1 >= digest.POPULAR:
            long_runs.add(next(iter(rarest[i])))
    found = digest.features([text])[0]
    import numpy as np

    raw = np.frombuffer((data * 3)[: n + digest.WINDOW + digest.NEIGHBOURS - 2], dtype=np.uint8)
    hashes = digest.mix64(digest._ranked(raw))
    named = {windows[i % n]: int(hashes[i]) for i in range(n)}
    assert {named[w] for w in long_runs} <= set(found.tolist()) and len(sure) > n / 2
    assert set(found.tolist()) <= {named[w] for x in rarest for w in x}


def test_licence_notices_in_long_texts(spark):
    filler = " ".join(["license software the"] * 4000)
    notice = {t.label: t.text for t in licenses.TEMPLATES if len(t.words) > 30}
    assert {"apache-2.0", "bsd", "gpl-3.0", "mit", "mpl-2.0"} <= set(notice)
    rows = [(i, f"{filler} {text} {filler}") for i, text in enumerate(notice.values())] + [(50, filler), (51, None)]
    found = {r["doc_id"]: r for r in licenses.summary(licenses.scan(frame(spark, rows))).collect()}
    for i, label in enumerate(notice):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1.0
    assert found[50]["labels"] == found[51]["labels"] == "" and found[51]["n_words"] == 0
    kept = licenses.scan(frame(spark, rows).selectExpr("*", "'mine' AS _w0", "'mine' AS _hit0", "'mine' AS _sure0"))
    assert {(r["_w0"], r["_hit0"], r["_sure0"]) for r in kept.collect()} == {("mine", "mine", "mine")}
