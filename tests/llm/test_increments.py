"""A stored ledger over runs, slices of texts in any script, neighbours on the curve, and components of long chains."""

from __future__ import annotations

import random

import pytest

from feedlens.llm import packing, secretscan
from feedlens.llm.queries import tokenizer_path
from feedlens.llm.shared import components

from .fixtures import frame, prose


def test_stored_ledger_scans_only_what_is_new(spark, tmp_path):
    key = "AKIA" + "A" * 16
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", f"x {key}"), ("b", f"x {key}"), ("c", None)], "path string, text string")
    assert secretscan.stored_ledger(spark, path) is None
    assert secretscan.update(first, path).count() == 2
    grown = first.union(spark.createDataFrame([("d", "clean"), ("e", f"{key} y")], "path string, text string"))
    assert secretscan.scan(grown, secretscan.stored_ledger(spark, path)).count() == 2
    ledger = secretscan.update(grown, path)
    assert ledger.count() == 4 and ledger.select("blob_id").distinct().count() == 4
    assert secretscan.update(grown, path).count() == 4
    assert secretscan.scan(grown, secretscan.stored_ledger(spark, path)).count() == 0
    rows = secretscan.findings(grown, ledger).collect()
    assert len(rows) == 5 and sorted(r["path"] for r in rows if r["spans"]) == ["a", "b", "e"]
    # another version of the rules has a ledger of its own
    assert secretscan.stored_ledger(spark, path, secretscan.BASE_RULES) is None
    assert secretscan.update(grown, path, secretscan.BASE_RULES).count() == 4
    assert secretscan.stored_ledger(spark, path).count() == 4
    assert secretscan.update(first.where("false"), str(tmp_path / "none")).count() == 0


SCRIPTS = ("abc Éa", "пример Текст", "日本語の文", "한국어", "ελΣσς", "हिन्दी", "۱۲٣", "。，！？", "é̈ ́", "😀👍🏽", "'s 'll can't", "<|a <|endoftext|>", " \t\n　 ")


@pytest.mark.parametrize("size", [1, 7, 40])
def test_ids_of_all_scripts_do_not_depend_on_slices(monkeypatch, size):
    pick = random.Random(size)
    texts = ["", "。", "日本。日本", *["".join(pick.choice(pick.choice(SCRIPTS)) for _ in range(pick.randrange(400))) for _ in range(300)]]
    texts += [" ".join(pick.choice(SCRIPTS) for _ in range(pick.randrange(60))) for _ in range(100)]
    words = packing.WordTokenizer(tokenizer_path())
    want = [words.model.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "_SLICE", size)
    assert [x.tolist() for x in words.batch(texts)] == want
    long = "日本語の文。" * 500
    assert max(b - a for a, b in words.slices(long)) <= size + 6 and "".join(long[a:b] for a, b in words.slices(long)) == long


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one of two vocabularies mostly stand beside one of the same."""
    pick = random.Random(5)
    other = "соль море ветер камень дорога река поле небо звезда огонь".split()
    rows = [(i, prose(i, 200) if i % 2 else " ".join(pick.choice(other) for _ in range(200))) for i in range(200)]
    pieces = packing.pack(frame(spark, rows), tokenizer_path()).where("start = 0").orderBy("sequence_id", "offset").collect()
    kinds = [r["doc_id"] % 2 for r in pieces]
    assert len(kinds) == 200 and sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 180


def test_chain_of_thousands_of_links_settles(spark):
    nodes = list(range(4000))
    random.Random(1).shuffle(nodes)
    found = components(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long").repartition(4))
    assert {r["node"]: r["component"] for r in found.collect()} == {i: 0 for i in range(1, 4000)}


def test_tokenizer_splits_words_in_little_memory():
    """Of two million characters, what is held at once is bounded by a slice's."""
    import tracemalloc

    words = packing.WordTokenizer(tokenizer_path())
    texts = [" ".join(f"w{(i * 7 + j) % 900}" for j in range(300)) for i in range(1_600)]
    words.batch(texts[:10])
    tracemalloc.start()
    ids = words.batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - sum(x.nbytes for x in ids) < 40 << 20
