"""Ranked search against plain Python, over many small shards and blocks of queries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedlens.llm import ranked

from .fixtures import frame, texts, words_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score)."""
    held = [(i, Counter(words_of(t, TERM))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words_of(text, TERM) if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "banel banel densung lorla"), (2, ""), (3, None), (None, "kitel murlung MUSO"), (5, "one two 34"), (5, "one two 34"), (6, "nowhere at all"), (7, "éè x")]


@pytest.mark.parametrize("postings,block", [(1 << 20, 1 << 17), (150, 3)])
def test_against_plain(spark, postings, block):
    rows = [x for x in texts() if x[0] != 307] + [(-5, "one two 34 34"), (-5, "banel")]
    docs, items = frame(spark, rows).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS rank", "1 AS terms", "2 AS doc_id")
    totals = ranked.corpus(docs)
    found = ranked.search(ranked.index(docs, totals, postings), totals, items, block_terms=block)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, ITEMS)


def test_large_ids_and_copies_rank_by_id(spark):
    big = (1 << 62) + 1
    rows = [(big, "rare word"), (None, "rare word"), *[(i, "rare word") for i in range(30, 10, -1)], *[(i, "other thing") for i in range(100, 200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    totals = ranked.corpus(docs)
    items = spark.createDataFrame([(1, "rare")], "item_id long, text string")
    found = ranked.search(ranked.index(docs, totals), totals, items, k=22).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [*range(11, 31), big, None]


def test_best_first_opens_few_nodes(monkeypatch):
    """The answer is that of all documents; steps of several nodes open few more than one by one."""
    pick = random.Random(3)
    shard = ranked._Shard()
    rows = []
    for doc in range(2_000):
        terms = np.unique(np.array([pick.randrange(1 << 30) % 300 + 1 for _ in range(20)], dtype=np.uint64))
        impacts = np.array([pick.randrange(1, 10_000) for _ in terms], dtype=np.int64)
        shard.add((False, doc), terms, impacts)
        rows.append(dict(zip(terms.tolist(), impacts.tolist(), strict=True)))
    tree = ranked.Tree(*shard.row())
    terms, weights = np.array([3, 70, 71, 299], dtype=np.uint64), np.array([5, 1, 1, 9], dtype=np.int64)
    best = ranked.Best(10)
    opened = ranked.best_first(tree, terms, weights, best)
    want = sorted(((sum(w * r.get(t, 0) for t, w in zip(terms.tolist(), weights.tolist(), strict=True)), -i) for i, r in enumerate(rows)), reverse=True)[:10]
    assert sorted(((s, d) for s, _, d in best.heap), reverse=True) == want
    monkeypatch.setattr(ranked, "STEPS", (1, 1))
    strict = ranked.best_first(tree, terms, weights, ranked.Best(10))
    everything = ranked.best_first(tree, terms, weights, ranked.Best(2_000))
    assert strict * 4 < everything
    assert opened <= strict * 5 // 4 + 32


def test_count_of_words_over_slices(monkeypatch):
    from feedlens.llm import textkit

    monkeypatch.setattr(textkit, "CHUNK", 4)
    held = ["", None, "ab  cd", "abcdefgh ijkl mn", "    abcd", "ééé a"]
    assert list(textkit.WordHasher(textkit.PUNCT_BYTES).counts(held)) == [0, 0, 2, 3, 1, 2]
