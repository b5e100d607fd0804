"""The n-gram join against all pairs: crowded tiles, chunks, coarse sketches, batches that cut groups."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from feedlens.llm import setjoin

from .fixtures import SPACE_WORD, changed, frame, prose, texts, words_of


def shingles(text, k):
    words = words_of(text, SPACE_WORD)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain(rows, percent, k):
    """Sorted (doc_id, n_shingles, component_id); rows of one doc_id and different texts are apart."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), None if doc is None else least[find(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    common = prose(7, 70)
    out = [x for x in texts() if x[0] not in (307,)]
    out += [(1_000 + i, f"{prose(900 + i, 4)} {common}") for i in range(50)]
    out += [(1_100 + i, f"{prose(960 + i, 9)} {common} {prose(990 + i, 9)}") for i in range(30)]
    out += [(1_200 + i, f"{prose(3_000 + i, 200)} {common}") for i in range(40)]
    base = prose(8, 900)
    out += [(2_000 + i, changed(base, 40 + i, 6 + i % 25)) for i in range(60)]
    return out + [(10, "another text of a known id here"), (2_000, "another text of a known id here")]


@pytest.mark.parametrize("percent,k,chunk,counters", [(85, 4, 512, 1 << 20), (85, 4, 5, 64), (80, 5, 9, 1 << 10), (100, 4, 512, 1 << 20)])
def test_against_all_pairs(spark, rows, percent, k, chunk, counters):
    docs = frame(spark, rows).repartition(6)
    assert sorted(map(tuple, setjoin.linked(docs, percent, k, counters, chunk).collect()), key=repr) == plain(rows, percent, k)


def test_bands_hold_linked_sizes():
    starts = np.array(setjoin.bands(85))
    for n in [*range(1, 3_000), 10**6, 10**9 + 7]:
        band = np.searchsorted(starts, n, side="right")
        assert np.searchsorted(starts, n * 100 // 85, side="right") <= band + 1
        assert 100 * starts[band - 1] >= 85 * n


def test_bits_never_refuse_a_link():
    pick = random.Random(2)
    for _ in range(300):
        n = pick.choice([1, 5, 40, 130, 700, 5_000])
        both = {pick.randrange(1 << 62) for _ in range(n)}
        a, b = (np.array(sorted(both | {pick.randrange(1 << 62) for _ in range(pick.randrange(n // 5 + 1))}), dtype=np.uint64) for _ in "ab")
        x, y = setjoin.bitmap(a)[None, :], setjoin.bitmap(b)[None, :]
        words = min(x.shape[1], y.shape[1])
        overlap = len(np.intersect1d(a, b))
        linked = 100 * overlap >= 85 * (len(a) + len(b) - overlap)
        passed = setjoin.may_link(setjoin.folded(x, words), setjoin.folded(y, words), np.array([len(a)]), np.array([len(b)]), 85)[0]
        assert passed or not linked


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1_000])
def test_shared_items_over_batches(size):
    pick = random.Random(4)
    rows = sorted((pick.randrange(40), n, n * 1_000 + pick.randrange(3)) for n in (pick.randrange(1, 30) for _ in range(200)))
    rows += [rows[-1]]
    frame_ = pd.DataFrame(rows, columns=["item", "n", "rep"])
    parts = [frame_.iloc[i : i + size] for i in range(0, len(rows), size)]
    starts = setjoin.bands(85)
    found = pd.concat(list(setjoin._shared(starts)(iter(parts))))
    band = lambda n: int(np.searchsorted(starts, n, side="right"))
    distinct = sorted(set(rows))
    want = []
    for item, n, rep in distinct:
        own = [x for x in distinct if x[0] == item]
        if len(own) > 1:
            want.append((item, rep, n, next(x[2] for x in own if band(x[1]) == band(n))))
    assert list(found[["item", "rep", "n", "leader"]].itertuples(index=False, name=None)) == want


def test_empty_and_unnamed(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, setjoin.linked(docs, 85, 4).collect()), key=repr) == sorted([(None, 2, None)] * 2 + [(1, 0, 1), (2, 0, 2)], key=repr)
