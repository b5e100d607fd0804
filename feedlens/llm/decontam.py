"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with the whole of it.
Items are therefore partitioned by size, and each partition is searched in passages of
its own size: windows of twice the partition's upper size, one size apart, so that any
stretch as long as an item lies within one window.  A window's signature comes from block
minima that all partitions share.  An item that shares a signature coordinate with a
window of its partition is a candidate, confirmed by exact containment of its shingles
in the whole document.  Items of few shingles are looked up by each shingle instead, and
items of fewer words than a shingle by their run of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import with_key, without_key
from feedlens.llm.textkit import PUNCT_BYTES, CirculantMinHash, WordHasher, batches, shingle_set, shingles, short_runs

COORDINATES = 48
BLOCK = 16
#: Items of at most so many distinct shingles are looked up exactly.
FEW = 8
#: A block of items that is searched in one pass over the documents.
ITEMS_PER_PASS = 20_000
CHARS_PER_PASS = 32 << 20


class ItemIndex:
    """The items of one pass, by size partition, with their signature coordinates."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int = 5) -> None:
        hasher, self.minhash = WordHasher(PUNCT_BYTES), CirculantMinHash(COORDINATES)
        self.k = k
        words = list(hasher.words(texts))
        sets = [shingle_set(w, k) for w in words]
        self.ids = [i for i, s in zip(ids, sets, strict=True) if len(s)]
        sizes = np.array([len(w) for w, s in zip(words, sets, strict=True) if len(s)], dtype=np.int64)
        self.sets = [s for s in sets if len(s)]
        few = np.array([len(s) <= FEW for s in self.sets], dtype=bool)
        # by the words that a lookup spans, k or fewer, the hashes and their items
        self.exact = []
        for span in range(1, k + 1):
            own = np.flatnonzero(few & (np.minimum(sizes, k) == span))
            if len(own):
                flat, owner = np.concatenate([self.sets[i] for i in own]), np.repeat(own, [len(self.sets[i]) for i in own])
                order = np.argsort(flat, kind="stable")
                self.exact.append((span, flat[order], owner[order]))
        level = [max(0, math.ceil(math.log2(len(s) / BLOCK))) for s in self.sets]
        self.levels = max(level, default=-1) + 1
        place = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[:, None]
        signed = [self.minhash.signature(s).astype(np.uint64)[:, None] | place for s in self.sets]
        keys = np.concatenate(signed, axis=1) if signed else np.zeros((COORDINATES, 0), np.uint64)
        self.by_level = []
        for own in range(self.levels):
            mine = np.flatnonzero((np.array(level) == own) & ~few)
            flat = keys[:, mine].ravel()
            order = np.argsort(flat, kind="stable")
            self.by_level.append((flat[order], np.tile(mine, COORDINATES)[order]))
        self.any = np.zeros(1 << 20, dtype=bool)
        self.any[self._slot((keys[:, ~few] & np.uint64(0xFFFFFFFF)).astype(np.uint32))] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return values * np.uint32(0x9E3779B1) >> np.uint32(12)

    def candidates(self, items: np.ndarray) -> set[int]:
        """Items that share a coordinate with a window of their partition."""
        blocks = []
        for values in self.minhash.values(items):
            short = -values.shape[1] % BLOCK
            if short:
                values = np.pad(values, ((0, 0), (0, short)), constant_values=0xFFFFFFFF)
            blocks.append(values.reshape(len(values), -1, BLOCK).min(axis=2))
        least = np.concatenate(blocks, axis=1)
        if not self.any[self._slot(least)].any():
            return set()
        found: set[int] = set()
        place = (np.arange(len(least), dtype=np.uint64) << np.uint64(32))[:, None]
        for keys, owner in self.by_level:
            window = np.minimum(least[:, :-1], least[:, 1:]) if least.shape[1] > 1 else least
            maybe = self.any[self._slot(window)]
            mine = np.unique((window.astype(np.uint64) | place)[maybe])
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for a, b in zip(lo[lo < hi], hi[lo < hi], strict=True):
                found.update(owner[a:b].tolist())
            if least.shape[1] % 2:
                least = np.pad(least, ((0, 0), (0, 1)), constant_values=0xFFFFFFFF)
            least = np.minimum(least[:, 0::2], least[:, 1::2])
        return found

    def found_exactly(self, words: np.ndarray, items: np.ndarray) -> tuple[set[int], set[int]]:
        """Items of few shingles that share one with the document, and those of fewer than k words that stand in it."""
        some: set[int] = set()
        runs: set[int] = set()
        for span, flat, owner in self.exact:
            if len(words) < span:
                continue
            own = items if span == self.k else short_runs(words, span)
            at = np.searchsorted(flat, own)
            hit = own[flat[np.minimum(at, len(flat) - 1)] == own]
            if len(hit):
                mine = set(owner[np.isin(flat, hit)].tolist())
                if span == self.k:
                    some |= mine
                else:
                    runs |= mine
        return some, runs

    def search(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the document has), exact, for containment at the threshold."""
        items = shingles(words, self.k)
        if not len(items):
            return []
        some, runs = self.found_exactly(words, items)
        found = self.candidates(items) | some
        out = [(self.ids[i], 1, 1) for i in sorted(runs)]
        if not found:
            return out
        whole = np.unique(items)
        for i in sorted(found):
            own = self.sets[i]
            at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            both = int((whole[at] == own).sum())
            if both >= threshold * len(own) - 1e-9:
                out.append((self.ids[i], len(own), both))
        return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment at the threshold.

    Words are runs of letters and digits (any non-ASCII character counts), A-Z lowered.
    Null and word-less documents or items match nothing; fewer than k words are a single
    shingle, and such an item is found wherever its words stand in a row.  The
    items are the query set: passes of bounded size go over all documents.  Repeated
    (doc_id, text) or item rows give repeated pairs; null ids stay null.  Empty tables give
    no rows.  Extra columns are ignored.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, math.ceil(size["n"] / ITEMS_PER_PASS), math.ceil(size["chars"] / CHARS_PER_PASS))
    texts = with_key(docs.select("doc_id", "text"))
    out = None
    for i in range(passes):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").collect()
        index = ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], k)
        found = texts.mapInPandas(_searcher(index, threshold), _FOUND)
        out = found if out is None else out.unionAll(found)
    out = out.withColumn("item_id", F.when(~F.col("no_item"), F.col("item_id"))).drop("no_item")
    return without_key(out).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


_FOUND = "doc_id long, no_id boolean, item_id long, no_item boolean, n_item long, n_shared long"


def _searcher(index: ItemIndex, threshold: float):
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(PUNCT_BYTES)
        for whole in parts:
            for part in batches(whole):
                rows = []
                for doc_id, no_id, words in zip(part["doc_id"], part["no_id"], hasher.words(part["text"].tolist()), strict=True):
                    rows += [(doc_id, no_id, i or 0, i is None, *x) for i, *x in index.search(words, threshold)]
                if rows:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FOUND.split(", ")])

    return search
