"""Ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

A shard's postings stand in one sequence: term by term, each term's by falling impact.
A wavelet tree over the documents' numbers (rising with doc_id) holds that sequence, so a
term's postings can be met in both orders: a node of the tree stands for a range of
documents, the term's postings in it are an interval, and the interval's first one has the
greatest impact.  The sum of these first impacts bounds the score of every document below
a node.  A query starts with its terms' intervals at the root, opens the nodes of the
greatest bounds first, and stops when no bound can reach its k-th document.

Shards are cut where documents are read, without a shuffle, and stored as a table that
serves any number of queries.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.llm.shared import tables_dir, with_key, without_key, written
from feedlens.llm.textkit import PUNCT_BYTES, WordHasher, batches

#: Postings of a shard, unless one document alone has more.
SHARD_POSTINGS = 1 << 20
#: Terms of the queries that are answered in one pass over the index.
BLOCK_TERMS = 1 << 17
#: Nodes that are opened together at least, and at most; between them, an eighth of those opened so far.
STEPS = (16, 512)
SCALE = 1000
SHARDS = "docs binary, unnamed binary, terms binary, starts binary, impacts binary, bits binary"


@dataclass(frozen=True)
class Corpus:
    """Documents with terms, and all their terms with repeats."""

    documents: int
    terms: int

    def spread(self, length: int) -> int:
        """What a document's length does to its impacts."""
        return 100 - 75 + (75 * length * self.documents) // self.terms

    def weight(self, holding: int) -> int:
        return math.floor(SCALE * math.log((2 * self.documents + 2) / (2 * holding + 1)))


def corpus(docs: DataFrame) -> Corpus:
    """Counts over all documents; one pair of sums a batch leaves Python."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(PUNCT_BYTES)
        for whole in parts:
            sizes = np.array([n for part in batches(whole) for n in hasher.counts(part["text"].tolist())], dtype=np.int64)
            yield pd.DataFrame({"documents": [int((sizes > 0).sum())], "terms": [int(sizes.sum())]})

    found = docs.select("text").mapInPandas(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Corpus(found[0] or 0, found[1] or 0)


def tree_bits(numbers: np.ndarray, depth: int) -> list[np.ndarray]:
    """The bits of a wavelet tree, a level at a time: a level keeps the order of the one above, zeros before ones."""
    out = []
    for level in range(depth - 1, -1, -1):
        bits = (numbers >> level) & 1
        out.append(bits.astype(bool))
        numbers = np.concatenate((numbers[bits == 0], numbers[bits == 1]))
    return out


def _depth(documents: int) -> int:
    return max(1, (documents - 1).bit_length())


class _Shard:
    """Documents on their way into one shard."""

    def __init__(self) -> None:
        self.keys: list[tuple[bool, int]] = []
        self.terms: list[np.ndarray] = []
        self.impacts: list[np.ndarray] = []
        self.postings = 0

    def add(self, key: tuple[bool, int], terms: np.ndarray, impacts: np.ndarray) -> None:
        self.keys.append(key)
        self.terms.append(terms)
        self.impacts.append(impacts)
        self.postings += len(terms)

    def row(self) -> tuple:
        order = sorted(range(len(self.keys)), key=self.keys.__getitem__)
        sizes = [len(self.terms[i]) for i in order]
        numbers = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        terms, impacts = np.concatenate([self.terms[i] for i in order]), np.concatenate([self.impacts[i] for i in order])
        place = np.lexsort((numbers, -impacts, terms))
        numbers, terms, impacts = numbers[place], terms[place], impacts[place]
        starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
        bits = np.concatenate(tree_bits(numbers, _depth(len(order))))
        held = [self.keys[i] for i in order]
        return (
            np.array([k for _, k in held], dtype=np.int64).tobytes(),
            np.packbits(np.array([no for no, _ in held])).tobytes(),
            terms[starts].tobytes(),
            np.append(starts, len(terms)).astype(np.int64).tobytes(),
            impacts.astype(np.int32).tobytes(),
            np.packbits(bits).tobytes(),
        )


def index(docs: DataFrame, totals: Corpus, postings: int = SHARD_POSTINGS) -> DataFrame:
    """Stored shards of documents (doc_id, text): every document with a term is in one.

    A task keeps the documents of one shard at a time.
    """

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, shard = WordHasher(PUNCT_BYTES), _Shard()
        columns = [x.split()[0] for x in SHARDS.split(", ")]
        for whole in parts:
            for part in batches(whole):
                keys = zip(part["no_id"].tolist(), part["doc_id"].tolist(), strict=True)
                for key, words in zip(keys, hasher.words(part["text"].tolist()), strict=True):
                    if not len(words):
                        continue
                    terms, tf = np.unique(words, return_counts=True)
                    if shard.postings and shard.postings + len(terms) > postings:
                        yield pd.DataFrame([shard.row()], columns=columns)
                        shard = _Shard()
                    shard.add(key, terms, (SCALE**3 * tf.astype(np.int64)) // (SCALE * tf + 8 * totals.spread(len(words))))
        if shard.postings:
            yield pd.DataFrame([shard.row()], columns=columns)

    return written(with_key(docs.select("doc_id", "text")).mapInPandas(build, SHARDS), "shards")


class Tree:
    """One shard, opened: per level the ones before each place and the impacts."""

    def __init__(self, docs: bytes, unnamed: bytes, terms: bytes, starts: bytes, impacts: bytes, bits: bytes) -> None:
        self.docs = np.frombuffer(docs, dtype=np.int64)
        self.unnamed = np.unpackbits(np.frombuffer(unnamed, dtype=np.uint8), count=len(self.docs)).astype(bool)
        self.terms, self.starts = np.frombuffer(terms, dtype=np.uint64), np.frombuffer(starts, dtype=np.int64)
        self.depth = _depth(len(self.docs))
        now = np.frombuffer(impacts, dtype=np.int32)
        n = len(now)
        flat = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n * self.depth).reshape(self.depth, n)
        self.ones = np.zeros((self.depth, n + 1), dtype=np.int32)
        self.impacts = np.zeros((self.depth + 1, n + 1), dtype=np.int32)
        for level in range(self.depth):
            self.impacts[level, :n] = now
            np.cumsum(flat[level], out=self.ones[level, 1:])
            now = np.concatenate((now[flat[level] == 0], now[flat[level] == 1]))
        self.impacts[self.depth, :n] = now
        self.zeros = n - self.ones[:, -1]

    def intervals(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of sorted terms stand at the root; empty for a term that no document holds."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return np.where(known, self.starts[at], 0), np.where(known, self.starts[at + 1], 0)

    def children(self, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of nodes (rows) and their terms' intervals (columns), the intervals of the zero and the one child."""
        a, b = self.ones[level[:, None], low], self.ones[level[:, None], high]
        base = self.zeros[level][:, None]
        return low - a, high - b, base + a, base + b

    def bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The greatest score that a document below each node can have; at the last level its score."""
        first = np.where(high > low, self.impacts[level[:, None], low], 0)
        return first.astype(np.int64) @ weights


class Best:
    """The best k of what has been offered, equal scores by rising doc_id, unnamed documents last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.heap: list[tuple[int, bool, int]] = []

    def least(self) -> tuple[int, bool, int]:
        """What an offer must exceed."""
        return self.heap[0] if len(self.heap) == self.k else (0, True, 0)

    def offer(self, score: int, unnamed: bool, doc: int) -> None:
        row = (score, not unnamed, -doc)
        if score <= 0:
            return
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, row)
        elif row > self.heap[0]:
            heapq.heapreplace(self.heap, row)


def best_first(tree: Tree, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offers the shard's documents that can be among the best; returns how many nodes were opened."""
    low, high = tree.intervals(terms)
    here = high > low
    if not here.any():
        return 0
    low, high, weights = low[here][None, :], high[here][None, :], weights[here]
    level, number = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    bound = tree.bounds(level, low, high, weights)
    opened = 0
    while len(bound):
        least = best.least()
        # a node whose bound only equals the k-th score counts if its first document stands before the k-th one
        first = np.minimum(number << (tree.depth - level), len(tree.docs) - 1)
        hope = (bound > least[0]) | ((bound == least[0]) & (bound > 0) & ((~tree.unnamed[first] > least[1]) | ((~tree.unnamed[first] == least[1]) & (-tree.docs[first] > least[2]))))
        if not hope.any():
            break
        level, number, low, high, bound = level[hope], number[hope], low[hope], high[hope], bound[hope]
        step = min(max(STEPS[0], opened // 8), STEPS[1])
        if len(bound) > step:
            top = np.argpartition(-bound, step)
            now, later = top[:step], top[step:]
        else:
            now, later = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
        opened += len(now)
        a, b, c, d = tree.children(level[now], low[now], high[now])
        below, twin = np.repeat(level[now] + 1, 2), np.repeat(number[now] * 2, 2)
        twin[1::2] += 1
        lows, highs = np.stack((a, c), axis=1).reshape(-1, a.shape[1]), np.stack((b, d), axis=1).reshape(-1, a.shape[1])
        bounds = tree.bounds(below, lows, highs, weights)
        leaf = (below == tree.depth) & (bounds > 0)
        for score, doc in zip(bounds[leaf].tolist(), twin[leaf].tolist(), strict=True):
            best.offer(score, bool(tree.unnamed[doc]), int(tree.docs[doc]))
        inner = (below < tree.depth) & (bounds > 0)
        level, number = np.concatenate((level[later], below[inner])), np.concatenate((number[later], twin[inner]))
        low, high = np.concatenate((low[later], lows[inner])), np.concatenate((high[later], highs[inner]))
        bound = np.concatenate((bound[later], bounds[inner]))
    return opened


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, terms, times): per row of items its distinct terms, sorted, and how often each stands in it."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(PUNCT_BYTES)
        for part in parts:
            held = [np.unique(words, return_counts=True) for words in hasher.words(part["text"].tolist())]
            yield pd.DataFrame(
                {"item_id": part["item_id"].to_numpy(), "no_id": part["no_id"].to_numpy(), "terms": [t.view(np.int64) for t, _ in held], "times": [n.astype(np.int64) for _, n in held]}
            )

    rows = with_key(items.select("item_id", "text"), "item_id")
    return rows.mapInPandas(split, "item_id long, no_id boolean, terms array<long>, times array<long>").where(F.size("terms") > 0)


def _blocks(items: DataFrame, most: int) -> Iterator[list]:
    """Rows of query_terms in blocks of at most so many terms (or one row), one block at a time on the driver."""
    held, size = [], 0
    for row in query_terms(items).toLocalIterator():
        if held and size + len(row["terms"]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield held


def _holding(shards: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each of the terms stands: the lengths of its lists, over all shards."""

    def lengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for part in parts:
            for terms, starts in zip(part["terms"], part["starts"], strict=True):
                terms, starts = np.frombuffer(terms, dtype=np.uint64), np.frombuffer(starts, dtype=np.int64)
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[at] == wanted, starts[at + 1] - starts[at], 0)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"number": held, "holding": total[held]})

    rows = shards.select("terms", "starts").mapInPandas(lengths, "number long, holding long").groupBy("number").agg(F.sum("holding").alias("holding"))
    return {int(wanted[r["number"]]): r["holding"] for r in rows.collect()}


def _answered(shards: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(number, doc_id, no_id, score): per task and query its k best documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in queries]
        for part in parts:
            for row in part.itertuples(index=False, name=None):
                tree = Tree(*row)
                for (terms, weights), held in zip(queries, best, strict=True):
                    best_first(tree, terms, weights, held)
        rows = [(i, -doc, not named, score) for i, held in enumerate(best) for score, named, doc in held.heap]
        yield pd.DataFrame(rows, columns=["number", "doc_id", "no_id", "score"]).astype({"number": "int64", "doc_id": "int64", "no_id": "bool", "score": "int64"})

    return shards.select(*[x.split()[0] for x in SHARDS.split(", ")]).mapInPandas(run, "number long, doc_id long, no_id boolean, score long")


HITS = "item_id long, no_item boolean, rank int, doc_id long, no_id boolean, score long"


def search(shards: DataFrame, totals: Corpus, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each row of items (item_id, text).

    Queries are taken in blocks of bounded size, each of which is sent to the tasks that
    read the index; a task hands on its k best a query.  Equal scores rank by doc_id, rows
    without one last.  Repeated items are answered each, repeated documents rank each; null and
    term-less texts, of items or documents, are in no answer; empty tables give no rows; long texts
    are read whole; extra columns are ignored.
    """
    spark: SparkSession = shards.sparkSession
    path = f"{tables_dir(spark)}/hits-{uuid.uuid4().hex}"
    spark.createDataFrame([], HITS).write.parquet(path)
    for rows in _blocks(items, block_terms):
        wanted = np.unique(np.concatenate([np.array(r["terms"], dtype=np.int64).view(np.uint64) for r in rows]))
        holding = _holding(shards, wanted)
        queries = []
        for r in rows:
            terms, times = np.array(r["terms"], dtype=np.int64).view(np.uint64), np.array(r["times"], dtype=np.int64)
            weights = times * np.array([totals.weight(holding[t]) if t in holding else 0 for t in terms.tolist()], dtype=np.int64)
            queries.append((terms[weights > 0], weights[weights > 0]))
        found = _answered(shards, queries, k)
        by_score = Window.partitionBy("number").orderBy(F.desc("score"), "no_id", "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"], r["no_id"]) for i, r in enumerate(rows)], "number long, item_id long, no_item boolean")
        ranked.join(names, "number").select("item_id", "no_item", "rank", "doc_id", "no_id", "score").write.mode("append").parquet(path)
    named = F.when(~F.col("no_item"), F.col("item_id")).alias("item_id")
    return without_key(spark.read.schema(HITS).parquet(path)).select(named, "rank", "doc_id", "score")
