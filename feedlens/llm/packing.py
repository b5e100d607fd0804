"""Packing documents into training sequences along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions; the Hilbert key of
that point orders the documents, so neighbours on the curve are alike.  Documents are
range-partitioned by the key, laid end to end in that order and cut into sequences.
Offsets over all partitions come from one sum a partition, so only the very last
sequence is short, and it is split into powers of two, which need no padding.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import MOST_BUCKETS, bucket_count, range_bounds, range_bucket, with_key, without_key, written
from feedlens.llm.textkit import batches, mix64, powers

SEQUENCE = 4096
DIMENSIONS = 4
BITS = 10
HASHED = 512
END_ID = 2
ROWS_PER_BUCKET = 20_000
#: Finer ranges, so that tasks can have about equal numbers of tokens.
BUCKETS_PER_TASK = 8
WEIGHED = 256
_CACHED_WORDS = 150_000
#: Characters that are split into words at once; scratch memory is some fifty times as many bytes.
_SLICE = 1 << 18


def laid(store: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of a store that begin at ``first``, end to end."""
    after = np.cumsum(size)
    total = after[-1] if len(after) else 0
    return store[np.arange(total) + np.repeat(first - (after - size), size)]


class WordIds:
    """Ids of words by the words' 64-bit hashes, in order of the hashes."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.first = self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and whether they are held."""
        at = np.searchsorted(self.hashes, hashes)
        held = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        held[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, held

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Adds ascending hashes that aren't held, with their words' ids end to end."""
        at = np.searchsorted(self.hashes, hashes)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.ids = np.concatenate((self.ids, ids))


class WordTokenizer:
    """Ids of whole texts as the ``tokenizers`` model gives them, mostly from remembered words.

    Texts of plain Latin characters are split into the model's words by their characters'
    kinds, a batch at a time; new words are encoded together with the model's ranks (a
    word's end is a byte that such texts don't hold) and remembered.  All other texts, and
    those with control strings, go through the model itself.  The memory has two
    generations of bounded size: when the younger one is full, it becomes the older one.
    """

    _END = "\x01"
    #: Kinds of characters: the model's words are runs of letters, single numbers and runs of others.
    _SPACE, _LETTER, _NUMBER, _OTHER = range(4)
    #: Endings that the model splits off behind an apostrophe.
    _ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        suffix, end = "</w>", self._END.encode()
        ranks = {}
        for token, i in vocabulary.items():
            ended = token.endswith(suffix)
            ranks[bytes(alphabet[c] for c in token.removesuffix(suffix)) + end * ended] = i
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.plain = regex.compile(r"[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*").fullmatch
        self.gap = regex.compile(r"[\t\n\r ]").search
        # a blank, or a place between full-width punctuation and a letter or number: no word holds either
        self.cut = regex.compile(r"[\t\n\r ]|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\p{L}\p{N}])").search
        kinds = [self._SPACE if chr(i).isspace() else {"L": self._LETTER, "N": self._NUMBER}.get(unicodedata.category(chr(i))[0], self._OTHER) for i in range(0x20AD)]
        self.kinds = np.array(kinds, dtype=np.uint8)
        self.weights = mix64(np.arange(1, 0x20AE, dtype=np.uint64))
        self.younger, self.older = WordIds(), WordIds()

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of new words, and the ids end to end."""
        ids = np.array(self.ranks.encode_ordinary(self._END.join(words) + self._END), dtype="<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):
            raise ValueError("the model's words differ from those of the text")
        return np.diff(cut, prepend=0), ids

    def _recall(self, whole: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in the younger memory of the words with these ascending hashes; each stands in ``whole``."""
        if len(self.younger.hashes) > _CACHED_WORDS:
            self.younger, self.older = WordIds(), self.younger
        at, held = self.younger.find(hashes)
        lacking = np.flatnonzero(~held)
        if len(lacking):
            place, kept = self.older.find(hashes[lacking])
            place, again, new = place[kept], lacking[kept], lacking[~kept]
            size = self.older.size[place]
            self.younger.add(hashes[again], size, laid(self.older.ids, self.older.first[place], size))
            if len(new):
                words = [whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
                self.younger.add(hashes[new], *self._encode(words))
            at, _ = self.younger.find(hashes)
        return at

    def _bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words among lower-case characters; the last two characters must be spaces."""
        kind = self.kinds[points]
        start = (kind != self._SPACE) & (kind == self._NUMBER)
        start[0] = kind[0] != self._SPACE
        start[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != self._SPACE)
        quote = np.flatnonzero(start & (points == 0x27))
        quote = quote[kind[quote + 1] == self._LETTER]
        for ending in self._ENDINGS:
            hit = quote
            for j, c in enumerate(ending, 1):
                hit = hit[points[hit + j] == ord(c)]
            start[hit + 1] = False
            after = hit + 1 + len(ending)
            start[after[kind[after] == self._LETTER]] = True
        edge = np.flatnonzero(start | (kind == self._SPACE))
        first = start[edge]
        return edge[first], np.append(edge[1:], len(points))[first]

    def _plain_ids(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces of plain text."""
        whole = "\n".join(pieces) + "\n\n"
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        starts, ends = self._bounds(points)
        up, down = powers(len(points) + 1)
        prefix = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(self.weights[points] * up[: len(points)], out=prefix[1:])
        # words of one hash are the same
        hashes = mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._recall(whole, distinct, starts[first], ends[first])
        own = self.younger.size[at][which]
        ids = laid(self.younger.ids, self.younger.first[at][which], own)
        after = np.cumsum(own)
        cut = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in pieces])[:-1])
        return np.split(ids, np.concatenate(([0], after))[cut])

    def slices(self, text: str) -> Iterator[tuple[int, int]]:
        """Starts and ends of stretches of a text of any script, each of which the model splits into words by itself."""
        at = 0
        while at < len(text):
            gap = self.cut(text, at + _SLICE)
            end = gap.start() if gap else len(text)
            yield at, end
            at = end

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for (i, _), ids in zip(held, self._plain_ids([x for _, x in held]), strict=True):
                    out[i].append(ids)
            held, size = [], 0

        for i, text in enumerate(texts):
            if "<|" in text or not self.plain(text):
                for a, b in self.slices(text):
                    out[i].append(np.array(self.model.encode(text[a:b], add_special_tokens=False).ids, dtype="<u4"))
                continue
            low, at = text.lower(), 0
            while at < len(low):
                # a long text is cut at spaces, which no word holds
                gap = self.gap(low, at + _SLICE)
                end = gap.start() if gap else len(low)
                held.append((i, low[at:end]))
                size += end - at
                at = end
                if size > _SLICE:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, dtype="<u4") for x in out]

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, kept over its tasks."""
    return WordTokenizer(path)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dimensions) below 2**bits (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class CurveProjector:
    """Hashed, signed token counts of documents, projected to a few dimensions and placed on the curve."""

    def __init__(self) -> None:
        self.matrix = np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS))
        self.matrix[HASHED // 2 :] *= -1

    def keys(self, held: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self._keys(held[i : i + 1024]) for i in range(0, len(held), 1024)])

    def _keys(self, held: list[np.ndarray]) -> np.ndarray:
        place = np.concatenate(held).astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(23)
        owner = np.repeat(np.arange(len(held)) * HASHED, [len(x) for x in held])
        counts = np.bincount(owner + place, minlength=len(held) * HASHED).reshape(len(held), HASHED).astype(np.float64)
        counts /= np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        at = 1 / (1 + np.exp(-1.7 * (counts @ self.matrix)))
        return hilbert_keys(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Per document: doc_id, its ids (little-endian 32-bit) with the end id, their number and its place on the curve."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, curve = tokenizer(path), CurveProjector()
        end = np.array([end_id], dtype="<u4")
        for whole in parts:
            for part in batches(whole, limit=2 << 20):
                held = [np.concatenate((x, end)) for x in words.batch([t or "" for t in part["text"]])]
                yield part[["doc_id", "no_id", "tie"]].assign(ids=[x.tobytes() for x in held], tokens=[len(x) for x in held], curve=curve.keys(held))

    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - 63 + DIMENSIONS * BITS)
    rows = with_key(docs.select("doc_id", "text", tie.alias("tie")))
    found = without_key(rows.mapInPandas(encode, "doc_id long, no_id boolean, tie long, ids binary, tokens long, curve long"))
    along = F.shiftleft("curve", 63 - DIMENSIONS * BITS).bitwiseOR(F.col("tie"))
    return found.select("doc_id", "ids", "tokens", along.alias("along"))


def _tail(total: int, size: int) -> list[int]:
    """Ends of the sequences after the last full one: the rest in falling powers of two."""
    at, ends = total - total % size, []
    for bit in range(size.bit_length() - 2, -1, -1):
        if total % size >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


_PIECES = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Packs every document's ids into sequences of at most ``size`` (a power of two) ids.

    Returns one row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, sequence_id and offset.  A null or empty text is the end id
    alone.  Ties on the curve are ordered by a hash of the row; repeated rows are
    documents of their own; an empty table gives no rows.  Long texts
    are tokenized in slices, cut at blanks and behind full-width punctuation; a stretch
    without either is one slice.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(tokenized(docs, path, end_id), "tokens")
    parts = bucket_count(spark, rows.count(), ROWS_PER_BUCKET)
    # a document counts once for every WEIGHED of its tokens, as alike documents are often alike in length, too
    weighed = rows.select("along", F.explode(F.sequence(F.lit(0), (F.col("tokens") / WEIGHED).cast("int"))))
    bounds = range_bounds(weighed, "along", min(BUCKETS_PER_TASK * parts, MOST_BUCKETS))
    found = rows.select("along", "tokens").groupBy(range_bucket(F.col("along"), bounds).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    sums = np.zeros(len(bounds) + 1, dtype=np.int64)
    for r in found.collect():
        sums[r["bucket"]] = r["tokens"]
    ahead, total = np.cumsum(sums) - sums, int(sums.sum())
    # neighbouring buckets of about equal tokens together are one task's
    task = np.minimum(ahead * parts // max(total, 1), parts - 1)
    full, tail = total // size, _tail(total, size)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the worker's tokenizer and its words are used up
        tokenizer.cache_clear()
        bucket, at = None, 0
        ends = np.array(tail, dtype=np.int64)
        for part in parts:
            out = []
            for doc_id, no_id, own, ids in part[["doc_id", "no_id", "bucket", "ids"]].itertuples(index=False, name=None):
                if own != bucket:
                    bucket, at = own, int(ahead[own])
                ids = np.frombuffer(ids, dtype="<u4")
                start = 0
                while start < len(ids):
                    if at < full * size:
                        sequence = at // size
                        first, end = sequence * size, (sequence + 1) * size
                    else:
                        i = int(np.searchsorted(ends, at, side="right"))
                        sequence, first, end = full + i, int(ends[i - 1]) if i else full * size, int(ends[i])
                    length = min(len(ids) - start, end - at)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((doc_id, no_id, start, length, crc, len(ids), sequence, at - first))
                    start += length
                    at += length
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PIECES.split(", ")])

    placed = with_key(rows.withColumns({"bucket": range_bucket(F.col("along"), bounds), "task": range_bucket(F.col("along"), bounds, task)}))
    ordered = placed.repartitionById(parts, F.col("task")).sortWithinPartitions("bucket", "along", "no_id", "doc_id", "ids")
    return without_key(ordered.select("doc_id", "no_id", "bucket", "ids").mapInPandas(cut, _PIECES))
