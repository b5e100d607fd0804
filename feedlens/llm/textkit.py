"""Vectorised word and shingle hashing for batches of texts (numpy, used inside tasks).

Everything here works on one Arrow batch inside a task.  Long texts are read in
slices of bounded size, so the scratch memory does not grow with one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS = tuple(np.ones(1, dtype=np.uint64) for _ in range(2))

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
PUNCT_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, applied to a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of an odd number and of its inverse, for hashes of runs of a sequence."""
    global _POWERS
    if len(_POWERS[0]) < size:
        n = 1 << (size - 1).bit_length()
        _POWERS = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS


class WordHasher:
    """Maps texts to arrays of 64-bit word hashes.

    A-Z are lower-cased.  ``separators`` are the ASCII bytes between words; bytes
    of non-ASCII characters always belong to words.
    """

    def __init__(self, separators: bytes = SPACE_BYTES, chunk: int | None = None) -> None:
        # bytes that are read at once: scratch memory is some fifty times as many
        self._chunk = CHUNK if chunk is None else chunk
        table = np.arange(256, dtype=np.uint8)
        table[0x41:0x5B] += 0x20
        lowered_separators = np.zeros(256, dtype=bool)
        lowered_separators[list(separators)] = True
        self._is_word = ~lowered_separators[table]
        weights = mix64((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))
        self._weight = np.where(self._is_word, weights[table], np.uint64(0))

    def _sums(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word of a buffer of at most a chunk, its weighted sum, start and end."""
        up, down = powers(self._chunk + 1)
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = self._is_word[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self._weight[raw] * up[: len(raw)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * down[starts], starts, ends

    def _long(self, data: bytes) -> np.ndarray:
        """Word hashes of a long text, read in slices; a word that goes on in the next slice is carried over."""
        out, carried, size = [], 0, 0
        for at in range(0, len(data), self._chunk):
            piece = data[at : at + self._chunk]
            sums, starts, ends = self._sums(piece)
            if size and (not len(starts) or starts[0]):
                out.append(np.array([carried], dtype=np.uint64))
                carried, size = 0, 0
            if len(sums):
                if size:
                    sums[0] = (int(sums[0]) * pow(_BASE, size, 1 << 64) + carried) % (1 << 64)
                size = (size if len(sums) == 1 else 0) + int(ends[-1] - starts[-1]) if ends[-1] == len(piece) else 0
                if size:
                    carried, sums = int(sums[-1]), sums[:-1]
                out.append(sums)
        if size:
            out.append(np.array([carried], dtype=np.uint64))
        return mix64(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)

    def words(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """One array of word hashes per text, in order; null is like empty."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            if len(data) >= self._chunk:
                yield from self._flush(held)
                held, size = [], 0
                yield self._long(data)
                continue
            if size + len(data) + 1 > self._chunk:
                yield from self._flush(held)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        yield from self._flush(held)

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        """The number of words of each text, without their hashes."""
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            total, before = 0, False
            for at in range(0, len(data), self._chunk):
                inside = self._is_word[np.frombuffer(data, dtype=np.uint8, count=min(self._chunk, len(data) - at), offset=at)]
                total += int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0] and not before)
                before = bool(inside[-1])
            yield total

    def _flush(self, held: list[bytes]) -> Iterator[np.ndarray]:
        if not held:
            return
        bounds = np.cumsum([0, *(len(x) + 1 for x in held)])
        sums, starts, _ = self._sums(b" ".join(held))
        hashes = mix64(sums)
        cut = np.searchsorted(starts, bounds)
        for i in range(len(held)):
            yield hashes[cut[i] : cut[i + 1]]


_STEP = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles at each position.

    Fewer than k words make one shingle of them all; no words make none.
    """
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix64(np.sum(words * _STEP[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = words[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * _STEP[j]
    return mix64(total)


def short_runs(words: np.ndarray, n: int) -> np.ndarray:
    """At each position the hash that ``shingles`` gives a text of just these n words, fewer than its k."""
    count = len(words) - n + 1
    total = np.full(count, n, dtype=np.uint64)
    for j in range(n):
        total += words[j : count + j] * _STEP[j]
    return mix64(total)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingles(words, k))


class CirculantMinHash:
    """Circulant MinHash: coordinate i is min over the set of pi(sigma(x) + i * step).

    ``sigma`` is one permutation of the hashed universe, ``pi`` a second one; every
    coordinate reuses ``pi``, circularly shifted.  The circle has 2**32 places.
    """

    STEP = np.uint32(0x9E3779B1)

    def __init__(self, coordinates: int) -> None:
        self.shifts = (np.arange(coordinates, dtype=np.uint64) * np.uint64(self.STEP)).astype(np.uint32)

    @staticmethod
    def _sigma(items: np.ndarray) -> np.ndarray:
        return (mix64(items ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _pi(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        return x

    def values(self, items: np.ndarray) -> Iterator[np.ndarray]:
        """For blocks of items, the (coordinates, items) values before the minimum."""
        at = self._sigma(items)
        for i in range(0, len(at), 2048):
            yield self._pi(at[None, i : i + 2048] + self.shifts[:, None])

    def signature(self, items: np.ndarray) -> np.ndarray:
        best = np.full(len(self.shifts), 0xFFFFFFFF, dtype=np.uint32)
        for block in self.values(items):
            np.minimum(best, block.min(axis=1), out=best)
        return best


def batches(rows, text: str = "text", limit: int = 8 << 20) -> Iterator:
    """Splits a pandas batch so that one slice holds about ``limit`` characters at most."""
    sizes = rows[text].str.len().fillna(0).to_numpy(dtype=np.int64)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // limit
    for _, part in rows.groupby(group, sort=True):
        yield part
