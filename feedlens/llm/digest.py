"""Improbable-feature digests of documents.

Every 16-byte window of a text gets its entropy; windows of unusual entropy are rare.  In
each run of neighbouring windows the rarest one has a vote; a window with many votes in a
row gives a feature of the text.  A text is read as a circle, so that one rule holds for all lengths.
Features are hashed into a chain of Bloom filters, each holding a bounded number, and two
digests are compared by the overlap of their filters' bits beyond what chance would give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import bucket_count, range_bounds, range_bucket, with_key, without_key
from feedlens.llm.textkit import batches, mix64, powers

WINDOW = 16
NEIGHBOURS = 16
#: Neighbourhoods in a row in which a window must be the rarest; where none is so often, those with most votes count.
POPULAR = 4
FILTER_BITS = 2048
FEATURES_PER_FILTER = 128
PROBES = 5
ROWS_PER_BUCKET = 8_000
_SLICE = 1 << 18

#: Fixed-point k * log2(k), so that entropies do not depend on where a window stands.
_K_LOG_K = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 4096).astype(np.int32)
#: Entropy (fixed point) of usual text, about 3.15 bits a byte in a window of 16.
_USUAL = int(WINDOW * (np.log2(WINDOW) - 3.15) * 4096)
_BYTE_WEIGHTS = mix64(np.arange(1, 257, dtype=np.uint64))


def _entropy_sums(raw: np.ndarray) -> np.ndarray:
    """Sum of k log2 k over the byte counts of each window; low means high entropy."""
    n = len(raw)
    after = np.zeros(n, dtype=np.uint8)
    before = np.zeros(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (raw[d:] == raw[:-d]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    windows = n - WINDOW + 1
    gain = np.diff(_K_LOG_K)
    counts = np.bincount(raw[:WINDOW], minlength=256)
    first = int(_K_LOG_K[counts].sum())
    change = gain[before[WINDOW:]].astype(np.int64) - gain[after[: windows - 1]]
    return np.concatenate(([first], first + np.cumsum(change)))


def _ranked(raw: np.ndarray) -> np.ndarray:
    """Per window its rank (20 bits, rare ones first) and a hash of its content (44 bits), which breaks ties."""
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_WEIGHTS[raw] * up[: len(raw)], out=prefix[1:])
    content = mix64((prefix[WINDOW:] - prefix[:-WINDOW]) * down[: len(raw) - WINDOW + 1])
    unusual = np.abs(_entropy_sums(raw) - _USUAL).astype(np.uint64)
    return (np.uint64((1 << 20) - 1) - unusual) << np.uint64(44) | content >> np.uint64(20)


def _rarest(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest content of each neighbourhood that begins in [begins[i], begins[i] + sizes[i]): runs of equal ones (i, content, votes)."""
    low, span = _ranked(raw), 1
    while span < NEIGHBOURS:
        step = min(span, NEIGHBOURS - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    owner = np.repeat(np.arange(len(sizes)), sizes)
    low = low[np.arange(len(owner)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]
    new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[new], low[new], np.diff(np.append(new, len(low)))


def features(texts: list[str]) -> list[np.ndarray]:
    """Feature hashes of each text, in order and without repeats; only an empty text has none."""
    runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0
    beyond = WINDOW + NEIGHBOURS - 2

    def flush() -> None:
        nonlocal held, size
        if held:
            sizes = np.array([len(x) for _, x in held])
            owner, content, votes = _rarest(np.frombuffer(b"".join(x for _, x in held), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes - beyond)
            cut = np.searchsorted(owner, np.arange(len(held) + 1))
            for i, (own, _) in enumerate(held):
                runs[own].append((content[cut[i] : cut[i + 1]], votes[cut[i] : cut[i + 1]]))
        held, size = [], 0

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if data:
            circle = data + (data * (beyond // len(data) + 1))[:beyond]
            for at in range(0, len(data), _SLICE):
                held.append((i, circle[at : at + _SLICE + beyond]))
                size += len(held[-1][1])
                if size > _SLICE:
                    flush()
    flush()
    return [_popular(x) for x in runs]


def _popular(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not runs:
        return np.zeros(0, dtype=np.uint64)
    content, votes = (np.concatenate(x) for x in zip(*runs, strict=True))
    new = np.flatnonzero(np.concatenate(([True], content[1:] != content[:-1])))
    content, votes = content[new], np.add.reduceat(votes, new)
    chosen = content[votes >= min(POPULAR, votes.max())]
    return mix64(chosen[np.sort(np.unique(chosen, return_index=True)[1])])


def digests(texts: list[str]) -> list[np.ndarray]:
    """Each text's chain of Bloom filters, shape (filters, FILTER_BITS / 64)."""
    return [_chain(x) for x in features(texts)]


def _chain(found: np.ndarray) -> np.ndarray:
    filters = np.zeros(((len(found) + FEATURES_PER_FILTER - 1) // FEATURES_PER_FILTER, FILTER_BITS // 64), dtype=np.uint64)
    shift = np.arange(0, 11 * PROBES, 11, dtype=np.uint64)[:, None]
    bit = (found[None, :] >> shift & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    owner = np.broadcast_to(np.arange(len(found)) // FEATURES_PER_FILTER, bit.shape)
    np.bitwise_or.at(filters, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return filters


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two digests, 0 to 1; equal digests give 1, an empty one and another 0.

    Each filter of the shorter digest is matched with its best partner in the longer one;
    overlap up to what random filters of these weights share counts as none.  The mean
    is weighted by set bits and scaled by how much of the longer digest that covers.
    """
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    weight_a, weight_b = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    total = 0.0
    for row, own in zip(a, weight_a, strict=True):
        both = np.bitwise_count(b & row).sum(axis=1).astype(float)
        chance = own * weight_b / FILTER_BITS
        most = np.minimum(own, weight_b)
        best = np.clip((both - chance - 2 * np.sqrt(chance)) / np.maximum(most - chance, 1), 0, 1)
        total += own * float((best * most / np.maximum(own, weight_b)).max())
    return min(1.0, total / max(weight_a.sum(), weight_b.sum()))


def to_text(filters: np.ndarray) -> str:
    return filters.astype("<u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = (
    "doc_id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of each document and of its edited text, and their likeness to it and to the next document.

    The next document is the one with the following doc_id, and the first after the last;
    a lone document is its own.  A null text is empty and has the empty digest.  Null
    doc_ids come first; rows with equal doc_ids are ordered by their texts; an empty table
    gives no rows.  Texts of all lengths follow one rule, long ones in slices.  Extra
    columns are ignored.

    Documents are range-partitioned by doc_id; the first document of each range is also
    sent to the range before, so each task sees its successor without a global order.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = with_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("at", F.when(F.col("no_id"), F.lit(lowest)).otherwise(F.col("doc_id")))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("at"))
    buckets = bucket_count(spark, ids.count(), ROWS_PER_BUCKET)
    bounds = range_bounds(ids, "at", buckets)
    firsts = ids.groupBy(range_bucket(F.col("at"), bounds).alias("bucket")).agg(F.min("at").alias("at")).orderBy("bucket").collect()
    before = {r["at"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    # at most MOST_BUCKETS rows
    heads = spark.createDataFrame([(k, v) for k, v in before.items()] or [(None, None)], "at long, ahead int")
    own = F.struct(range_bucket(F.col("at"), bounds).alias("bucket"), F.lit(0).alias("copy"))
    sent = F.when(F.col("ahead").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("ahead").alias("bucket"), F.lit(1).alias("copy"))))
    dealt = rows.join(F.broadcast(heads), "at", "left").select("doc_id", "no_id", "at", "text", F.inline(sent))
    ordered = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "copy", "at", "text")
    return without_key(ordered.select("bucket", "copy", "doc_id", "no_id", "text").mapInPandas(_compare, _OUT))


def _compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each row with the next one of its bucket; of the copies that end a bucket only the first counts."""
    last: list[tuple] = []
    for whole in parts:
        for part in batches(whole):
            rows = list(part[["bucket", "copy", "doc_id", "text", "no_id"]].itertuples(index=False, name=None))
            own = digests([x[3] for x in rows])
            rows = last + [(*x, y) for x, y in zip(rows, own, strict=True)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            other = digests(changed)
            yield pd.DataFrame(
                {
                    "doc_id": np.array([a[2] for a, _ in pairs], dtype=np.int64),
                    "no_id": np.array([a[4] for a, _ in pairs], dtype=bool),
                    "n_chars": [len(a[3]) for a, _ in pairs],
                    "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed],
                    "fingerprint": [to_text(a[5]) for a, _ in pairs],
                    "edited_fingerprint": [to_text(x) for x in other],
                    "near_edited": [likeness(a[5], x) for (a, _), x in zip(pairs, other, strict=True)],
                    "near_next": [likeness(a[5], b[5]) for a, b in pairs],
                }
            )
            last = rows[-1:]
