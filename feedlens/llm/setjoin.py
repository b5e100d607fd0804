"""Exact Jaccard join of documents' word n-grams over size-banded tiles with hashed bitmaps.

Sizes fall into bands so narrow that linked sets lie in one band or in two neighbouring
ones.  Every set is listed under a prefix of its items in one global order, long enough
that linked sets share a listed item.  The order puts items that many documents hold last;
their counts come from a sketch of fixed size over all documents.  A tile holds the sets of
one item and two neighbouring bands; crowded tiles are cut into pairs of chunks.  Within a
tile, bitmaps to which each item adds one bit's parity bound the overlap of two sets from
above: each bit in which they differ is at least one item that only one of them holds.
What the bound lets pass is confirmed on the full sets.

Equal sets are one class, and before tiles are compared the sets of one item and band
meet the first of them, and in further turns those of each tile meet some of them: sets already connected need no
further comparison, so a group of near copies is not expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import components, with_key, without_key, written
from feedlens.llm.textkit import SPACE_BYTES, WordHasher, batches, mix64, shingle_set

#: Counters of the sketch that ranks items by frequency, and those of one of its rows at most.
COUNTERS = 1 << 20
COUNTERS_ROW = 1 << 16
#: Sets of a chunk of a crowded tile.
CHUNK_SETS = 512
#: Times that the sets of an item meet one of them before tiles are compared.
MEETINGS = 3
#: Sets of a tile that all others of other components meet in each turn but the first.
HOSTS = 8
#: Pairs that are sent whole to the tasks that read the sets, at most (16 bytes each).
BROADCAST_PAIRS = 1 << 18
#: Class ids that a task remembers so as to list a class of copies once.
SEEN = 1 << 18
LEAST_BITS, MOST_BITS = 64, 4096
#: Bytes of text that are hashed at once.
TEXT_CHUNK = 1 << 18

_SIGNED = "doc_id long, no_id boolean, rep long, n long, text_hash long, block int, counts binary"
_LISTED = "item long, rep long, n long"
_SHARED = f"{_LISTED}, band long, leader long"


def bands(percent: int) -> list[int]:
    """The least size of each band: a size links with its own and the next band only.

    Bands are a sixteenth wide at least, so that their number stays small.
    """
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] * 100 // percent, out[-1] * 17 // 16) + 1)
    return out


def _class(items: np.ndarray) -> int:
    return int(mix64(np.sum(mix64(items ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, keepdims=True) + np.uint64(len(items))).view(np.int64)[0])


def _slots(items: np.ndarray, counters: int) -> np.ndarray:
    return ((items >> np.uint64(20)) % np.uint64(counters)).astype(np.int32)


def signed(docs: DataFrame, k: int, counters: int = COUNTERS) -> DataFrame:
    """Per document its class (equal sets share it) and set size; beside them, rows with a sketch of how many documents hold each item.

    A sketch has so many counters a task, whatever it reads.
    """

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, total = WordHasher(SPACE_BYTES, TEXT_CHUNK), np.zeros(counters, dtype=np.int64)
        for whole in parts:
            for part in batches(whole):
                reps, sizes, held = [], [], []
                for words in hasher.words(part["text"].tolist()):
                    items = shingle_set(words, k)
                    reps.append(_class(items))
                    sizes.append(len(items))
                    held.append(_slots(items, counters))
                if held:
                    total += np.bincount(np.concatenate(held), minlength=counters)
                own = part[["doc_id", "no_id", "text_hash"]].reset_index(drop=True)
                yield own.assign(rep=reps, n=sizes, block=pd.array([None] * len(own), dtype="Int32"), counts=None)[[x.split()[0] for x in _SIGNED.split(", ")]]
        for i in range(0, counters, COUNTERS_ROW):
            own = total[i : i + COUNTERS_ROW]
            if own.any():
                yield pd.DataFrame({"doc_id": [0], "no_id": [True], "rep": [0], "n": [0], "text_hash": [0], "block": [i // COUNTERS_ROW], "counts": [own.tobytes()]})

    rows = with_key(docs.select("doc_id", "text")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return written(rows.mapInPandas(sign, _SIGNED), "signed")


def levels(rows: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Per counter the binary logarithm of its sum over all tasks' sketches; a byte a counter comes to the driver."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for block, counts in zip(part["block"].tolist(), part["counts"], strict=True):
                own = np.frombuffer(counts, dtype=np.int64)
                total[block] = total[block] + own if block in total else own
        levels = [np.log2(x + 1).astype(np.uint8).tobytes() for x in total.values()]
        yield pd.DataFrame({"block": pd.array(list(total), dtype="int32"), "levels": levels})

    sums = rows.where("block is not null").select("block", "counts").repartition("block").mapInPandas(add, "block int, levels binary")
    out = np.zeros(counters, dtype=np.uint8)
    for r in sums.collect():
        out[r["block"] * COUNTERS_ROW :][:COUNTERS_ROW] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


def prefixes(docs: DataFrame, level: np.ndarray, percent: int, k: int) -> DataFrame:
    """(item, rep, n): each set's first items, rare counters first, one more than a linked set may lack."""

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = WordHasher(SPACE_BYTES, TEXT_CHUNK), set()
        for whole in parts:
            for part in batches(whole):
                items, reps, sizes, lengths = [np.zeros(0, dtype=np.uint64)], [], [], []
                for words in hasher.words(part["text"].tolist()):
                    own = shingle_set(words, k)
                    if not len(own) or (rep := _class(own)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(rep)
                    first = own[np.argsort(level[_slots(own, len(level))], kind="stable")[: len(own) + (-len(own) * percent // 100) + 1]]
                    items.append(first)
                    reps.append(rep)
                    sizes.append(len(own))
                    lengths.append(len(first))
                flat = np.concatenate(items).view(np.int64)
                yield pd.DataFrame({"item": flat, "rep": np.repeat(np.array(reps, dtype=np.int64), lengths), "n": np.repeat(np.array(sizes, dtype=np.int64), lengths)})

    return docs.select("text").mapInPandas(listed, _LISTED)


def _shared(starts: list[int]):
    """Of rows sorted by item, size and class, those whose item another class lists, with the first class of their item and band."""
    edges = np.array(starts, dtype=np.int64)

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, int, int] | None = None
        given, leader = False, 0
        for part in parts:
            item, rep, n = (part[c].to_numpy(dtype=np.int64) for c in ("item", "rep", "n"))
            if not len(item):
                continue
            if last is not None:
                item, rep, n = (np.concatenate(([x], y)) for x, y in zip(last, (item, rep, n), strict=True))
            new = np.concatenate(([True], (item[1:] != item[:-1]) | (rep[1:] != rep[:-1])))
            item, rep, n = item[new], rep[new], n[new]
            same = item[1:] == item[:-1]
            kept = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            band = np.searchsorted(edges, n, side="right") - 1
            head = np.concatenate(([True], (~same) | (band[1:] != band[:-1])))
            first = rep[np.maximum.accumulate(np.where(head, np.arange(len(item)), 0))]
            if last is not None:
                first[: np.flatnonzero(head)[1] if head.sum() > 1 else len(head)] = leader
                if given:
                    kept[0] = False
            yield pd.DataFrame({"item": item[kept], "rep": rep[kept], "n": n[kept], "band": band[kept], "leader": first[kept]})
            alone = len(item) == 1 and last is not None
            given = given if alone else bool(len(same) and same[-1])
            last, leader = (int(item[-1]), int(rep[-1]), int(n[-1])), int(first[-1])

    return keep


def bit_width(n: int) -> int:
    """Bits of a bitmap: twice the set's size, so that few differences fall on one bit and half-alike sets are told apart, too."""
    return min(max(1 << (2 * n - 1).bit_length(), LEAST_BITS), MOST_BITS)


def bitmap(items: np.ndarray) -> np.ndarray:
    """Parities of the items' hashes, as words of 64 bits."""
    width = bit_width(len(items))
    odd = np.bincount((mix64(items + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A row of bitmaps as narrower ones: the halves' parities add up."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bit counts leave an overlap that links."""
    most = (n_a + n_b - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)) // 2
    return (100 + percent) * most >= percent * (n_a + n_b)


def sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, n, items, bits) of the wanted rows (rep, doc_id, text_hash): sorted items and bitmap."""

    def collect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(SPACE_BYTES, TEXT_CHUNK)
        for whole in parts:
            for part in batches(whole):
                held = [shingle_set(words, k) for words in hasher.words(part["text"].tolist())]
                yield pd.DataFrame(
                    {"rep": part["rep"].to_numpy(), "n": [len(x) for x in held], "items": [x.view(np.int64) for x in held], "bits": [bitmap(x).tobytes() for x in held]}
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = rows.join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "rep").agg(F.first("text").alias("text"))
    return written(rows.select("rep", "text").mapInPandas(collect, "rep long, n long, items array<long>, bits binary"), "sets")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union: by sizes, by bitmaps, then on the full sets."""

    def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kept = np.zeros(len(part), dtype=bool)
            size_a, size_b = part["bits_a"].str.len().to_numpy(dtype=np.int64), part["bits_b"].str.len().to_numpy(dtype=np.int64)
            n_a, n_b = part["n_a"].to_numpy(), part["n_b"].to_numpy()
            for x, y in set(zip(size_a.tolist(), size_b.tolist(), strict=True)):
                at = np.flatnonzero((size_a == x) & (size_b == y))
                words = min(x, y) // 8
                a = folded(np.frombuffer(b"".join(part["bits_a"].iloc[at]), dtype=np.uint64).reshape(len(at), -1), words)
                b = folded(np.frombuffer(b"".join(part["bits_b"].iloc[at]), dtype=np.uint64).reshape(len(at), -1), words)
                kept[at] = may_link(a, b, n_a[at], n_b[at], percent)
            yield part.loc[kept, ["a", "b"]]

    sized = _beside(pairs, held, "n", "bits").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    left = written(sized.mapInPandas(bound, "a long, b long"), "bounded")
    both = F.size(F.array_intersect("items_a", "items_b"))
    rows = _beside(left, held, "items").select("a", "b", both.alias("both"), (F.size("items_a") + F.size("items_b") - both).alias("either"))
    return written(rows.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b"), "links")


def _beside(pairs: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
    """Stored pairs (a, b) with the sets' columns of both.

    Up to BROADCAST_PAIRS pairs are sent to the stored sets, so that only wanted sets are
    shuffled; more pairs are joined by their keys.
    """
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda x: x
    sets_of = {c: held.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]) for c in "ab"}
    left = sets_of["a"].join(few(pairs), "a")
    return left.join(sets_of["b"].join(few(pairs.select("b").distinct()), "b"), "b")


def mixed(rows: DataFrame, placed: DataFrame, *key: str) -> DataFrame:
    """The rows (..., rep, n) of keys that hold several components, with theirs as comp, stored."""
    rows = rows.join(placed.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    several = rows.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*key)
    return written(rows.join(several, list(key)), "mixed")


def meetings(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of a set and those that it meets in this turn: of each tile of mixed rows, HOSTS by the turn's hashes."""
    hosts = [F.min(F.struct(F.xxhash64("rep", F.lit(turn * HOSTS + i)).alias("hash"), "rep", "comp")).alias(f"host{i}") for i in range(HOSTS)]
    found = rows.groupBy("item", "tile").agg(*hosts)
    met = found.select("item", "tile", F.explode(F.array_distinct(F.array(*[f"host{i}" for i in range(HOSTS)]))).alias("host"))
    pairs = rows.join(met.select("item", "tile", F.col("host.rep").alias("met"), F.col("host.comp").alias("met_comp")), ["item", "tile"])
    return pairs.where("comp <> met_comp").select(F.least("rep", "met").alias("a"), F.greatest("rep", "met").alias("b")).distinct()


def _compared(starts: list[int], percent: int):
    """Pairs of different components within each tile of sorted rows that their bitmaps allow to link."""
    edges = np.array(starts, dtype=np.int64)
    names = ["item", "tile", "low", "high"]

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        n, rep, comp, own = (rows[c].to_numpy(dtype=np.int64) for c in ("n", "rep", "comp", "own"))
        tile, apart = rows["tile"].to_numpy(dtype=np.int64), (rows["low"] != rows["high"]).to_numpy()
        change = np.zeros(len(rows), dtype=bool)
        for c in names:
            x = rows[c].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        group, band = np.cumsum(change), np.searchsorted(edges, n, side="right") - 1
        width = np.array([bit_width(int(edges[max(t, 0)])) // 64 for t in tile], dtype=np.int64)
        bits = np.zeros((len(rows), MOST_BITS // 64), dtype=np.uint64)
        sizes = rows["bits"].str.len().to_numpy(dtype=np.int64) // 8
        for x, y in set(zip(sizes.tolist(), width.tolist(), strict=True)):
            at = np.flatnonzero((sizes == x) & (width == y))
            bits[at, :y] = folded(np.frombuffer(b"".join(rows["bits"].iloc[at]), dtype=np.uint64).reshape(len(at), x), y)
        found = []
        here = np.arange(len(rows))
        for step in range(1, len(rows)):
            here = here[here + step < len(rows)]
            here = here[group[here] == group[here + step]]
            if not len(here):
                break
            there = here + step
            fits = (comp[here] != comp[there]) & (100 * n[here] >= percent * n[there]) & (band[here] == tile[here])
            fits &= ~apart[here] | (own[here] != own[there])
            a, b = here[fits], there[fits]
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                good = may_link(bits[x], bits[y], n[x], n[y], percent)
                found.append(np.stack((rep[x[good]], rep[y[good]]), axis=1))
        out = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        out = np.unique(np.sort(out, axis=1), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[names] == rows[names].iloc[-1]).all(axis=1).to_numpy()
            held = rows[last]
            if not last.all():
                yield pairs(rows[~last].reset_index(drop=True))
        if held is not None:
            yield pairs(held.reset_index(drop=True))

    return compare


def tiles(rows: DataFrame, held: DataFrame, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """Mixed rows of tiles with their bitmaps, crowded tiles dealt out as pairs of chunks."""
    chunks = rows.groupBy("item", "tile").agg(F.ceil(F.count("*") / chunk_sets).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = rows.join(chunks, ["item", "tile"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    return dealt.join(held.select("rep", "bits"), "rep").select("item", "tile", "low", "high", "own", "rep", "n", "comp", "bits")


def linked(docs: DataFrame, percent: int = 80, k: int = 5, counters: int = COUNTERS, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """Components of documents (doc_id, text, ...) under Jaccard links of word n-grams: one row per input row.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links of its text
    reach.  Words lie between blanks, A-Z are lower-cased; fewer than k words are one shingle;
    null or word-less texts have none and link with nothing.  A null doc_id has a null
    component and links nothing.  Rows that share a doc_id have the component of their own
    text each.  Repeated rows are all returned; long texts are read whole; an empty table gives no
    rows; extra columns are ignored.  No link is lost but by equal 64-bit hashes of items or sets.
    """
    starts = bands(percent)
    known = signed(docs, k, counters)
    level = levels(known, counters)
    real = known.where("block is null and n > 0 and not no_id")
    named = docs.where(F.col("doc_id").isNotNull())
    rows = prefixes(named, level, percent, k).repartition("item").sortWithinPartitions("item", "n", "rep")
    listed = written(rows.mapInPandas(_shared(starts), _SHARED), "listed")
    first = real.groupBy("rep").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    wanted = listed.select("rep").distinct().join(first, "rep").select("rep", "row.doc_id", "row.text_hash")
    held = sets(named, wanted, k)
    star = written(listed.where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), "star")
    links = confirmed(star, held, percent)
    placed = components(links)
    rows = mixed(listed.select("item", "rep", "n", "band"), placed, "item").select("item", "rep", "n", F.explode(F.array("band", F.col("band") - 1)).alias("tile"))
    rows = mixed(rows, placed, "item", "tile")
    for turn in range(1, MEETINGS):
        met = written(meetings(rows, turn).join(star, ["a", "b"], "left_anti"), "met")
        star = star.union(met)
        placed = components(placed.toDF("a", "b").union(confirmed(met, held, percent)))
        rows = mixed(rows.drop("comp"), placed, "item", "tile")
    keys = ["item", "tile", "low", "high"]
    dealt = tiles(rows, held, chunk_sets).repartition(*keys).sortWithinPartitions(*keys, "n", "rep")
    pairs = dealt.mapInPandas(_compared(starts, percent), "a long, b long").distinct().join(star, ["a", "b"], "left_anti")
    more = confirmed(written(pairs, "pairs"), held, percent)
    closed = components(placed.toDF("a", "b").union(more)).toDF("rep", "label")
    all_rows = without_key(known.where("block is null")).select("doc_id", F.col("n").alias("n_shingles"), "rep")
    labelled = all_rows.join(closed, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    linking = labelled.where("doc_id is not null and n_shingles > 0")
    least = linking.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("label", "least")
    place = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), place)
    return labelled.join(least, "label", "left").select("doc_id", "n_shingles", component.alias("component_id"))
