"""Language identification with language-bitmask n-gram filters.

Training keeps, per language, the letter trigrams that most of its documents hold.  One
bit-sliced Bloom filter answers for all languages at once: each slot is a bitmask with a
bit per language, and the AND of a trigram's slots is the mask of the languages that
(probably) contain it.  Per-language popcounts over a text, corrected for each language's
false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.textkit import batches, mix64

#: Labelled documents learnt from, per language; the only bound on what is read.
TRAIN_ROWS_PER_LANGUAGE = 4000
#: Trigrams kept per language, the ones found in most of its documents.
PROFILE_SIZE = 3000
#: A trigram in a smaller share of a language's sample is noise.
LEAST_SHARE = 0.02
SLOTS_PER_GRAM = 12
PROBES = 2
UNKNOWN = "und"
_SLICE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams around each letter (word ends count as a space), and each one's text.

    A text's first and last character only lend their context.
    """
    table = _letters()
    points = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    low = table[points].astype(np.uint64)
    padded = np.concatenate(([0], low, [0])).astype(np.uint64)
    inner = np.ones(len(low), dtype=bool)
    ends = np.cumsum(sizes) - 2
    inner[ends] = inner[ends + 2 - sizes] = False
    here = np.flatnonzero((low > 0) & inner)
    gram = padded[here] << np.uint64(42) | low[here] << np.uint64(21) | padded[here + 2]
    return mix64(gram), owner[here]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in groups of about one slice, with a character of context (at the ends a space) on either side; long ones are cut."""
    held: list[str] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text)), _SLICE):
            piece = (text[at - 1] if at else " ") + text[at : at + _SLICE] + (text[at + _SLICE] if at + _SLICE < len(text) else " ")
            if size + len(piece) > _SLICE and held:
                yield np.array(owner), held
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(i)
            size += len(piece) + 1
    if held:
        yield np.array(owner), held


@dataclass
class LanguageFilter:
    """The bit-sliced filter: ``slots[s]`` has a bit for each language, in words of 64."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def build(languages: list[str], grams: list[np.ndarray]) -> LanguageFilter:
        longest = max((len(g) for g in grams), default=1)
        size = 1 << int(np.ceil(np.log2(max(64, SLOTS_PER_GRAM * longest))))
        slots = np.zeros((size, (len(languages) + 63) // 64), dtype=np.uint64)
        fill = np.zeros(len(languages))
        for i, own in enumerate(grams):
            places = np.unique(_places(own, size))
            slots[places, i // 64] |= np.uint64(1 << (i % 64))
            fill[i] = len(places) / size
        return LanguageFilter(languages, slots, fill**PROBES)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        places = _places(grams, len(self.slots))
        out = self.slots[places[0]]
        for p in places[1:]:
            out = out & self.slots[p]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (share of trigrams that it is estimated to know) of each text."""
        total = np.zeros(len(texts), dtype=np.int64)
        hits = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for owner, pieces in _pieces(texts):
            grams, piece = _grams(pieces)
            text = owner[piece]
            total += np.bincount(text, minlength=len(texts))
            masks = self.masks(grams) if self.languages else None
            for i in range(len(self.languages)):
                bit = masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)
                hits[:, i] += np.bincount(text[bit.astype(bool)], minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = (hits - total[:, None] * self.false_positive) / (1 - self.false_positive)
        share = np.clip(known / np.maximum(total, 1)[:, None], 0, 1)
        best = share.argmax(axis=1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)]
        return names, np.where(total > 0, share[np.arange(len(texts)), best], 0.0)


def _places(grams: np.ndarray, size: int) -> np.ndarray:
    first, second = grams >> np.uint64(32), grams | np.uint64(1)
    return np.stack([((first + np.uint64(j) * second) & np.uint64(size - 1)).astype(np.int64) for j in range(PROBES)])


def train(labelled: DataFrame, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, profile: int = PROFILE_SIZE) -> LanguageFilter:
    """Learns from rows (doc_id, text, lang); rows without text or lang teach nothing.

    Reads at most about ``rows_per_language`` documents a language, chosen by a hash of
    doc_id.  What comes to the driver is ``profile`` trigrams a language.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilter.build([], [])
    shares = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, rows_per_language / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < F.element_at(shares, F.col("lang"))).select("text", "lang")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for part in batches(whole, limit=4 << 20):
                for lang, own in part.groupby("lang"):
                    found = []
                    for owner, pieces in _pieces(own["text"].tolist()):
                        grams, piece = _grams(pieces)
                        # one sortable number a pair of text and trigram; two pairs of one number would cost one count
                        mixed, first = np.unique(mix64(grams + owner[piece].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                        found.append((mixed, grams[first]))
                    _, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
                    gram, df = np.unique(np.concatenate([x for _, x in found])[first], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "df": df.astype(np.int64)})

    found = sample.mapInPandas(count, "lang string, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "gram")))
    known = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, float(min(n, rows_per_language)))])
    common = F.col("df") >= LEAST_SHARE * F.element_at(known, F.col("lang"))
    kept = ranked.where((F.col("place") <= profile) & common).select("lang", "gram").toPandas()
    names = sorted(kept["lang"].unique())
    return LanguageFilter.build(names, [kept.loc[kept["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in names])


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to documents, from the whole text alone.

    Null and empty texts, and those without letters, are ``und`` with score 0; long texts
    are read whole, in slices; of languages with equal scores the first by name is taken;
    every row of repeated rows, and none of an empty table, is returned.  Other columns
    stay, but a column named lang_pred or score (in any case) is replaced.
    """
    docs = docs.drop("lang_pred", "score")
    held = next(x for x in (f"_found{i or ''}" for i in range(len(docs.columns) + 1)) if x not in {c.lower() for c in docs.columns})
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(out)
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.withColumn(held, predict("text"))
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns], f"{held}.lang_pred", f"{held}.score")
