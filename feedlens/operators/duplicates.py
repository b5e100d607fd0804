"""Articles that are the same: similar titles on one host, with equal or similar paths.

The similarity is Ratcliff and Obershelp's, which no built-in function computes.  Twice the
characters that it matches, over both lengths, is at most twice the longest common
subsequence over both lengths, and texts that reach the threshold share many pairs of
neighbouring characters.  The ratio is computed only for what passes these bounds.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions.text import plain_title

TITLE = 0.85
PATH = 0.8


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(url.contains("://"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1))


def _share(at_least: float) -> float:
    """Shared pairs of characters over both lengths: a character that only one text has breaks three halves of a pair."""
    return max(0.5 - 1.5 * (1 - at_least), 0.0)


#: Texts of a group that are compared where they meet, and about as many in each part of a larger group.
TILE = 4096
#: Small groups come in so many batches.
SMALL = 256
#: Texts compared with as many others at once, and pairs whose subsequences are found at once.
_BLOCK = 512
_PAIRS = 1 << 16
#: Longer texts have their length as bound of what is common.
_LONG = 1024
#: Characters are told apart by so many codes; equal codes of different ones only raise a bound.
_CODES = 128


def candidates(texts: DataFrame, at_least: float) -> DataFrame:
    """Pairs (group, text1, text2), text1 < text2, of distinct texts (group, text) that may reach the ratio.

    No pair that reaches it is missing.  All texts of a group are compared, by bounds on
    their characters, on their pairs of these and on their longest common subsequence, in
    tiles of two parts of the group, and only pairs that pass all of them leave a tile.
    """
    share = _share(at_least)
    rows = texts.select("group", "text").distinct().where(F.length("text") > 0)
    sizes = rows.groupBy("group").agg(F.count("*").alias("texts"), F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    dealt = rows.join(sizes.where("texts > 1"), "group").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    # small groups come together, as each call has its cost
    tiles = tiles.withColumn("place", F.xxhash64("group", "lo", "hi"))
    tiles = tiles.withColumn("tile", F.when(F.col("parts") > 1, F.col("place")).otherwise(F.pmod("place", F.lit(SMALL))))
    kind = texts.schema["group"].dataType.simpleString()
    return tiles.groupBy("tile").applyInPandas(_near(at_least, share), f"`group` {kind}, text1 string, text2 string")


def _near(at_least: float, share: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        # by hashes, as pandas takes strings to end at a zero character
        for _, own in rows.groupby("place", sort=False):
            if len(own) < 2:
                continue
            group, lo, hi = own[["group", "lo", "hi"]].iloc[0]
            own = own.assign(n=own["text"].str.len()).sort_values("n", kind="stable")
            texts = _Texts(own["text"].tolist())
            left, right = texts.near(at_least, share, own["part"].to_numpy() if lo < hi else None)
            names = own["text"].to_numpy()
            x, y = names[left], names[right]
            turned = x > y
            found.append(pd.DataFrame({"group": group, "text1": np.where(turned, y, x), "text2": np.where(turned, x, y)}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"group": [], "text1": [], "text2": []}, dtype="object")

    return run


class _Texts:
    """Some texts' characters end to end, as codes."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(x) for x in texts], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        ranks = np.unique(points, return_inverse=True)[1]
        self.points, self.codes = ranks.astype(np.int64), ranks % _CODES

    def _bits(self, what: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
        """Bits of each text's set of things, the second of a kind being another one than the first, and so on.

        They differ in no more places than the sets do.
        """
        order = np.lexsort((what, owner))
        own, kind = owner[order], what[order]
        at = np.arange(len(order))
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]))) if len(order) else np.zeros(0, dtype=bool)
        times = at - np.maximum.accumulate(np.where(new, at, 0))
        place = ((kind * 1_000_003 + times).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        place = place.astype(np.int64) % (64 * words)
        out = np.zeros(len(self.sizes) * words, dtype=np.uint64)
        np.bitwise_xor.at(out, own * words + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
        return out.reshape(-1, words)

    def near(self, at_least: float, share: float, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of texts (in the order of their sizes), of different parts if these are given, that pass the bounds."""
        n, sizes = len(self.sizes), self.sizes
        letters = self._bits(self.points, self.owner, 2).T.copy()
        inside = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        pairs = self._bits(self.points[inside] * (1 << 21) + self.points[inside + 1], self.owner[inside], 4)
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        slack = ((1 - at_least) * sizes).astype(np.float32)
        for lo in range(0, n, _BLOCK):
            hi = min(lo + _BLOCK, n)
            for start in range(lo, n, _BLOCK):
                end = min(start + _BLOCK, n)
                if 2 * sizes[hi - 1] < at_least * (sizes[hi - 1] + sizes[start]) - 1e-9:
                    break
                apart = np.zeros((hi - lo, end - start), dtype=np.uint8)
                for word in letters:
                    apart += np.bitwise_count(word[lo:hi, None] ^ word[None, start:end])
                left, right = np.nonzero(apart <= slack[lo:hi, None] + slack[None, start:end] + np.float32(1e-3))
                left, right = left + lo, right + start
                good = left < right
                if part is not None:
                    good &= part[left] != part[right]
                left, right = left[good], right[good]
                both = sizes[left] + sizes[right]
                good = 2 * sizes[left] >= at_least * both - 1e-9
                good &= np.bitwise_count(pairs[left] ^ pairs[right]).sum(axis=1, dtype=np.int64) <= both - 2 - 2 * np.ceil(share * both - 1 - 1e-9)
                left, right = left[good], right[good]
                good = 2 * self.common(left, right) >= at_least * (sizes[left] + sizes[right]) - 1e-9
                found.append((left[good], right[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """An upper bound of the pairs' longest common subsequences, exact where the left text has up to 64 characters.

        Bits of a word stand for the left text's characters (Hyyro); longer texts go by pieces, each with all of the right text.
        """
        out = np.where(self.sizes[left] > _LONG, self.sizes[left], 0)
        padded = np.append(self.codes, _CODES)
        some = np.flatnonzero(self.sizes[left] <= _LONG)
        for cut in range(0, len(some), _PAIRS):
            held = some[cut : cut + _PAIRS]
            x, y = left[held], right[held]
            own, x = np.unique(x, return_inverse=True)
            for piece in range(0, int(self.sizes[own].max()), 64):
                sizes = np.clip(self.sizes[own] - piece, 0, 64)
                row = np.repeat(np.arange(len(own)), sizes)
                step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                masks = np.zeros((len(own), _CODES + 1), dtype=np.uint64)
                np.bitwise_or.at(masks, (row, self.codes[self.begins[own][row] + piece + step]), np.uint64(1) << step.astype(np.uint64))
                state = np.full(len(x), ~np.uint64(0))
                for at in range(int(self.sizes[y].max())):
                    code = padded[np.where(at < self.sizes[y], self.begins[y] + at, len(padded) - 1)]
                    mask = masks[x, code]
                    state = (state + (state & mask)) | (state & ~mask)
                out[held] += np.bitwise_count(~state)
        return out


@F.pandas_udf(T.DoubleType())
def ratio_bound(left: pd.Series, right: pd.Series) -> pd.Series:
    """An upper bound of the ratio, from the longest common subsequence."""
    n = len(left)
    names, place = np.unique(np.concatenate((left.to_numpy(dtype=object), right.to_numpy(dtype=object))), return_inverse=True)
    texts = _Texts(names.tolist())
    shorter = np.where(texts.sizes[place[:n]] <= texts.sizes[place[n:]], place[:n], place[n:])
    both = texts.sizes[place[:n]] + texts.sizes[place[n:]]
    return pd.Series(np.where(both > 0, 2 * texts.common(shorter, place[:n] + place[n:] - shorter) / np.maximum(both, 1), 1.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of the first text to the second."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def copies(articles: DataFrame, key: str = "link", title: str = "title", url: str = "link") -> DataFrame:
    """(key, first, host, path, title): each article with the smallest key of those equal in host, path and plain title."""
    rows = articles.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), plain_title(F.col(title)).alias("title"))
    first = rows.groupBy("host", "path", "title").agg(F.min("key").alias("first"))
    return rows.join(first, ["host", "path", "title"]).select("key", "first", "host", "path", "title")


def duplicate_articles(
    articles: DataFrame, key: str = "link", title: str = "title", url: str = "link", title_at_least: float = TITLE, path_at_least: float = PATH
) -> DataFrame:
    """Pairs (first1, first2, title_ratio, path_ratio), first1 < first2, of different articles that are the same.

    Titles are compared in plain form, paths where they differ; hosts are equal.
    Articles that ``copies`` puts together stand once, under their first key.  Empty
    titles are alike.
    """
    rows = copies(articles, key, title, url).where("key = first").select("first", "host", "path", "title")
    near = candidates(rows.select(F.col("host").alias("group"), F.col("title").alias("text")), title_at_least)
    both = near.unionByName(near.select("group", F.col("text2").alias("text1"), F.col("text1").alias("text2")))
    side = [rows.select(F.col("host").alias("group"), F.col("title").alias(f"text{i}"), F.col("first").alias(f"first{i}"), F.col("path").alias(f"path{i}")) for i in (1, 2)]
    pairs = both.join(side[0], ["group", "text1"]).join(side[1], ["group", "text2"]).where("first1 < first2").select("text1", "text2", "first1", "path1", "first2", "path2")
    # of one title, the similar paths meet as similar titles do
    group = F.concat("host", F.lit("/"), "title").alias("group")
    alike = candidates(rows.select(group, F.col("path").alias("text")), path_at_least).withColumnsRenamed({"text1": "path1", "text2": "path2"})
    side = [rows.select(group, "title", F.col("first").alias(f"first{i}"), F.col("path").alias(f"path{i}")) for i in (1, 2)]
    same = alike.join(side[0], ["group", "path1"]).join(side[1].drop("title"), ["group", "path2"])
    turn = F.col("first1") < F.col("first2")
    placed = [F.when(turn, F.col(f"{x}{i}")).otherwise(F.col(f"{x}{3 - i}")).alias(f"{x}{i}") for i in (1, 2) for x in ("first", "path")]
    pairs = pairs.unionByName(same.select(F.col("title").alias("text1"), F.col("title").alias("text2"), *placed))
    sizes = [F.length("path1"), F.length("path2")]
    pairs = pairs.where(2 * F.least(*sizes) >= path_at_least * (sizes[0] + sizes[1]) - 1e-9)
    # paths are shorter than titles, so they come first
    pairs = pairs.where(ratio_bound(F.col("path1"), F.col("path2")) >= path_at_least - 1e-9)
    told = pairs.withColumn("path_ratio", F.when(F.col("path1") == F.col("path2"), 1.0).otherwise(sequence_ratio(F.col("path1"), F.col("path2"))))
    told = told.where(F.col("path_ratio") >= path_at_least)
    told = told.withColumn("title_ratio", F.when(F.col("text1") == F.col("text2"), 1.0).otherwise(sequence_ratio(F.col("text1"), F.col("text2"))))
    return told.where(F.col("title_ratio") >= title_at_least).select("first1", "first2", "title_ratio", "path_ratio")
