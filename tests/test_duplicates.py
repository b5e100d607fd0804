"""Duplicate articles against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from feedlens.functions.text import plain_title
from feedlens.operators import duplicates

WORDS = ["new", "release", "of", "spark", "engine", "보안", "report", "daily", "a", "to", "über", "market", "opens", "at", "noon"]


def articles(n: int) -> list[tuple]:
    pick = random.Random(6)
    rows, titles = [], [""]
    for i in range(n):
        title = " ".join(pick.choice(WORDS) for _ in range(pick.choice([1, 2, 6, 9])))
        if pick.random() < 0.5:
            # an earlier title with some letters changed, dropped or added
            letters = list(pick.choice(titles))
            for _ in range(pick.randrange(1 + len(letters) // 6 + 1)):
                at = pick.randrange(len(letters) + 1)
                letters[at : at + pick.randrange(2)] = pick.choice(["", "x", "yz", " "])
            title = "".join(letters)
        titles.append(title)
        path = pick.choice(["", "/", f"/news/{pick.randrange(30)}", f"/news/2024/{title.replace(' ', '-')}", f"/{pick.randrange(10**8)}"])
        rows.append((f"k{i:05}", pick.choice([title, title, title.upper() + "!", None if i % 50 == 0 else title]), f"https://{pick.choice('ab')}.org{path}?q={i}"))
    return rows + [("z1", "t", None), ("z2", "t", "no scheme"), ("z3", "t", "no scheme")]


def test_against_all_pairs(spark):
    rows = articles(700)
    df = spark.createDataFrame(rows, "key string, title string, url string")
    found = duplicates.duplicate_articles(df, "key", "title", "url").collect()
    got = {(r["first1"], r["first2"]): (round(r["title_ratio"], 9), round(r["path_ratio"], 9)) for r in found}
    plain = {r["key"]: r["t"] for r in df.select("key", plain_title(F.col("title")).alias("t")).collect()}
    first: dict[tuple, str] = {}
    for key, _, url in rows:
        parsed = urlparse(url or "")
        place = (parsed.netloc, parsed.path, plain[key])
        first[place] = min(first.get(place, key), key)
    held = sorted((k, *place) for place, k in first.items())
    want = {}
    for n, (a, host, path, title) in enumerate(held):
        for b, other_host, other_path, other in held[n + 1 :]:
            if host != other_host:
                continue
            ratio = SequenceMatcher(None, title, other).ratio()
            if ratio < 0.85:
                continue
            same = 1.0 if path == other_path else SequenceMatcher(None, path, other_path).ratio()
            if same >= 0.8:
                want[(a, b)] = (round(ratio, 9), round(same, 9))
    assert got == want
    assert len(want) > 40


@pytest.mark.parametrize("at_least", [0.8, 0.85, 0.95])
def test_candidates_miss_none_and_are_few(spark, at_least):
    pick = random.Random(8)
    titles = [" ".join("".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randrange(2, 9))) for _ in range(pick.randrange(1, 8))) for _ in range(350)]
    for t in titles[:120]:
        at = pick.randrange(len(t) + 1)
        titles.append(t[:at] + pick.choice(["", "q", "qq", "zz z"]) + t[at + pick.randrange(4) :])
    titles = sorted(set(titles))
    df = spark.createDataFrame([("g", t) for t in titles], "`group` string, text string")
    got = {(r["text1"], r["text2"]) for r in duplicates.candidates(df, at_least).collect()}
    want = {(a, b) for n, a in enumerate(titles) for b in titles[n + 1 :] if SequenceMatcher(None, a, b).ratio() >= at_least}
    assert want <= got and len(want) > 30
    assert len(got) < len(titles) ** 2 // 2 // 20


def test_candidates_of_the_same_letters_are_few(spark):
    """Titles of equal letters in other orders are no candidates; ones with a letter dropped are."""
    pick = random.Random(9)
    letters = list("the general report of an open market in the north")
    titles = ["".join(pick.sample(letters, len(letters))) for _ in range(300)]
    titles += [t[:20] + t[21:] for t in titles[:40]] + ["e", "ee", ""]
    df = spark.createDataFrame([("g", t) for t in titles], "`group` string, text string")
    got = {(r["text1"], r["text2"]) for r in duplicates.candidates(df, 0.85).collect()}
    want = {tuple(sorted((t, t[:20] + t[21:]))) for t in titles[:40]}
    assert want <= got and len(got) < 400


def test_large_groups_in_tiles(spark, monkeypatch):
    """Groups of several parts, names with zero characters, texts of more than a word's 64 bits: as in one piece, and the bound is no less than the ratio."""
    pick = random.Random(10)
    titles = ["".join(pick.choice("abcde ") for _ in range(pick.choice([3, 20, 60, 64, 65, 140]))) for _ in range(120)]
    titles += [t[:at] + t[at + 1 :] for t in titles if (at := pick.randrange(len(t))) or True]
    titles = sorted(set(titles))
    rows = [("g\0" + "0", t) for t in titles] + [("g\0" + "1", t) for t in titles[:130]]
    df = spark.createDataFrame(rows, "`group` string, text string")
    held = {g: sorted({t for h, t in rows if h == g}) for g in ("g\0" + "0", "g\0" + "1")}
    want = {(g, a, b) for g, own in held.items() for n, a in enumerate(own) for b in own[n + 1 :] if SequenceMatcher(None, a, b).ratio() >= 0.85}
    found = []
    for size in (4096, 50):
        monkeypatch.setattr(duplicates, "TILE", size)
        found.append(sorted(tuple(r) for r in duplicates.candidates(df, 0.85).collect()))
    assert found[0] == found[1] and want <= set(found[0]) and len(want) > 50
    pairs = [(pick.choice(titles), pick.choice(titles)) for _ in range(300)] + [("", ""), ("", "a")]
    told = spark.createDataFrame(pairs, "a string, b string").select("a", "b", duplicates.ratio_bound("a", "b").alias("x")).collect()
    assert all(r["x"] >= SequenceMatcher(None, r["a"], r["b"]).ratio() - 1e-12 for r in told) and sum(r["x"] < 0.85 for r in told) > 200


def test_empty_articles(spark):
    df = spark.createDataFrame([], "link string, title string")
    assert duplicates.duplicate_articles(df).count() == 0
