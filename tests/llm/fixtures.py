"""Small documents with every odd case, and plain-Python versions of the operators' definitions."""

from __future__ import annotations

import random
import re

WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "ra") for b in ("n", "s", "t", "rl") for c in ("a", "el", "o", "ung")]
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    pick, words = random.Random(seed), text.split()
    for i in pick.sample(range(len(words)), n):
        words[i] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 400)
    rows: list[tuple[int | None, str | None]] = [(10 + i, base) for i in range(6)]
    rows += [(30 + i, changed(base, i, 4)) for i in range(40)]
    rows += [(80 + i, changed(base, 100 + i, 9)) for i in range(20)]
    rows += [(200 + i, prose(50 + i, 30 * i + 3)) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "  \t"), (303, "one two"), (304, "One Two"), (305, "12 34 !!"), (306, "\u00e9\u00e8 \U0001f600 x")]
    rows += [(307, prose(99, 60_000)), (303, "one two"), (None, base), (None, None), (400, "password: hunter22x"), (400, "password: hunter22x")]
    return rows


def frame(spark, rows):
    """doc_id and text with extra columns whose names the operators use themselves."""
    extra = ["bucket", "rep", "tokens", "kept", "spans", "blob_id", "score", "lang_pred", "matches", "n_words", "a", "along", "tie", "found", "lang"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def words_of(text, pattern) -> list[str]:
    return pattern.findall((text or "").translate(_LOWER))


def shingle_set(text, pattern=SPACE_WORD) -> set:
    words = words_of(text, pattern)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(rows, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest doc_id reachable) by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
