"""Conversation repair against an exhaustive search of edits, with short blocks and odd conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from feedlens.llm import structure

from .test_queries import held_against_sql

ROLES = ["system", "user", "assistant", "tool", "", None, "uno"]


def conversations(n: int = 60, longest: int = 6) -> list[tuple]:
    pick = random.Random(5)
    rows = []
    for conv in range(n):
        turn = pick.choice([0, 3])
        for _ in range(pick.randrange(longest + 1)):
            turn += pick.choice([1, 1, 1, 2])
            text = pick.choice(["Yes.", "No!", "cut", "cut off", " \t", "", None, "a? ", "b.\n", "ünd.", f"t{turn}."])
            rows.append((conv, pick.choice([turn, turn, turn, turn, None]), pick.choice(ROLES[:2] * 2 + ROLES), text))
    return rows + [(None, 1, "user", "x."), (None, None, "assistant", "y."), (500, 1, "user", "z."), (500, 1, "user", "z.")]


def damaged(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def plain(rows: list[tuple]) -> tuple:
    """The report of one conversation's damaged rows, by trying all edits of few turns."""
    fault, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = None
    for choice in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and c != "D" for f, c in zip(fault, choice, strict=True)):
            continue
        # what is kept or gets a new role, with the fewest insertions; every insertion has one place among equals that reads least
        for spots in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, said = 0, "", []
            for i, (_, role, text) in enumerate([*rows, (None, None, None)]):
                for _ in range(spots[i]):
                    said.append((None, ""))
                    cost, audit = cost + 2, audit + "I"
                if i < len(rows):
                    audit += choice[i]
                    cost += {"K": 0, "R": 2, "D": 3}[choice[i]] + (choice[i] != "D" and fault[i] == "truncated")
                    if choice[i] != "D":
                        said.append((role if choice[i] == "K" else None, text))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            start = bool(said) and said[0][0] is not None and said[0][0][:1] == "s"
            if (len(said) - start) % 2 or (start and len(said) == 1):
                continue
            want = ["s"] * start + ["u", "a"] * ((len(said) - start) // 2)
            if all(r is None or r[:1] == w for (r, _), w in zip(said, want, strict=True)):
                names = {"u": "user", "a": "assistant"}
                best = (cost, audit, "\n".join(f"{names[w] if r is None else r}:{t}" for (r, t), w in zip(said, want, strict=True)))
    return gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return conversations(longest=5)


@pytest.mark.parametrize("block", [256, 2])
def test_against_all_edits(spark, rows, monkeypatch, block):
    monkeypatch.setattr(structure, "BLOCK", block)
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "1 AS fault", "2 AS no_id").repartition(3)
    found = structure.report(turns, structure.repair(structure.damage(turns)))
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    want = {c: plain(x) for c, x in damaged(rows).items()}
    assert got == want


def test_long_conversation_over_blocks_and_tasks(spark, rows, monkeypatch, tmp_path):
    """One conversation with most of the rows, cut anywhere, gives what SQL gives for it whole."""
    monkeypatch.setattr(structure, "BLOCK", 7)
    pick = random.Random(9)
    long = [(7_000, i, pick.choice(ROLES), pick.choice(["Yes.", "cut", f"n{i}.", f"m{i}", " "])) for i in range(700)]
    spark.createDataFrame([*rows, *long], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    held_against_sql(spark, str(tmp_path), "op11_structure_repair")


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "q."), (1, 2, "user", "r"), (1, 3, "user", "")], SCHEMA)
    found = structure.repair(turns).orderBy("place").collect()
    assert [(r["fault"], r["audit"], r["cost"]) for r in found] == [(None, "K", 0), (None, "K", 0), ("truncated", "R", 3), ("blank", "D", 3)]
    assert [tuple(x) for r in found for x in r["repaired"]][:2] == [("system", "s."), ("user", "q.")]


def test_signatures_share_layers(spark, monkeypatch):
    """Layers are computed once a node of the trie."""
    calls = []
    original = structure.advance
    monkeypatch.setattr(structure, "advance", lambda layer, symbol: calls.append(symbol) or original(layer, symbol))
    import pandas as pd

    held = pd.DataFrame({"head": [True] * 3, "signature": ["uaua", "uauax", "uaus"]})
    assert len(pd.concat(list(structure._walk(iter([held]))))) == 3
    assert len(calls) == 6
