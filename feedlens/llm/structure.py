"""Conversation structure repair by a dynamic program whose layers a prefix trie shares.

Each turn becomes one symbol: its role and fault.  The turns of all conversations are
numbered in one global order, and a conversation's symbols are cut at every BLOCK-th
number, so that no row holds more than BLOCK turns.  Equal signatures are answered once:
they are dealt out sorted, and a task walks them as a prefix trie, keeping one layer of
the dynamic program a symbol and going back only to where the next signature branches off.
A block's answer is its cheapest way from each state to each; a conversation's blocks are
then chained in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import with_key, without_key, written

BLOCK = 256
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: An undeleted truncated turn adds this.
TRUNCATED = 1

_SPACE = r"\x20\x09-\x0D"
#: States: nothing said, a system turn said, a user's turn to be answered, an answer given.
_NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
_KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_ENDS = {0: 0, 3: 0, 2: 1, 1: 2}
Layer = list[list[tuple[int, str] | None]]


def damage(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by the checksum of ``conv_id:turn``.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 removes its sentence marks,
    3 repeats it and 4 gives it the role user.  Nulls in role, text and checksum are one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def ordered(turns: DataFrame) -> DataFrame:
    """The turns as a table with ``place``, a number that rises with conversation and turn.

    Rows of one turn stand by role and text, nulls first.  The table is sorted by ranges, so
    a long conversation lies in several tasks; equal rows are dealt by a number of their own.
    """
    rows = with_key(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"), "conv_id")
    keys = ["no_id", "conv_id", F.asc_nulls_first("turn"), "role", "text", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(rows.drop("_row").withColumn("place", F.monotonically_increasing_id()), "turns")


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(held: DataFrame) -> DataFrame:
    """Per place its first fault (blank, duplicate, truncated or null) and its symbol.

    A turn is a duplicate if its role and text stand earlier in the conversation.  Texts
    are told apart by 128 bits of their digest, and only the digests move.
    """
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    rows = held.select("no_id", "conv_id", "place", "role", F.md5(F.col("text").cast("binary")).alias("digest"), blank.alias("blank"), cut.alias("cut"))
    key = ["no_id", "conv_id", "role", "digest"]
    first = rows.where("not blank").groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    fault = (
        F.when(F.col("blank"), "blank").when(F.coalesce(F.col("place") > F.col("first"), F.lit(False)), "duplicate").when(F.col("cut"), "truncated")
    )
    first_char = _initial(F.col("role"))
    kind = F.when(first_char.isin("s", "u", "a"), first_char).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return rows.join(first, key, "left").withColumn("fault", fault).select("no_id", "conv_id", "place", "fault", symbol.alias("symbol"))


def blocks(marked: DataFrame) -> DataFrame:
    """(no_id, conv_id, start, signature, head): runs of at most BLOCK turns of a conversation, the first one as head."""
    rows = marked.groupBy("no_id", "conv_id", F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "").alias("signature"),
        F.min("place").alias("start"),
    )
    first = marked.groupBy("no_id", "conv_id").agg(F.min("place").alias("first"))
    return rows.join(first, ["no_id", "conv_id"]).select("no_id", "conv_id", "start", "signature", (F.col("start") == F.col("first")).alias("head"))


def _better(a: tuple[int, str] | None, b: tuple[int, str]) -> tuple[int, str]:
    return b if a is None or b < a else a


def advance(layer: Layer, symbol: str) -> Layer:
    """The next layer: per state of origin and state the cheapest edits so far, ASCII-least among equals.

    Insertions come before the turn they precede, so edits of one length of turns end in a
    turn's edit: none of two is the other's beginning, and their order stays when both go on.
    """
    late = symbol.isupper() * TRUNCATED
    kind = symbol.lower()
    out: Layer = []
    for ways in layer:
        after: list[tuple[int, str] | None] = [None] * 4
        for state, way in enumerate(ways):
            if way is None:
                continue
            cost, edits = way
            for inserted in range(3):
                if inserted:
                    state, cost, edits = _NEXT[state][0], cost + COST[INSERT], edits + INSERT
                after[state] = _better(after[state], (cost + COST[DELETE], edits + DELETE))
                if kind == "x":
                    continue
                goal = _NEXT[state][0]
                after[goal] = _better(after[goal], (cost + COST[REROLE] + late, edits + REROLE))
                goal = _KEEPS.get((state, kind))
                if goal is not None:
                    after[goal] = _better(after[goal], (cost + COST[KEEP] + late, edits + KEEP))
        out.append(after)
    return out


ANSWERS = "head boolean, signature string, ways array<struct<origin int, state int, cost long, edits string>>"


def _walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers of sorted signatures; the stack is the path in the trie from the root to the signature before."""
    stack: list[Layer] = []
    path, own = "", None
    for part in parts:
        out = []
        for head, signature in zip(part["head"].tolist(), part["signature"].tolist(), strict=True):
            if head != own:
                own, path = head, ""
                stack = [[[(0, "") if i == j else None for j in range(4)] for i in range(1 if head else 4)]]
            shared = 0
            for x, y in zip(path, signature, strict=False):
                if x != y:
                    break
                shared += 1
            del stack[shared + 1 :]
            for symbol in signature[shared:]:
                stack.append(advance(stack[-1], symbol))
            path = signature
            ways = [(i, j, *way) for i, row in enumerate(stack[-1]) for j, way in enumerate(row) if way is not None]
            out.append((head, signature, [{"origin": i, "state": j, "cost": c, "edits": e} for i, j, c, e in ways]))
        yield pd.DataFrame(out, columns=["head", "signature", "ways"])


def answers(signatures: DataFrame) -> DataFrame:
    """Per distinct (head, signature) its ways; sorted ranges are walked as a prefix trie."""
    distinct = signatures.select("head", "signature").distinct()
    return distinct.repartitionByRange("head", "signature").sortWithinPartitions("head", "signature").mapInPandas(_walk, ANSWERS)


EDITS = "place long, before string, edit string, new_role string, after string, cost long"


def _spelled(start: int, signature: str, state: int, edits: str, last: bool) -> list[tuple]:
    """One row a turn: initials of turns inserted before it, its edit, its role if new, what follows the last one, and the cost."""
    out, place, before = [], start, ""
    for edit in edits:
        if edit == INSERT:
            state, role = _NEXT[state]
            before += role[0]
            continue
        symbol, role = signature[place - start], None
        cost = COST[edit] + COST[INSERT] * len(before) + (edit != DELETE and symbol.isupper()) * TRUNCATED
        if edit == REROLE:
            state, role = _NEXT[state]
        elif edit == KEEP:
            state = _KEEPS[(state, symbol.lower())]
        out.append((place, before, edit, role, "", cost))
        place, before = place + 1, ""
    if last and _ENDS[state]:
        place, before, edit, role, _, cost = out[-1]
        out[-1] = (place, before, edit, role, "ua"[-_ENDS[state] :], cost + COST[INSERT] * _ENDS[state])
    return out


class _Chain:
    """The cheapest ways of one conversation so far; what all of them share is given out at once."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, list[tuple]]] = {0: (0, [])}

    def add(self, start: int, signature: str, steps) -> Iterator[tuple]:
        after: dict[int, tuple[int, list[tuple]]] = {}
        for step in steps:
            if step["origin"] not in self.ways:
                continue
            cost, path = self.ways[step["origin"]]
            cost, path = cost + step["cost"], [*path, (start, signature, step["origin"], step["edits"])]
            held = after.get(step["state"])
            if held is None or (cost, [x[3] for x in path]) < (held[0], [x[3] for x in held[1]]):
                after[step["state"]] = (cost, path)
        self.ways = after
        paths = [path for _, path in after.values()]
        while len(paths[0]) > 1 and all(p[0] == paths[0][0] for p in paths):
            for p in paths[1:]:
                p.pop(0)
            yield from _spelled(*paths[0].pop(0), last=False)

    def close(self) -> Iterator[tuple]:
        ends = [(cost + COST[INSERT] * _ENDS[s], "".join(x[3] for x in path) + INSERT * _ENDS[s], path) for s, (cost, path) in self.ways.items()]
        path = min(ends, key=lambda x: x[:2])[2]
        for i, part in enumerate(path):
            yield from _spelled(*part, last=i == len(path) - 1)


def _chained(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in EDITS.split(", ")]
    chain, own = _Chain(), None
    for part in parts:
        out: list[tuple] = []
        for no_id, conv_id, start, signature, ways in part[["no_id", "conv_id", "start", "signature", "ways"]].itertuples(index=False, name=None):
            if own != (no_id, conv_id):
                if own is not None:
                    out.extend(chain.close())
                chain, own = _Chain(), (no_id, conv_id)
            out.extend(chain.add(start, signature, ways))
        yield pd.DataFrame(out, columns=names)
    if own is not None:
        yield pd.DataFrame(list(chain.close()), columns=names)


def edits(held: DataFrame, marked: DataFrame) -> DataFrame:
    """Per place of ``ordered`` turns its cheapest edit, with the turns to insert beside it and the cost."""
    runs = written(blocks(marked), "blocks")
    solved = runs.join(answers(runs), ["head", "signature"])
    solved = solved.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "start")
    return solved.select("no_id", "conv_id", "start", "signature", "ways").mapInPandas(_chained, EDITS)


def repair(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, ...) with faults and edits, and ``repaired``: what stands in each one's stead.

    Returns no_id, conv_id (0 where no_id), place (order), turn, role, text, fault, audit (edit
    initials of the turn and of insertions beside it), cost and repaired, an array of (role, text).  The result's
    roles read ``(s?(ua)+)?`` by initials at the least cost; among equal costs the ASCII-least
    audit holds.  Null roles and texts are one space, which is blank; a conversation whose id
    is null is one conversation; turns that are null come first; rows of one turn stand by
    role and text, repeated ones side by side; extra columns are ignored; an empty table gives
    no rows; no length of text or conversation is cut.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    held = ordered(rows)
    marked = written(faults(held), "faults")
    found = held.join(marked.select("place", "fault"), "place").join(edits(held, marked), "place")
    said = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") == DELETE, F.lit(None)).otherwise(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))))
    none = F.slice(F.array(F.struct(F.col("role"), F.col("text"))), 1, 0)
    audit = F.concat(F.repeat(F.lit(INSERT), F.length("before")), F.col("edit"), F.repeat(F.lit(INSERT), F.length("after")))
    return found.select(
        "no_id", "conv_id", "place", "turn", "role", "text", "fault", audit.alias("audit"), "cost",
        F.concat(said("before"), F.coalesce(own, none), said("after")).alias("repaired"),
    )


REPORT = "conv_id long, no_id boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FAULTS = ("blank", "duplicate", "truncated")


class _Told:
    """What the turns of one conversation have said so far."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = None
        self.distinct = self.illegal = self.cost = 0
        self.count = dict.fromkeys(_FAULTS, 0)
        self.initial, self.audit, self.said, self.any = None, [], hashlib.sha256(), False

    def add(self, turn, fault, initial, audit, cost, said) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.distinct = turn if self.low is None else self.low, turn, turn, self.distinct + 1
        if fault is not None:
            self.count[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial, self.cost = initial, self.cost + cost
        self.audit.append(audit)
        if said is not None:
            self.said.update((("\n" if self.any else "") + said).encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.said.hexdigest()


def _told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    told, own = _Told(), None
    for part in parts:
        out = []
        columns = [part[c].tolist() for c in ("conv_id", "no_id", "turn", "no_turn", "fault", "initial", "audit", "cost", "said")]
        for conv_id, no_id, turn, no_turn, *rest in zip(*columns, strict=True):
            if own != (conv_id, no_id):
                if own is not None:
                    out.append((*own, *told.row()))
                told, own = _Told(), (conv_id, no_id)
            told.add(None if no_turn else turn, *rest)
        yield pd.DataFrame(out, columns=names)
    if own is not None:
        yield pd.DataFrame([(*own, *told.row())], columns=names)


def report(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` the faults, gaps, cost and audit of its ``repair``, and the digest of the result.

    A digest reads its text in order, so a conversation's turns pass through one task, one
    batch at a time.  A conversation without turns has zeros, no audit and the empty text's digest.
    """
    said = F.when(F.size("repaired") > 0, F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"))
    rows = repaired.select(
        "conv_id", "no_id", "place", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNull().alias("no_turn"),
        "fault", _initial(F.col("role")).alias("initial"), "audit", "cost", said.alias("said"),
    )
    rows = rows.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "place")
    found = rows.mapInPandas(_told, REPORT)
    known = with_key(turns.select("conv_id"), "conv_id").distinct()
    joined = known.join(found, ["no_id", "conv_id"], "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return without_key(joined.select("conv_id", "no_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")), "conv_id")
