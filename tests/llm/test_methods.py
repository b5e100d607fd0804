"""Operators that SQL can't express, against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from feedlens.llm import chat, decontam, digest, langid, neardup, packing, passages, queries, secretscan, urltree
from feedlens.llm.textkit import CirculantMinHash, WordHasher, shingle_set

from . import fixtures
from .fixtures import changed, frame, near_components, prose, texts

SF = os.environ.get("FEEDLENS_TEST_SF", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_language_held_out_accuracy(spark):
    known = spark.read.parquet(f"{LARGER}/documents.parquet").where("lang is not null and text rlike '(\\\\p{L}+ ){10}'").select("doc_id", "lang")
    rows = queries.op1_language(spark, LARGER).where("held_out").join(known, "doc_id").collect()
    assert len(rows) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    labelled = [(i, prose(i, 80), "aa") for i in range(20)] + [(100 + i, " ".join(f"x{chr(97 + (i + j) % 26)}zq" for j in range(80)), "bb") for i in range(20)]
    model = langid.train(spark.createDataFrame([*labelled, (500, None, "aa"), (501, "text", None)], "doc_id long, text string, lang string"))
    found = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, texts()), model).collect()}
    assert found[300, None] == found[301, ""] == found[305, "12 34 !!"] == ("und", 0.0)
    assert found[307, prose(99, 60_000)][0] == "aa"
    untrained = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(frame(spark, texts()), untrained).collect()} == {"und"}


def test_language_filter_returns_all_languages_of_a_gram():
    own = [np.arange(1, 500, dtype=np.uint64) * np.uint64(7919), np.arange(400, 900, dtype=np.uint64) * np.uint64(7919)]
    both = langid.LanguageFilter.build(["a", "b"], [langid.mix64(x) for x in own])
    shared = both.masks(langid.mix64(np.arange(400, 500, dtype=np.uint64) * np.uint64(7919)))
    assert (shared[:, 0] == 3).all()


def test_url_parts_and_rules(spark):
    urls = [None, "", "abc", "http://", "HTTP://Ex.COM", "a://b://c/d", "x://WWW.Example.com/en/a?b=1#c", "x://example.com/en", "x://example.com/en/", "x://a.b.net/es/1", "x://bnet/es/", "x://h?q/p", "x://h#f", "x://\u00c9.net/fr/\n2"]
    rows = urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(rows) == len(urls)
    for r in rows:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = []
        for verdict, rule in urltree.RULES:
            name, _, tail = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
                fits.append((len(rule), rule, verdict))
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert not fits or r["verdict"] == max(fits)[2]
        assert r["verdict"] in ("allow", "block")


def test_url_templates_learn_from_labelled_pages(spark):
    rules = (("block", "a.org/bad/1"), ("allow", "a.org/good/1"))
    pages = [(i, f"http://a.org/bad/1{i}/x{i % 7}") for i in range(40)] + [(100 + i, f"http://a.org/good/1{i}/x{i % 7}") for i in range(40)]
    pages += [(200, "http://a.org/bad/29/x3"), (201, "http://a.org/good/29/x3"), (202, "http://other.org/bad/29/x3")]
    found = {r["page_id"]: r for r in urltree.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert (found[200]["verdict"], found[201]["verdict"], found[202]["verdict"]) == ("block", "allow", "allow")
    assert found[200]["rule"] is None and "*" in found[200]["template"]


def test_fingerprints_against_plain_python(spark):
    rows = sorted({x for x in texts() if x[0] is not None}, key=lambda x: (x[0], x[1] or ""))
    found = sorted(digest.fingerprints(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    whole = [t or "" for _, t in rows]
    by_text = defaultdict(set)
    for i, r in enumerate(found):
        text, after = whole[i], whole[(i + 1) % len(whole)]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (r["doc_id"], r["n_chars"]) == (rows[i][0], len(text))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        if len(text) > 400 and len(after) > 400:
            assert r["near_edited"] > 0.3
    assert all(len(x) == 1 for x in by_text.values())
    unlike = [r["near_next"] for r in found if 203 <= r["doc_id"] < 211]
    assert max(unlike) < 0.3


def test_circulant_signature_estimates_jaccard():
    minhash, hasher = CirculantMinHash(512), WordHasher()
    base = prose(3, 2000)
    a, b = (shingle_set(w) for w in hasher.words([base, changed(base, 4, 60)]))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - exact) < 0.1


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    rows = texts()
    want = near_components(rows, percent)
    found = neardup.near_duplicates(frame(spark, rows), percent=percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_a_chain_in_a_large_bucket(spark):
    text, rows = prose(7, 300), []
    for i in range(60):
        rows.append((1000 - i, text))
        text = changed(text, 700 + i, 4)
    rows.append((2000, prose(8, 300)))
    want = near_components(rows, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()} == want


def test_containment_in_several_passes(spark, monkeypatch):
    items = [(i, prose(900 + i, 8 + 9 * i)) for i in range(25)]
    docs = [(i, f"{prose(i, 500)} {changed(t, i, 1) if len(t) > 400 else t} {prose(70 + i, 900)}") for i, t in items] + [(300, None), (301, prose(5, 900))]
    want = set()
    for i, text in docs:
        own = fixtures.shingle_set(text, fixtures.LETTER_WORD)
        for j, item in items:
            few = fixtures.shingle_set(item, fixtures.LETTER_WORD)
            if 10 * len(own & few) >= 8 * len(few):
                want.add((i, j, len(few), len(own & few)))
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 7)
    found = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found.collect()} == want and len(want) == 25


def test_ledger_scans_only_unseen_blobs(spark):
    history = spark.createDataFrame([("a", 1, "password=abcdef1"), ("b", 1, "password=abcdef1"), ("a", 2, None), ("c", 1, "clean")], "path string, version long, text string")
    ledger = secretscan.scan(history).cache()
    assert ledger.count() == 3
    grown = history.union(spark.createDataFrame([("a", 3, "token: qwertz7"), ("d", 1, "clean")], history.schema))
    fresh = secretscan.scan(grown, ledger)
    assert fresh.count() == 1
    assert secretscan.scan(grown, ledger.union(fresh)).count() == 0
    assert secretscan.scan(grown, ledger, secretscan.BASE_RULES).count() == 4
    rows = secretscan.findings(grown, ledger.union(fresh)).collect()
    assert sorted(r["path"] for r in rows if r["spans"]) == ["a", "a", "b"] and len(rows) == 6
    clean = secretscan.findings(grown, ledger.union(fresh)).select(secretscan.redact(secretscan.F.col("text"), secretscan.F.col("spans")).alias("t")).collect()
    assert sorted(str(r["t"]) for r in clean) == ["None", "[REDACTED]", "[REDACTED]", "[REDACTED]", "clean", "clean"]


def test_chat_round_trip_and_windows(spark):
    turns = [(1, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), prose(i, 1 + 37 * i % 300)) for i in range(60)]
    turns += [(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(("user", "assistant"))]
    turns += [(2, 0, "assistant", "<\\|a <\\\\|b <| |> \n<|im_start|>"), (2, 1, "odd\nrole%0A<|", None), (3, None, None, None), (4, 5, "user", prose(1, 9000))]
    turns += [(5, i, "assistant", f"t{i}") for i in range(5000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns")
    windows = chat.format_chats(df, queries.tokenizer_path())
    whole = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: (x[0], -1 if x[1] is None else x[1])):
        whole[c].append((role or "", text or ""))
    found = {r["conv_id"]: r for r in chat.read_back(windows, ordered=True).collect()}
    assert {r["conv_id"]: r for r in chat.read_back(windows.repartition(5)).collect()} == found
    assert set(found) == set(whole)
    for c, own in whole.items():
        told = "".join(f"{role}\n{text}\n" for role, text in own).encode()
        loss = "".join(text for role, text in own if role == "assistant")
        assert (found[c]["n_turns"], found[c]["turns_sha256"]) == (len(own), hashlib.sha256(told).hexdigest())
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.where("conv_id = 1").collect():
        parsed = chat.parse(w["formatted"])
        assert len(parsed) == w["n_turns"] and parsed[0] == whole[1][0]
        assert w["n_tokens"] <= chat.BUDGET or (w["n_turns"] - w["n_repeated"] == 1 and w["n_repeated"] <= 1)
        assert parsed[w["n_repeated"] :] == whole[1][w["first_turn"] : w["first_turn"] + w["n_turns"] - w["n_repeated"]]


def test_chat_windows_against_plain_python():
    pick = random.Random(3)
    for case in range(300):
        turns = [chat.Turn(pick.choice(("user", "assistant")), f"t{i}", pick.choice((2, 30, 128, 200, 450, 600))) for i in range(pick.randrange(1, 30))]
        if case % 2:
            turns[0] = chat.Turn("system", "s", pick.choice((5, 100, 500)))
        layout, found = chat.Layout(512, 128), []
        for t in turns:
            found.append(layout.add(t))
        found = [x for x in (*found, layout.close()) if x]
        prefix, at, want = [0, *np.cumsum([t.tokens for t in turns]).tolist()], 0, []
        floor = turns[0].role == "system"
        while at < len(turns):
            held = turns[0].tokens if floor and at else 0
            back = at
            while back > floor and prefix[at] - prefix[back - 1] <= min(128, 512 - held - turns[at].tokens):
                back -= 1
            end = at + 1
            while end < len(turns) and held + prefix[end + 1] - prefix[back] <= 512:
                end += 1
            size = held + prefix[end] - prefix[back]
            assert size <= 512 or (end == at + 1 and back == at)
            want.append((len(want), at, (1 if floor and at else 0) + end - back, (1 if floor and at else 0) + at - back, size))
            at = end
        assert [x[:5] for x in found] == want


def test_compact_windows_cover_every_passage():
    pick = np.random.default_rng(5)
    for sizes in ([30], [3, 40, 12], [9, 10, 11, 64]):
        values = pick.integers(0, 40, sum(sizes)).astype(np.uint32)
        ends = np.cumsum(sizes)
        starts = ends - np.array(sizes)
        found = list(zip(*(x.tolist() for x in passages.compact_windows(values, starts, ends, 10)), strict=True))
        for s, e in zip(starts, ends, strict=True):
            for i in range(s, e - 9):
                for j in range(i + 9, e):
                    mid = min(range(i, j + 1), key=lambda x: (values[x], x))
                    assert sum(left <= i and j <= right and m == mid for left, m, right, _ in found) == 1


def test_repeated_passages(spark):
    shared = [prose(3000 + i, 60 + 20 * i) for i in range(4)]
    rows = [(i, prose(i, 300)) for i in range(10)]
    planted = {10 * (n + 1) + i: (n, f"{prose(500 + 10 * n + i, 200)} {text if i % 2 else changed(text, i, 1)} {prose(700 + 10 * n + i, 90)}") for n, text in enumerate(shared) for i in range(6)}
    rows += [(i, t) for i, (_, t) in planted.items()] + [(900, None), (901, ""), (None, shared[0]), (902, "short")]
    found = passages.repeated_passages(frame(spark, rows)).collect()
    root = {i: i for i in planted}
    for r in found:
        a, b = r["doc_id"], r["other_doc_id"]
        assert planted[a][0] == planted[b][0] and b < a
        assert r["n_words"] >= 50 and r["similarity"] >= 0.8
        own = planted[a][1].split()[r["start_word"] : r["end_word"]]
        assert len(own) == r["n_words"] and len(set(own) & set(shared[planted[a][0]].split())) > 30
        old, new = root[a], root[b]
        root = {i: new if x == old else x for i, x in root.items()}
    assert len({root[i] for i in planted}) == len(shared)


def model_ids(texts_):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    return [np.array([*model.encode(t or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4") for t in texts_]


def held_packing(rows, pieces, size=packing.SEQUENCE):
    """Each id in exactly one piece, digests and offsets right, padding only where allowed."""
    ids = dict(zip([i for i, _ in rows], model_ids([t for _, t in rows]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = ids[doc][at : at + p["length"]]
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[doc])
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


@needs_tables
def test_packing_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held_packing(rows, queries.op10_packing(spark, SF).collect())


def test_packing_of_odd_texts(spark):
    strange = ["I'll we've 'S don'T a's", "<|endoftext|> x <|startoftext|>", "\u00c9t\u00e9 \u0130stanbul stra\u00dfe \u01c4", "\u4f60\u597d 12345 \u0661\u0662", "a\u0301 e\u0308", "x\x00y\x01z", "\ufb01 \u2126 \u212b", "tab\tnew\nline\r\n", "\U0001f600!?...", "caf\u00e9\u00a0bar\u2028z", "_a_b__", "\u017f \u0149 \u00b5 \u00aa \u00bd"]
    rows = list({x[0]: x for x in texts() if x[0] is not None}.values()) + [(5000 + i, t) for i, t in enumerate(strange)]
    held_packing(rows, packing.pack(frame(spark, rows), queries.tokenizer_path()).collect())
    whole = sum(len(x) for x in model_ids([t for _, t in rows]))
    repeated = packing.pack(frame(spark, [*rows, *rows, (None, "x")]), queries.tokenizer_path()).collect()
    assert sum(p["length"] for p in repeated) == 2 * whole + len(model_ids(["x"])[0])


def test_hilbert_neighbours_differ_by_one_step():
    side = np.arange(16)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, 4)
    assert sorted(keys) == list(range(16**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
