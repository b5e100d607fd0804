"""Small benchmark items inside long documents against brute force."""

from __future__ import annotations

from feedlens.llm import decontam

from .fixtures import LETTER_WORD, frame, prose, shingle_set, words_of


def test_small_items_inside_long_documents(spark):
    items = [(n * 100 + i, prose(40_000 + 100 * n + i, n)) for n in (2, 3, 4, 5, 6, 7, 9, 12, 14) for i in range(30)]
    docs = [(j, f"{prose(60_000 + j, 300)} {text.upper()} {prose(70_000 + j, 200)}") for j, text in items]
    docs += [(5000, None), (5001, ""), (5002, "one"), (5003, items[0][1]), (5004, items[65][1])]
    want = set()
    runs = {j: f" {' '.join(words_of(t, LETTER_WORD))} " for j, t in docs}
    sets = {j: shingle_set(t, LETTER_WORD) for j, t in docs}
    for i, item in items:
        words, few = words_of(item, LETTER_WORD), shingle_set(item, LETTER_WORD)
        for j, _ in docs:
            if len(words) < 5:
                if f" {' '.join(words)} " in runs[j]:
                    want.add((j, i, 1, 1))
            elif 10 * len(both := sets[j] & few) >= 8 * len(few):
                want.add((j, i, len(few), len(both)))
    found = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found.collect()}
    assert len(want) >= len(items)
    assert (len(want - got), len(got - want)) == (0, 0)
