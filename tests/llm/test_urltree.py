"""The template tree against a plain-Python tree."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from feedlens.llm import urltree
from feedlens.llm.urltree import BRANCHES, PRIOR, RARE, REJECT, SIGNIFICANT, SMOOTHING

RULES = (("block", "net/es/"), ("block", "net/fr/"), ("allow", "com/"), ("allow", "net/shop/a"), ("block", "net/shop/b"), ("block", "d.org/deep/x/y/z/1/"))


def unlike(hits, size, all_hits, all_size) -> bool:
    others = all_size - size
    if not size or not others:
        return False
    share = all_hits / all_size
    gap = hits / size - (all_hits - hits) / others
    return gap * gap > SIGNIFICANT * share * (1 - share) * (1 / size + 1 / others)


def pure(blocked, known, above) -> float:
    return round((blocked + SMOOTHING * above) / (known + SMOOTHING), 9)


def grow(rows, template, purity, out) -> None:
    """rows: (segments left, shape, n, known, blocked)."""
    shared = 0
    while all(len(r[0]) > shared for r in rows) and len({r[0][shared] for r in rows}) == 1:
        shared += 1
    template += "".join("/" + x for x in rows[0][0][:shared])
    rows = [(r[0][shared:], *r[1:]) for r in rows]
    kids = defaultdict(list)
    for r in rows:
        kids[r[0][0] if r[0] else ""].append(r)
    stats = {k: [sum(r[2] for r in own), sum(r[3] for r in own), sum(r[4] for r in own), sum(r[2] for r in own if len(r[0]) == 1), sum(r[2] for r in own if len(r[0]) > 1 and "*" in r[0][1])] for k, own in kids.items() if k}
    if not stats:
        for r in rows:
            out[r[1]] = (template, purity)
        return
    n, known, blocked, ending, varying = (sum(x) for x in zip(*stats.values(), strict=True))
    groups = defaultdict(list)
    for k, own in kids.items():
        name = k
        if k:
            a, b, c, d, e = stats[k]
            alike = not (unlike(c, b, blocked, known) or unlike(d, a, ending, n) or unlike(e, a, varying, n))
            if (len(stats) > BRANCHES and a < RARE * n) or (len(stats) > 1 and alike):
                name = "*"
        groups[name] += own
    for name, own in groups.items():
        own_purity = pure(sum(r[4] for r in own), sum(r[3] for r in own), purity)
        if name:
            grow([(r[0][1:], *r[1:]) for r in own], f"{template}/{name}", own_purity, out)
        else:
            for r in own:
                out[r[1]] = (template, own_purity)


def expected(pages, rules):
    ruled = {}
    for i, url in pages:
        host, path = re.match(r"\w+://([^/]*)([^?#]*)", url).groups()
        fits = [(len(t), t, v) for v, t in rules if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
        shape = tuple(x for x in re.sub(r"[0-9]+", "*", re.sub("[0-9a-f]{16,}", "*", path)).split("/") if x)
        ruled[i] = (host, shape, max(fits)[2] if fits else None)
    out = {}
    for host in {r[0] for r in ruled.values()}:
        shapes = Counter(r[1] for r in ruled.values() if r[0] == host)
        rows = [(s, s, n, sum(r[:2] == (host, s) and r[2] is not None for r in ruled.values()), sum(r == (host, s, "block") for r in ruled.values())) for s, n in shapes.items()]
        found = {}
        grow(rows, "", pure(sum(r[4] for r in rows), sum(r[3] for r in rows), PRIOR), found)
        out |= {(host, s): x for s, x in found.items()}
    return {i: (r[2] or ("block" if out[r[:2]][1] >= REJECT else "allow"), out[r[:2]][0]) for i, r in ruled.items()}


def test_tree_against_plain_python(spark):
    pick = random.Random(4)
    pages = []
    for i in range(900):
        host = pick.choice(["a.net", "b.net", "c.com", "d.org", "e.org"])
        words = [pick.choice(["es", "fr", "en", "de", "shop", "deep"])]
        if words[0] == "shop":
            words.append(pick.choice("ab") + pick.choice("cd"))
        elif words[0] == "deep":
            words += ["x", "y", "z", "1", *["q"] * pick.randrange(4)]
        else:
            words += [pick.choice([f"{pick.randrange(99)}", f"item{pick.choice('abcdefghijklmnopqrstuvwxyz')}{pick.choice('uvw')}"]) for _ in range(pick.randrange(3))]
        pages.append((i, f"http://{host}/{'/'.join(words)}{pick.choice(['', '/', '?q=1'])}"))
    found = {r["page_id"]: (r["verdict"], r["template"]) for r in urltree.judge(spark.createDataFrame(pages, "page_id long, url string"), RULES).collect()}
    want = expected(pages, RULES)
    assert found == want
    unruled = [want[i][0] for i, url in pages if re.search(r"[ab].net/(en|de)|[de].org/[ef]", url)]
    assert {"allow", "block"} == set(unruled)


def test_labels_of_a_host_reach_its_other_branches(spark):
    rows = [(i, f"http://a.net/{x}/{i}") for i, x in enumerate(["es", "fr", "en", "de"] * 10)] + [(100 + i, f"http://b.org/en/{i}") for i in range(9)]
    rows += [(200, None), (201, "nothing"), (202, "http://a.net"), (0, "http://a.net/es/0")]
    found = urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()
    assert len(found) == len(rows)
    verdicts = {r["page_id"]: r["verdict"] for r in found}
    assert all(verdicts[i] == "block" for i in range(40)) and all(verdicts[100 + i] == "allow" for i in range(9))
