"""DuckDB SQL for the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from feedlens.llm.licenses import SHARE, TEMPLATES

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_rows() -> str:
    rows = []
    for i, t in enumerate(TEMPLATES):
        for j, word in enumerate(t.words):
            key = t.key_at <= j < t.key_at + len(t.key)
            rows.append(f"({i}, '{t.label}', {t.base}, {t.key_at}, {len(t.key)}, {len(t.words)}, {j}, '{word}', {key})")
    return ", ".join(rows)


OP2 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWERED}, '{_WORDS}') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
t(t, label, base, key_at, key_len, len, j, word, is_key) AS (VALUES {_template_rows()}),
m AS (
  SELECT r, t, label, base, i - j + key_at AS start, round(count(*)::DOUBLE / any_value(len), 6) AS share
  FROM p JOIN t USING (word)
  GROUP BY r, t, label, base, key_at, i - j
  HAVING sum(CASE WHEN is_key THEN 1 ELSE 0 END) = any_value(key_len) AND round(count(*)::DOUBLE / any_value(len), 6) >= {SHARE}
),
s AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(share) AS score
  FROM m GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)
"""


def _shingles(table: str, key: str, pattern: str, k: int = 5) -> str:
    return rf"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s
  FROM (SELECT {key}, regexp_extract_all({_LOWERED}, '{pattern}') AS w FROM {table})"""


def _linked(k: int) -> str:
    """Documents with their component: all pairs that share a shingle, counted, then followed to the end."""
    return rf"""
WITH RECURSIVE s AS ({_shingles("documents", "doc_id", "[^\\x20\\x09-\\x0D]+", k).replace(chr(92) * 2, chr(92))}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
),
c AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.doc_id),
l AS (
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c.c) AS component_id
  FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
)"""


OP5 = f"{_linked(5)} SELECT *, doc_id = component_id AS kept FROM l"
OP13 = f"{_linked(4)} SELECT * FROM l"

OP6 = rf"""
WITH d AS ({_shingles("documents", "doc_id", _WORDS)}), i AS ({_shingles("benchmark", "item_id", _WORDS)}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item, count(*)::BIGINT AS n_shared, round(count(*)::DOUBLE / n, 6) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 10 * count(*) >= 8 * n
"""

_KINDS = (
    (0, "assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    (4, "slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    (5, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    (6, "pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
)


def _kind_rows() -> str:
    parts = []
    for rank, kind, pattern, group, least in _KINDS:
        parts.append(f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, {least} AS least, unnest(m) AS m, unnest(v) AS v, unnest(g) AS g, generate_subscripts(m, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
    (string_split_regex(text, '{pattern}'))[1:len(regexp_extract_all(text, '{pattern}'))] AS g FROM d)""")
    return " UNION ALL ".join(parts)


OP7 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
x AS ({_kind_rows()}),
y AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS e FROM x),
z AS (SELECT r, rank, kind, kind || ':' || (e - length(m)) || ':' || e AS s, e - length(m) AS b FROM y WHERE length(v) >= least),
a AS (
  SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(s, ',' ORDER BY b, rank) FILTER (WHERE rank < 3) AS base, string_agg(s, ',' ORDER BY b, rank) AS spans FROM z GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""



def _edit_rows() -> str:
    """From each state by each symbol: goal, cost, initials, inserted lines and the role given (null: the own one; empty: none)."""
    answers = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    rows = []
    for symbol in "suaoSUAOx":
        for origin in range(4):
            for inserted in range(3):
                state, lines = origin, ""
                for _ in range(inserted):
                    state, role = answers[state]
                    lines += f"|{role}:"
                head = f"{origin}, '{symbol}'"
                rows.append(f"({head}, {state}, {2 * inserted + 3}, '{'I' * inserted}D', '{lines}', '')")
                if symbol == "x":
                    continue
                late = int(symbol in "SUAO")
                goal, role = answers[state]
                rows.append(f"({head}, {goal}, {2 * inserted + 2 + late}, '{'I' * inserted}R', '{lines}', '{role}')")
                kind = symbol.lower()
                if kind == role[0] or (kind == "s" and state == 0):
                    rows.append(f"({head}, {1 if kind == 's' else goal}, {2 * inserted + late}, '{'I' * inserted}K', '{lines}', NULL)")
    return ", ".join(rows)


OP11 = rf"""
WITH RECURSIVE g(n, k, c) AS (
  SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM g WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM g WHERE k = 8),
known AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (
  SELECT c, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations JOIN known USING (conv_id) CROSS JOIN crc
  UNION ALL
  SELECT c, turn::BIGINT, coalesce(role, ' '), coalesce(text, ' '),
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(' :' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20
  FROM conversations JOIN known ON conversations.conv_id IS NULL AND known.conv_id IS NULL CROSS JOIN crc
),
d AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM o, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'none' END AS fault,
    lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS two
  FROM n
),
s AS (
  SELECT c, i, role, text, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END)
    WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS symbol
  FROM f
),
e(origin, symbol, goal, cost, initials, lines, given) AS (VALUES {_edit_rows()}),
w(c, i, state, way) AS (
  SELECT DISTINCT c, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'said': ''}} FROM d
  UNION ALL
  SELECT w.c, s.i, e.goal, min({{'cost': way.cost + e.cost, 'audit': way.audit || e.initials,
    'said': way.said || replace(e.lines, '|', chr(10)) || CASE WHEN e.given = '' THEN '' ELSE chr(10) || coalesce(e.given, s.role) || ':' || s.text END}})
  FROM w JOIN s ON s.c = w.c AND s.i = w.i + 1 JOIN e ON e.origin = w.state AND e.symbol = s.symbol
  GROUP BY w.c, s.i, e.goal
),
z AS (
  SELECT c, min({{'cost': way.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': way.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'said': way.said || CASE state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS way
  FROM w JOIN (SELECT c, max(i) AS i FROM n GROUP BY c) USING (c, i) GROUP BY c
),
a AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
  coalesce(way.audit, '') AS audit, sha256(coalesce(substr(way.said, 2), '')) AS repaired_sha256
FROM known LEFT JOIN a USING (c) LEFT JOIN z USING (c)
"""


def _terms(table: str) -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT *, row_number() OVER () AS r, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table} WHERE text IS NOT NULL"


OP12 = rf"""
WITH d AS ({_terms("documents")}), i AS ({_terms("benchmark")}),
c AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
p AS (SELECT r, word, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
q AS (SELECT r AS q, word, count(*)::BIGINT AS times FROM (SELECT r, unnest(w) AS word FROM i) GROUP BY r, word),
f AS (SELECT word, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p CROSS JOIN c GROUP BY word),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * nn) // ll AS m FROM d CROSS JOIN c WHERE len(w) > 0),
s AS (
  SELECT q, r, m.doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (word) JOIN f USING (word) JOIN m USING (r) GROUP BY q, r, m.doc_id
),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i ON i.r = k.q WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_licenses": OP2,
    "op5_near_duplicates": OP5,
    "op6_decontamination": OP6,
    "op7_secrets": OP7,
    "op11_structure_repair": OP11,
    "op12_ranked_search": OP12,
    "op13_ngram_join": OP13,
}
