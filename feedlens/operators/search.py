"""Full-text search: BM25 over words, phrases, prefixes and their combinations; snippets.

A search is given as a tree of Term, All, Any and But; a language for it is left to the
caller.  Each document is read on its own, so nothing but the corpus statistics, one
row, moves between tasks.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
_TOKEN = r"[\p{L}\p{N}]+"
COLUMNS = ("title", "body")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


@dataclass(frozen=True)
class Term:
    """Words that stand one after another, in one column or any; of a prefix, the last word may go on."""

    words: str
    column: str | None = None
    prefix: bool = False


@dataclass(frozen=True)
class All:
    """What matches every part."""

    parts: tuple


@dataclass(frozen=True)
class Any:
    """What matches some part."""

    parts: tuple


@dataclass(frozen=True)
class But:
    """What matches the first search and not the second."""

    match: Term | All | Any | But
    none: Term | All | Any | But


Search = Term | All | Any | But


def _terms(search: Search) -> list[Term]:
    if isinstance(search, Term):
        return [search]
    parts = (search.match, search.none) if isinstance(search, But) else search.parts
    return list(dict.fromkeys(t for p in parts for t in _terms(p)))


def _count(term: Term, words: dict[str, Column]) -> Column:
    """Places of a term in a document's words."""
    own = re.findall(r"[^\W_]+", term.words.lower())
    if not own:
        return F.lit(0)

    def places(held: Column) -> Column:
        def here(first: Column, i: Column) -> Column:
            parts = [first, *[F.get(held, i + j) for j in range(1, len(own))]]
            tests = [p.startswith(w) if term.prefix and j == len(own) - 1 else p == w for j, (p, w) in enumerate(zip(parts, own, strict=True))]
            return F.coalesce(functools.reduce(operator.and_, tests), F.lit(False))

        return F.size(F.filter(held, here))

    sizes = [places(words[name]) for name in ((term.column,) if term.column else COLUMNS)]
    return functools.reduce(operator.add, sizes)


def _matches(search: Search, counts: dict[Term, Column]) -> Column:
    if isinstance(search, Term):
        return counts[search] > 0
    if isinstance(search, But):
        return _matches(search.match, counts) & ~_matches(search.none, counts)
    return functools.reduce(operator.and_ if isinstance(search, All) else operator.or_, [_matches(p, counts) for p in search.parts])


def weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """BM25 of one term in one document; a term that half of the documents hold hardly counts."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(docs: DataFrame, key: str, match: Search, limit: int = 20) -> DataFrame:
    """(key, rank) of the best documents (key, title, body), rank ascending (negative is better).

    One pass counts the documents, their words and each term's documents; a second one
    ranks the documents that match.
    """
    terms = _terms(match)
    if limit <= 0 or not any(re.search(r"[^\W_]", t.words) for t in terms):
        return docs.select(key, F.lit(0.0).alias("rank")).where(F.lit(False))
    words = docs.select(key, *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    counted = words.select(key, (F.size("title") + F.size("body")).alias("dl"), F.array(*[_count(t, {c: F.col(c) for c in COLUMNS}) for t in terms]).alias("tf"))
    holding = [F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*holding).alias("df"))
    tf = {t: F.get("tf", F.lit(i)) for i, t in enumerate(terms)}
    found = counted.where(_matches(match, tf)).crossJoin(F.broadcast(stats))
    ranks = [weight(tf[t], F.get("df", F.lit(i)), F.col("dl"), F.col("n"), F.col("avgdl")) for i, t in enumerate(terms)]
    return found.select(key, (-functools.reduce(operator.add, ranks)).alias("rank")).orderBy("rank", key).limit(limit)


def snippet(body: Column, words: list[str], size: int = 32) -> Column:
    """The body with hits in <b></b>; a longer one is cut to the window of ``size`` words that holds the most hits.

    Words lie between blanks.  Of equal windows the first counts; it begins at its first
    hit, or earlier where the body ends before the window does.
    """
    mark = F.regexp_replace(body, rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, words))})(?![\p{{L}}\p{{N}}])", "<b>$1</b>")
    parts = F.split(mark, r"\s+")
    hits = F.filter(F.transform(parts, lambda p, i: F.when(p.contains("<b>"), i)), lambda i: i.isNotNull())
    # from hit to hit, how many lie before the window's end; the hits are in order
    held = F.transform(hits, lambda x, i: F.struct((F.size(F.filter(F.slice(hits, i + 1, F.lit(size)), lambda y: y < x + size))).alias("n"), (-x).alias("back")))
    first = -F.array_max(held)["back"]
    start = F.greatest(F.lit(1), F.least(F.coalesce(first, F.lit(0)) + 1, F.size(parts) - size + 1))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(F.slice(parts, start, F.lit(size)), " "), F.when(start + size - 1 < F.size(parts), "...").otherwise(""))
    return F.when(F.size(parts) <= size, mark).otherwise(cut)


#: Tokens whose places are listed at once.
LISTED_AT_ONCE = 1 << 20


def _sliced(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch of rows (key, tokens of each field) in stretches of about so many tokens, of one row at least."""
    sizes = sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in COLUMNS)
    part = (np.cumsum(sizes) - sizes) // limit
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []
    for begin, end in zip(cut, [*cut[1:], len(part)], strict=True):
        yield batch.slice(begin, end - begin)


def _listed(names: list[str], limit: int):
    """Rows (key, field, token, places) of each document, which never leaves its task."""

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, owner, place, field = [], [], [], []
        for f, name in enumerate(COLUMNS):
            held = batch.column(name)
            sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
            flat.append(held.flatten())
            owner.append(np.repeat(np.arange(len(sizes)), sizes))
            place.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            field.append(np.full(sizes.sum(), f))
        coded = pa.concat_arrays(flat).dictionary_encode()
        owner, place, field = (np.concatenate(x) for x in (owner, place, field))
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rank = (owner * len(coded.dictionary) + code) * len(COLUMNS) + field
        # stable: places stay in order
        order = np.argsort(rank, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], np.diff(rank[order]) != 0))) if len(order) else order
        one = order[begin]
        ends = np.append(begin, len(order)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
        named = pa.array(COLUMNS, coded.dictionary.type).take(pa.array(field[one]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[one])), named, coded.dictionary.take(pa.array(code[one])), listed], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _sliced(whole, limit):
                yield places(part)

    return run


def postings(docs: DataFrame, key: str, limit: int = LISTED_AT_ONCE) -> DataFrame:
    """(key, field, token, places) of documents (key, title, body): where each word stands, from 0.

    A row of documents has a posting for each of its words; words aren't shuffled to be listed.
    """
    rows = docs.select(key, *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    schema = T.StructType([rows.schema[0]]).add("field", "string").add("token", "string").add("places", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_listed(schema.names, limit), schema)


def upsert_postings(held: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Postings with those of the given documents (one row a key) replaced; all others stay as they are.

    Both parts are dealt by key, so that what counts by key and token needs no further shuffle.
    """
    kept = held.repartition(key).join(docs.select(key).distinct(), key, "left_anti")
    return kept.unionByName(postings(docs, key).repartition(key))
