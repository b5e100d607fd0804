"""MinHash near-deduplication with circulant permutations.

Two permutations, one of them circularly shifted, give all signature coordinates;
bands of coordinates put documents into buckets; every link is confirmed on the full
shingle sets.  Groups are never expanded into all their pairs:

* documents with equal shingle sets are one class with one representative;
* in each bucket the members are compared with the bucket's least member, and
  confirmed links are closed into components;
* where a bucket still holds several components, small buckets compare the members of
  different components, and the members of large ones go through an exact prefix
  filter (rarest shingles first), which no linked pair can fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.shared import components, with_key, without_key, written
from feedlens.llm.textkit import SPACE_BYTES, CirculantMinHash, WordHasher, batches, mix64, shingle_set

BANDS = 24
ROWS = 4
SMALL_BUCKET = 16

_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("no_id", T.BooleanType()),
        T.StructField("class_hi", T.LongType()),
        T.StructField("class_lo", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """Per document: a 128-bit digest of its shingle set, the set's size and its band keys."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, minhash = WordHasher(SPACE_BYTES), CirculantMinHash(bands * rows)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for whole in parts:
            for part in batches(whole):
                his, los, sizes, keys = [], [], [], []
                for words in hasher.words(part["text"].tolist()):
                    items = shingle_set(words, k)
                    his.append(np.sum(mix64(items ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
                    los.append(np.sum(mix64(items + np.uint64(0x14057B7EF767814F)), dtype=np.uint64))
                    sizes.append(len(items))
                    if not len(items):
                        keys.append(None)
                        continue
                    wide = minhash.signature(items).reshape(bands, rows).astype(np.uint64)
                    key = salt.copy()
                    for j in range(rows):
                        key = mix64(key ^ wide[:, j]) + np.uint64(j)
                    keys.append(key.view(np.int64))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "no_id": part["no_id"].to_numpy(),
                        "class_hi": np.array(his, dtype=np.uint64).view(np.int64),
                        "class_lo": np.array(los, dtype=np.uint64).view(np.int64),
                        "n_shingles": np.array(sizes, dtype=np.int64),
                        "bands": keys,
                    }
                )

    return without_key(with_key(docs.select("doc_id", "text")).mapInPandas(sign, _SIGNED))


def full_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per document (no doc_id may be null), its whole shingle set as sorted hashes."""

    def collect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(SPACE_BYTES)
        for whole in parts:
            for part in batches(whole):
                items = [shingle_set(words, k).view(np.int64) for words in hasher.words(part["text"].tolist())]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "items": items})

    return docs.select("doc_id", "text").mapInPandas(collect, _SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b") - both).alias("either"))
        .where(100 * F.col("both") >= percent * F.col("either"))
        .select("a", "b")
    )


def _apart(members: DataFrame, key: str) -> DataFrame:
    """Rows (key, rep, n, comp) of the keys that hold several components, with the number of rows."""
    mixed = members.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held"))
    return members.join(mixed.where("lo < hi").select(key, "held"), key)


def _across(members: DataFrame, key: str, percent: int, placed: bool = False) -> DataFrame:
    """Distinct pairs of members of one key in different components whose sizes (and the key's places in their prefixes) allow a link."""
    names = ["rep", "n", "comp", *(["place"] if placed else [])]
    left = members.select(key, *[F.col(c).alias(f"{c}_a") for c in names])
    right = members.select(key, *[F.col(c).alias(f"{c}_b") for c in names])
    fits = (F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b"))
    fits &= 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    if placed:
        # sets that share ``least`` items share one among the first n - least + 1 of each
        least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
        fits &= (F.col("place_a") <= F.col("n_a") - least + 1) & (F.col("place_b") <= F.col("n_b") - least + 1)
    return left.join(right, (left[key] == right[key]) & fits).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (item, rep, n, comp, place): of each member the rarest shingles, one more than a linked text may lack."""
    rows = members.join(sets, "rep").select("rep", "n", "comp", F.explode("items").alias("item"))
    counts = rows.groupBy("item").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "item"))
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.join(counts, "item").withColumn("place", place).where(F.col("place") <= lacking).select("item", "rep", "n", "comp", "place")


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text, ...): one row per input row.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach) and
    kept (doc_id = component_id).  Null or word-less texts have no shingles and link to
    nothing; fewer than k words are one shingle.  A null doc_id has a null component and
    is kept, as nothing can be said to repeat it.  Rows that share a doc_id count as one
    node; all of them are returned.  Long texts and long words are read whole; an empty
    table gives no rows.  Extra columns are ignored.
    """
    signed = written(signatures(docs, bands, rows, k), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        real.groupBy("class_hi", "class_lo").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    member = written(
        real.select("doc_id", "class_hi", "class_lo").join(classes.select("class_hi", "class_lo", "rep"), ["class_hi", "class_lo"]).where("doc_id <> rep").select("doc_id", "rep").distinct(),
        "members",
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    crowded = written(banded.join(leaders, "bucket").select("bucket", "rep", "n", "leader"), "buckets")
    wanted = crowded.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = written(full_sets(texts, k).withColumnRenamed("doc_id", "rep"), "sets")
    star = crowded.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(confirmed(star, sets, percent), "links")
    found = components(links)
    placed = crowded.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    mixed = written(_apart(placed, "bucket"), "mixed")
    few = _across(mixed.where(F.col("held") <= SMALL_BUCKET), "bucket", percent)
    many = mixed.where(F.col("held") > SMALL_BUCKET).select("rep", "n", "comp").distinct()
    listed = _apart(_prefixes(many, sets, percent), "item")
    later = written(few.union(_across(listed, "item", percent, placed=True)).distinct(), "later")
    more = written(confirmed(later, sets, percent), "more")
    same = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    closed = components(found.toDF("a", "b").union(more).union(same)).toDF("node", "component")
    place = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(closed, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", place.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
