"""A stored inverted index: searches read the postings of their own words only.

Postings are partitioned by the first two characters of their word, so exact words and
prefixes read few folders, and within these the word is a pushed filter.  Documents
come in segments; of a document that is added again, the latest segment counts.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import search as plain
from feedlens.operators.search import COLUMNS, Search, Term

#: Folders of postings.
BUCKETS = 64
_LEAD = 2


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, _LEAD)), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """The folder of an index of documents (key, title, body)."""

    path: str
    key: str

    def _stored(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def add(self, docs: DataFrame) -> None:
        """Adds documents, one row a key, as a segment; those of known keys are replaced.

        The segment's postings are written first and its documents last: a segment whose
        write failed has no documents and is never read.
        """
        spark = docs.sparkSession
        held = self._stored(spark, "documents")
        segment = 1 + (held.agg(F.max("segment")).first()[0] or 0) if held is not None else 0
        rows = plain.postings(docs.select(F.col(self.key).alias("key"), *COLUMNS), "key")
        rows = rows.withColumn("bucket", _bucket(F.col("token"))).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(16)))
        rows.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        sizes = docs.select(F.col(self.key).alias("key"), functools.reduce(operator.add, [F.size(plain.tokens(F.col(c))) for c in COLUMNS]).alias("dl"))
        sizes.withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.path}/documents")

    def documents(self, spark: SparkSession) -> DataFrame | None:
        """(key, segment, dl) of the documents as they are now."""
        held = self._stored(spark, "documents")
        if held is None:
            return None
        return held.groupBy("key").agg(F.max_by(F.struct("segment", "dl"), "segment").alias("now")).select("key", "now.*")

    def postings(self, spark: SparkSession, terms: list[Term]) -> DataFrame:
        """(segment, key, field, token, places) of the terms' words, by folder and pushed filter."""
        tests, buckets = [], []
        for term in terms:
            own = _words(term)
            for j, word in enumerate(own):
                open_end = term.prefix and j == len(own) - 1
                tests.append(F.col("token").startswith(word) if open_end else F.col("token") == word)
                # a prefix shorter than what names the folder may be in any
                buckets.append(None if open_end and len(word) < _LEAD else word)
        rows = spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")
        if None not in buckets:
            named = spark.range(1).select(*[_bucket(F.lit(w)).alias(f"b{i}") for i, w in enumerate(buckets)]).first()
            rows = rows.where(F.col("bucket").isin(sorted(set(named))))
        return rows.where(functools.reduce(operator.or_, tests)).select("segment", "key", "field", "token", "places")


def _words(term: Term) -> list[str]:
    return re.findall(r"[^\W_]+", term.words.lower())


def _places(terms: list[Term]) -> Column:
    """For a posting, the structs (term, word) for which it counts."""
    found = []
    for i, term in enumerate(terms):
        own = _words(term)
        for j, word in enumerate(own):
            fits = F.col("token").startswith(word) if term.prefix and j == len(own) - 1 else F.col("token") == word
            if term.column:
                fits &= F.col("field") == term.column
            found.append(F.when(fits, F.struct(F.lit(i).alias("term"), F.lit(j).alias("word"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def search(index: Index, spark: SparkSession, match: Search, limit: int = 20) -> DataFrame:
    """(key, rank) of the best documents, as ``search.search`` gives them, from the index.

    A phrase is met where its words' places, moved back by their order, agree.  Only the
    postings of the search's words are read; statistics come from the documents' sizes.
    Without an index, a word or a limit there are no rows.
    """
    terms = [t for t in plain._terms(match) if _words(t)]
    docs = index.documents(spark)
    if docs is None or limit <= 0 or not terms:
        kind = docs.schema["key"].dataType.simpleString() if docs is not None else "string"
        return spark.createDataFrame([], f"`{index.key}` {kind}, rank double")
    sizes = [len(_words(t)) for t in terms]
    hits = index.postings(spark, terms).join(docs, ["key", "segment"])
    rows = hits.select("key", "dl", "field", "places", F.explode(_places(terms)).alias("at")).select("key", "dl", "field", "at.*", "places")
    # per word all its places, moved to where the phrase would begin
    words = rows.groupBy("key", "dl", "field", "term", "word").agg(F.flatten(F.collect_list("places")).alias("places"))
    moved = words.withColumn("places", F.transform("places", lambda p: p - F.col("word")))
    phrases = moved.groupBy("key", "dl", "field", "term").agg(F.collect_list("places").alias("parts"))
    whole = F.array(*[F.lit(n) for n in sizes])
    phrases = phrases.where(F.size("parts") == F.get(whole, F.col("term")))
    common = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.array_distinct(F.get("parts", F.lit(0))), lambda a, x: F.array_intersect(a, x))
    counted = phrases.withColumn("tf", F.size(common)).where("tf > 0").groupBy("key", "dl", "term").agg(F.sum("tf").alias("tf"))
    holding = counted.groupBy("term").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    held = holding.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    per_key = counted.groupBy("key", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf"))
    tf = {t: F.coalesce(F.try_element_at("tf", F.lit(i)), F.lit(0)) for i, t in enumerate(terms)}
    tf |= {t: F.lit(0) for t in plain._terms(match) if t not in tf}
    df = {t: F.coalesce(F.try_element_at("df", F.lit(i)), F.lit(0)) for i, t in enumerate(terms)}
    found = per_key.where(plain._matches(match, tf)).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(held))
    rank = functools.reduce(operator.add, [plain.weight(tf[t], df[t], F.col("dl"), F.col("n"), F.col("avgdl")) for t in terms])
    return found.select(F.col("key").alias(index.key), (-rank).alias("rank")).orderBy("rank", index.key).limit(limit)
