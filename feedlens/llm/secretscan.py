"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a text is addressed by the digest of its content.  Only pairs
of blob and rule version that the ledger does not hold are scanned, each blob once, and
findings are joined back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost, non-overlapping matches whose group is long enough."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    #: A cheap necessary condition on the text.
    hint: str | None = None


#: A run of hex digits or an access key of the least length or more is the same as any run, kept if long enough.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

_BLOCK = 128


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often lambdas below refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    """Numbers of the blocks of an array."""
    n = F.ceil(F.size(values) / _BLOCK).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _block(values: Column, number: Column) -> Column:
    return F.slice(values, number * _BLOCK + 1, F.lit(_BLOCK))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes of zero and the values before each, by blocks, so that many matches do not cost a square."""
    zero = F.lit(0).cast("long")

    def folded(xs: Column) -> Column:
        def within(totals: Column) -> Column:
            def one(b: Column) -> Column:
                ahead = F.aggregate(F.slice(totals, F.lit(1), b), zero, add)
                return _let(
                    F.struct(ahead.alias("ahead"), _block(xs, b).alias("own")),
                    lambda x: F.transform(x["own"], lambda _, i: F.aggregate(F.slice(x["own"], F.lit(1), i), x["ahead"], add)),
                )

            return F.flatten(F.transform(_blocks(xs), one))

        return _let(F.transform(_blocks(xs), lambda b: F.aggregate(_block(xs, b), zero, add)), within)

    return _let(values, folded)


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in a text, in code points, from what lies between the matches."""
    pattern = F.lit(rule.pattern)
    lengths = lambda texts: F.transform(texts, lambda x: F.length(x).cast("long"))
    found = F.struct(
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("sizes"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("values"),
        lengths(F.split(text, rule.pattern, -1)).alias("gaps"),
    )

    def located(x: Column) -> Column:
        gaps = F.slice(x["gaps"], F.lit(1), F.size(x["sizes"]))
        before = _running(F.zip_with(gaps, x["sizes"], lambda a, b: a + b), lambda a, b: a + b)
        rows = F.arrays_zip(before.alias("before"), gaps.alias("gap"), x["sizes"].alias("size"), x["values"].alias("value"))
        return F.transform(
            F.filter(rows, lambda r: r["value"] >= rule.at_least),
            lambda r: F.struct(
                (r["before"] + r["gap"]).alias("start"),
                F.lit(rank).alias("rank"),
                (r["before"] + r["gap"] + r["size"]).alias("end"),
                F.lit(rule.kind).alias("kind"),
            ),
        )

    spans = _let(found, located)
    return F.when(text.rlike(rule.hint or rule.pattern), spans).otherwise(F.array()).cast(_SPAN)


def text_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then rule order; null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[rule_spans(text, rule, i) for i, rule in enumerate(rules)]))


def with_blobs(history: DataFrame) -> DataFrame:
    """Adds blob_id, the SHA-256 of the text's UTF-8 bytes (null counts as empty)."""
    return history.withColumn("blob_id", F.sha2(F.coalesce("text", F.lit("")), 256))


def unseen(history: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (blob_id, text) for each blob that these rules have not scanned."""
    blobs = with_blobs(history.select("text"))
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob_id").distinct()
        blobs = blobs.join(done, "blob_id", "left_anti")
    return blobs.groupBy("blob_id").agg(F.first("text").alias("text"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob_id, rule_version, spans) for the blobs of a history (any columns, text) not yet scanned.

    A span is (start, rank, end, kind).  Null texts are empty blobs; an empty history adds
    no rows; repeated texts are one blob; spans of one start are ordered by rule.  Long texts
    are read whole.
    """
    found = text_spans(F.col("text"), rules)
    return unseen(history, ledger, rules).select("blob_id", F.lit(rule_version(rules)).alias("rule_version"), found.alias("spans"))


_LEDGER = f"blob_id string, rule_version string, spans {_SPAN}"


def stored_ledger(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame | None:
    """What the ledger stored under a path knows by these rules (one folder a rule version); None if it has no such folder."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{path}/{rule_version(rules)}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update(history: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the blobs that the ledger stored under a path lacks, adds them to it, and returns all it knows by these rules.

    Other rules, or the same in another order, are another version, by which every blob is
    unseen.  Rows tell of one blob each, so that those of a write that broke off are right,
    and the next one scans what is left.  One writer at a time.
    """
    spark = history.sparkSession
    new = scan(history, stored_ledger(spark, path, rules), rules)
    new.write.mode("append").option("compression", "zstd").parquet(f"{path}/{rule_version(rules)}")
    return spark.read.schema(_LEDGER).parquet(f"{path}/{rule_version(rules)}")


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of the history with ``spans``: what the ledger knows of its text (no row is lost).

    A column of the history named blob_id or spans is replaced.
    """
    known = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob_id", "spans")
    rows = with_blobs(history.drop("blob_id", "spans"))
    return rows.join(known, "blob_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch of spans, ordered by start, replaced by ``[REDACTED]``; overlapping ones are one stretch.

    The text is cut once a block of spans, and each span's piece from its block's.
    """

    def pieces(rows: Column) -> Column:
        def block(own: Column) -> Column:
            begin = F.get(own, F.lit(0))["before"]
            cut = F.substring(text, (begin + 1).cast("int"), (F.get(own, F.size(own) - 1)["start"] - begin).cast("int"))

            def piece(part: Column) -> Column:
                lead = lambda r: F.substring(part["cut"], (r["before"] - part["begin"] + 1).cast("int"), (r["start"] - r["before"]).cast("int"))
                return F.array_join(F.transform(own, lambda r: F.when(r["start"] >= r["before"], F.concat(lead(r), F.lit("[REDACTED]"))).otherwise("")), "")

            return _let(F.struct(begin.alias("begin"), cut.alias("cut")), piece)

        parts = F.transform(_blocks(rows), lambda b: _let(_block(rows, b), block))
        last = F.array_max(F.transform(rows, lambda r: r["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    rows = F.arrays_zip(F.transform(spans, lambda s: s["start"]).alias("start"), _running(ends, lambda a, b: F.greatest(a, b)).alias("before"), ends.alias("end"))
    return F.when(F.size(spans) > 0, _let(rows, pieces)).otherwise(text)
