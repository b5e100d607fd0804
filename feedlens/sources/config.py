"""Source and entity definitions from configuration rows, with typed values and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text fields of a source and what stands in for a missing one.
TEXT_DEFAULTS = {
    "name": "Unnamed Source",
    "type": "rss",
    "url": "",
    "id": "",
    "language": "",
    "country": "",
    "region": "",
    "trust_tier": "T3_professional",
    "content_type": "news",
    "collection_tier": "C1_rss",
    "producer_role": "",
    "notes": "",
}


def with_variables(text: Column, variables: dict[str, str]) -> Column:
    """Text with each ``${NAME}`` replaced by the variable's value, or by nothing where there is none; values are not looked into again."""
    known = F.create_map(*[F.lit(x) for kv in variables.items() for x in kv]) if variables else F.create_map().cast("map<string,string>")
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\$\{[^}]+\}|\$|[^$]+"), F.lit(0))
    value = lambda p: F.coalesce(F.try_element_at(known, F.regexp_extract(p, r"(?s)^\$\{(.+)\}$", 1)), F.lit(""))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"(?s)^\$\{.+\}$"), value(p)).otherwise(p)), "")


def _member(row: Column, name: str) -> Column:
    return F.try_variant_get(row, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_value(value: Column, default: str, variables: dict[str, str]) -> Column:
    """A text that is not blank, else the default; numbers and other kinds are no texts."""
    text = F.when(_kind(value) == "STRING", with_variables(value.cast("string"), variables))
    return F.when(text.rlike(r"\S"), text).otherwise(default)


def bool_value(value: Column, default: bool, variables: dict[str, str]) -> Column:
    """True or false, also as one of their usual words, else the default."""
    word = F.lower(F.trim(F.when(_kind(value) == "STRING", with_variables(value.cast("string"), variables))))
    return (
        F.when(_kind(value) == "BOOLEAN", value.cast("boolean"))
        .when(word.isin("true", "1", "yes", "y"), True)
        .when(word.isin("false", "0", "no", "n"), False)
        .otherwise(default)
    )


def number_value(value: Column, default: float, variables: dict[str, str]) -> Column:
    """A number, also as text; true and false count as 1 and 0; anything else gives the default."""
    text = F.trim(F.when(_kind(value) == "STRING", with_variables(value.cast("string"), variables))).try_cast("double")
    truth = F.when(_kind(value) == "BOOLEAN", value.cast("boolean").cast("double"))
    plain = F.when(_kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), value.cast("double"))
    return F.coalesce(plain, truth, text, F.lit(default))


def texts_value(value: Column, variables: dict[str, str]) -> Column:
    """The entries of a list (or one text as such a list), trimmed, without blank ones."""
    listed = F.when(_kind(value).startswith("ARRAY"), F.transform(value.cast("array<variant>"), lambda v: v.cast("string")))
    listed = F.coalesce(listed, F.when(_kind(value) == "STRING", F.array(value.cast("string"))), F.array().cast("array<string>"))
    return F.filter(F.transform(listed, lambda t: F.trim(with_variables(t, variables))), lambda t: t != "")


def typed_sources(rows: DataFrame, variables: dict[str, str] | None = None, body: str = "body") -> DataFrame:
    """Sources from rows that hold one JSON object each: text fields, enabled, weight and info_purpose.

    Missing values, and those of a wrong kind, take their defaults.  Rows that hold no
    JSON object, or an empty one, define no source.  Other columns of ``rows`` stay.
    """
    known = variables or {}
    parsed = rows.withColumn("_source", F.try_parse_json(body))
    parsed = parsed.where(_kind(F.col("_source")).startswith("OBJECT") & (F.size(F.col("_source").cast("map<string,variant>")) > 0))
    source = F.col("_source")
    made = [text_value(_member(source, n), d, known).alias(n) for n, d in TEXT_DEFAULTS.items()]
    made += [
        bool_value(_member(source, "enabled"), True, known).alias("enabled"),
        number_value(_member(source, "weight"), 1.0, known).alias("weight"),
        texts_value(_member(source, "info_purpose"), known).alias("info_purpose"),
    ]
    return parsed.select(*[c for c in rows.columns if c != body], *made)
