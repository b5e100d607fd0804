"""Stored JSON and dates of many forms, decoded value by value as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _object(json: Column) -> Column:
    """The members of a JSON object; null for anything else."""
    value = F.try_parse_json(json)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value).cast("map<string,variant>")


def _said(value: Column) -> Column:
    """A scalar as text, with the names that Python gives true, false and null; anything else as JSON."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(value.cast("string")))
        .otherwise(value.cast("string"))
    )


def decode_entities(json: Column) -> Column:
    """Map of entity to keywords from a JSON object; members that are no lists are left out, bad JSON gives an empty map."""
    lists = F.map_filter(_object(json), lambda _, v: F.schema_of_variant(v).startswith("ARRAY"))
    found = F.transform_values(lists, lambda _, v: F.transform(v.cast("array<variant>"), _said))
    return F.coalesce(found, F.create_map().cast("map<string,array<string>>"))


def decode_ontology(json: Column) -> Column:
    """Map of field to value (as text or JSON) from a JSON object, without blank fields; bad JSON gives an empty map."""
    named = F.map_filter(_object(json), lambda k, _: F.length(F.trim(k)) > 0)
    return F.coalesce(F.transform_values(named, lambda _, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def iso_datetime(value: Column) -> Column:
    """Timestamp of an ISO date or date and time; one without an offset is UTC, anything else null."""
    whole = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    plain = F.regexp_replace(value, r"(:\d{2}[+-]\d{2}|[T ]\d{2}[+-]\d{2})(\d{2})$", "$1:$2")
    for part in (r"[T ]\d{2}", r"[T ]\d{2}:\d{2}"):
        plain = F.regexp_replace(plain, rf"({part})(?=$|Z|[+-])", "$1:00")
    zoned = F.when(plain.rlike(r"(Z|[+-]\d{2}:\d{2})$"), plain).when(plain.rlike(r"[T ]"), F.concat(plain, F.lit("Z"))).otherwise(F.concat(plain, F.lit("T00:00:00Z")))
    return F.when(whole, F.try_to_timestamp(zoned))


def mail_datetime(value: Column) -> Column:
    """Timestamp of a date as mail and feeds write it; one without a zone is UTC, anything else null."""
    plain = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3,9},?\s+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r" (GMT|UTC|UT|Z)$", " +0000")
    plain = F.when(plain.rlike(r"[+-]\d{4}$"), plain).otherwise(F.concat(plain, F.lit(" +0000")))
    plain = F.regexp_replace(plain, r"(?<= \d{2}:\d{2})(?= [+-])", ":00")
    return F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))


def feed_datetime(published: Column, updated: Column, date: Column) -> Column:
    """The first of a feed entry's dates that can be read, written as in mail or in ISO form."""
    return F.coalesce(*[f(c) for c in (published, updated, date) for f in (mail_datetime, lambda x: iso_datetime(F.trim(x)))])


def utc_ntz(value: Column) -> Column:
    """A timestamp without a zone, in UTC, of an ISO text; one without an offset stays as it is."""
    seconds = F.unix_micros(iso_datetime(value))
    return F.to_timestamp_ntz(F.lit("1970-01-01T00:00:00")) + F.make_dt_interval(secs=(seconds / 1_000_000).cast("decimal(18,6)"))


#: Where an article's date stands, in order.
DATE_FIELDS = ("collected_at", "published_at", "published", "date")


def article_day(rows: DataFrame) -> Column:
    """The day of an article: its first field of DATE_FIELDS that holds a time, or a text whose first 19 characters are one.

    Empty texts and ones of other forms give way to the next field; fields that the rows lack are passed over.
    """
    found = []
    for name in DATE_FIELDS:
        if name not in rows.columns:
            continue
        if rows.schema[name].dataType.simpleString() != "string":
            found.append(F.to_date(name))
            continue
        text = F.substring(name, 1, 19)
        form = r"^(\d{4}-\d{1,2}-\d{1,2})([T ]\d{1,2}:\d{1,2}:\d{1,2})?$"
        time = F.transform(F.split(F.substring(F.regexp_extract(text, form, 2), 2, 8), ":"), lambda x: x.try_cast("int"))
        fits = (F.regexp_extract(text, form, 2) == "") | ((F.get(time, F.lit(0)) < 24) & (F.get(time, F.lit(1)) < 60) & (F.get(time, F.lit(2)) < 60))
        found.append(F.when(fits, F.try_to_date(F.regexp_extract(text, form, 1), "yyyy-M-d")))
    return F.coalesce(*found) if found else F.lit(None).cast("date")
