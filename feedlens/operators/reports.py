"""Source selection, summaries, report rows, the index of published reports and notification texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators.tagging import summary_row, top_entities

#: Longest text that a messenger takes.
MESSAGE_LIMIT = 4096


def select_sources(sources: DataFrame, exclude: list[str] = (), most: int | None = None, order: str = "pos") -> DataFrame:
    """Sources (id, name, ...) without the excluded ones, then the first ``most`` by ``order``.

    A source is excluded by its id or its name; case and outer blanks don't count, and
    empty tokens exclude nothing.  ``most`` of None, 0 or less is no limit.
    """
    tokens = sorted({t.strip().lower() for t in exclude} - {""})
    kept = sources
    if tokens:
        listed = [F.coalesce(F.lower(F.trim(c)).isin(tokens), F.lit(False)) for c in ("id", "name")]
        kept = sources.where(~(listed[0] | listed[1]))
    return kept.orderBy(order).limit(most) if most and most > 0 else kept


def _title_case(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def report_index(files: DataFrame) -> DataFrame:
    """Report pages of a listing (name): name, display_name and date (empty where the name tells none).

    Known are ``{category}_{yyyymmdd}.html``, other pages at the top and
    ``{yyyy-mm-dd}/index.html``; the top index and all other files are left out.  Sort by
    date and name, both falling, for the order of the index.
    """
    name = F.col("name")
    dated = r"^(.+)_(\d{4})(\d{2})(\d{2})\.html$"
    folder = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})/index\.html$", 1)
    top = name.rlike(r"^[^/]+\.html$") & (name != "index.html")
    from_name = F.concat_ws("-", *[F.regexp_extract(name, dated, i) for i in (2, 3, 4)])
    date = F.when(top & name.rlike(dated), from_name).when(folder != "", folder).otherwise("")
    plain = _title_case(F.replace(F.regexp_replace(name, r"\.html$", ""), F.lit("_"), F.lit(" ")))
    shown = F.when(folder != "", folder).when(date != "", F.concat_ws(" - ", F.regexp_extract(name, dated, 1), "date")).otherwise(plain)
    return files.where(top | (folder != "")).withColumn("date", date).withColumn("display_name", shown).select("name", "display_name", "date")


def notification_text(category: Column, at: Column, sources: Column, collected: Column, matched: Column, errors: Column, url: Column | None = None, heading: str = "Pipeline Completion Report") -> Column:
    """A run's result under a heading, as a short marked-up message of at most MESSAGE_LIMIT characters."""
    # fixed values: the wording below the heading
    text = F.format_string(
        "*%s*\n\n*Category:* %s\n*Timestamp:* %s\n\n*Statistics:*\n  Sources: %d\n  Collected: %d\n  Matched: %d\n  Errors: %d",
        F.lit(heading), category, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), sources, collected, matched, errors,
    )
    if url is not None:
        text = F.concat(text, F.when(F.coalesce(url, F.lit("")) != "", F.format_string("\n\n[Report](%s)", url)).otherwise(""))
    return F.when(F.length(text) > MESSAGE_LIMIT, F.concat(F.substring(text, 1, MESSAGE_LIMIT - 3), F.lit("..."))).otherwise(text)


def mail_text(category: Column, at: Column, sources: Column, collected: Column, matched: Column, errors: Column, url: Column | None = None, heading: str = "Pipeline Completion Report") -> Column:
    """A run's result as the plain text of a mail; its heading is underlined as far as it goes."""
    # fixed values: the wording below the heading
    text = F.format_string(
        "%s\n\nCategory: %s\nTimestamp: %s\n\nStatistics:\n  Sources: %d\n  Collected: %d\n  Matched: %d\n  Errors: %d",
        F.lit(f"{heading}\n{'=' * len(heading)}"), category, iso_text(at), sources, collected, matched, errors,
    )
    if url is None:
        return text
    return F.concat(text, F.when(F.coalesce(url, F.lit("")) != "", F.format_string("\n\nReport: %s", url)).otherwise(""))


def iso_text(at: Column) -> Column:
    """ISO text of a time; the fraction is written only where there is one."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def report_rows(articles: DataFrame) -> DataFrame:
    """Articles as a report lists them: texts, ISO times (null where missing), entities (an empty map where missing), and the payload if there is such a column."""
    empty = F.create_map().cast("map<string,array<string>>")
    when = {
        "published_at": [c for c in ("published_at", "published", "event_ts") if c in articles.columns],
        "collected_at": [c for c in ("collected_at",) if c in articles.columns],
    }
    times = [iso_text(F.coalesce(*cs)).alias(n) if cs else F.lit(None).cast("string").alias(n) for n, cs in when.items()]
    rest = [c for c in ("event_model_payload",) if c in articles.columns]
    return articles.select("title", "link", "source", "summary", *times, F.coalesce("matched_entities", empty).alias("matched_entities"), *rest)


def summary_rows(tagged: DataFrame, order: str, top: int = 20, given: dict[str, int] | None = None) -> DataFrame:
    """A summary as rows (section, name, count): article_count, source_count and matched_count, each source, and the top entities.

    Of the three counts, those that the caller gives stand as they are given.

    The sections are separate aggregates; no list of them is built in one row.
    """
    one = summary_row(tagged)
    counts = F.array(*[F.struct(F.lit(n).alias("section"), F.lit("").alias("name"), F.lit((given or {}).get(n, F.col(n))).cast("long").alias("count")) for n in one.columns])
    sources = tagged.where("source <> ''").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("count"))
    best = top_entities(tagged, order, top).select(F.lit("top_entities").alias("section"), F.col("entity").alias("name"), F.col("hits").alias("count"))
    return one.select(F.inline(counts)).unionByName(sources.select(F.lit("sources").alias("section"), "name", "count")).unionByName(best)


def write_summary(rows: DataFrame, path: str, category: str, at: Column) -> None:
    """Writes a summary's rows as JSON lines with their category and day, a folder a section."""
    told = rows.select(F.lit(category).alias("category"), iso_text(at).alias("generated_at"), "*")
    told.write.mode("overwrite").partitionBy("section").json(path)


def extra_sections(rows: DataFrame) -> DataFrame:
    """Sections that a report adds (id, title, body_html, panel_title, subtitle, nav_label, aria_label, badges), trimmed.

    Sections without an id, a title or a body are left out; labels that are blank say the title.
    """
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("id", "title", "body_html", "panel_title", "subtitle", "nav_label", "aria_label")}
    labels = {c: F.coalesce(F.nullif(text[c], F.lit("")), text["title"]) for c in ("panel_title", "nav_label", "aria_label")}
    badges = F.filter(F.transform(F.coalesce("badges", F.array().cast("array<string>")), lambda b: F.trim(b)), lambda b: b != "")
    kept = rows.where((text["id"] != "") & (text["title"] != "") & (text["body_html"] != ""))
    return kept.select(*[c.alias(n) for n, c in (text | labels).items()], badges.alias("badges"))
