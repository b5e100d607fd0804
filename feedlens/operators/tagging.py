"""Entity tagging by keyword rules, and what is counted of it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.text import ENTITY_STOPWORDS, WORD, folded, holds_keyword

Rules = list[tuple[str, list[str]]]


def matched_entities(title: Column, summary: Column, rules: Rules) -> Column:
    """Map of each entity with hits to its keywords that hit, in rule order.

    All rules are compiled into one projection, which folds the text once for all of them.
    Of rules with the same name, the last one with hits counts; the name stands where its
    first rule does.
    """
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    named: dict[str, list[list[str]]] = {}
    for name, keywords in rules:
        if any(keywords):
            named.setdefault(name, []).insert(0, [k for k in keywords if k])
    if not named:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))

    def hits(held: Column, keywords: list[str]) -> Column:
        found = F.array_compact(F.array(*[F.when(holds_keyword(held["low"], held["fold"], k), F.lit(k.lower())) for k in keywords]))
        return F.when(F.size(found) > 0, found)

    def entries(held: Column) -> Column:
        rows = [F.struct(F.lit(name).alias("key"), F.coalesce(*[hits(held, ks) for ks in groups]).alias("value")) for name, groups in named.items()]
        return F.map_from_entries(F.filter(F.array(*rows), lambda e: e["value"].isNotNull()))

    return F.get(F.transform(F.array(F.struct(F.lower(text).alias("low"), folded(text).alias("fold"))), entries), F.lit(0))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (rule, name, keywords) by keyword: (feature, kind, rule, name, first, pos, low, pattern).

    A text that holds a keyword has its feature: the longest word of a keyword of whole
    words, or else its first two characters.
    """
    first = rules.groupBy("name").agg(F.min("rule").alias("first"))
    rows = rules.select("rule", "name", F.posexplode("keywords").alias("pos", "keyword")).where("keyword <> ''").join(first, "name")
    low = F.lower("keyword")
    rows = rows.withColumn("low", low).withColumn("plain", ~F.col("low").rlike(r"[^\x00-\x7F]"))
    words = F.regexp_extract_all("low", F.lit(r"[a-z0-9_]+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    by_word = F.col("plain") & (F.size(words) > 0)
    inner = lambda c: c.rlike("^[a-z0-9_]$")
    before = F.when(inner(F.substring("low", 1, 1)), f"(?<![{WORD}]").otherwise(f"(?<=[{WORD}]")
    after = F.when(inner(F.substring("low", -1, 1)), f"(?![{WORD}])").otherwise(f"(?=[{WORD}])")
    escaped = F.regexp_replace("low", r"([^a-z0-9_])", r"\\$1")
    return rows.select(
        F.when(by_word, longest).otherwise(F.substring("low", 1, 2)).alias("feature"),
        F.when(by_word, "word").when(F.length("low") > 1, "pair").otherwise("letter").alias("kind"),
        "rule", "name", "first", "pos", "low",
        F.when(F.col("plain"), F.concat(F.lit("(?iu)"), escaped, before, escaped, F.lit(")"), after)).alias("pattern"),
    )


def tag_by_table(articles: DataFrame, rules: DataFrame, key: str = "link") -> DataFrame:
    """Articles (key, title, summary, ...) with matched_entities, as ``matched_entities`` gives them, by a table of rules.

    Rules (rule, name, keywords) may be many: an article's distinct words, and pairs of
    letters if a rule needs them, meet the rules' features in a join of narrow rows, and only
    rules that meet are tested on the text.  Keys are unique; an article without hits has an empty map.
    """
    table = rule_table(rules)
    kinds = {r["kind"] for r in table.select("kind").distinct().collect()}
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    rows = articles.select(key, text.alias("_text"))
    low = folded(F.col("_text"))
    letters = F.split(F.lower("_text"), "")
    features = {
        "word": lambda: F.regexp_extract_all(low, F.lit(f"[{WORD}]+"), F.lit(0)),
        "pair": lambda: F.transform(letters, lambda c, i: F.concat(c, F.coalesce(F.get(letters, i + 1), F.lit("")))),
        "letter": lambda: letters,
    }
    held = [rows.select(key, F.lit(kind).alias("kind"), F.explode(F.array_distinct(features[kind]())).alias("feature")) for kind in sorted(kinds)]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    if not held:
        return articles.withColumn("matched_entities", empty)
    met = functools.reduce(DataFrame.unionByName, held).join(table, ["kind", "feature"]).groupBy(key)
    met = met.agg(F.collect_list(F.struct("rule", "name", "first", "pos", "low", "pattern")).alias("_rules"))
    fits = F.filter("_rules", lambda r: F.when(r["pattern"].isNull(), F.contains(F.lower("_text"), r["low"])).otherwise(F.regexp_like("_text", r["pattern"])))
    hits = rows.join(met, key).select(key, F.inline(fits))
    by_rule = hits.groupBy(key, "name", "first", "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "low"))), lambda x: x["low"]).alias("found"))
    by_name = by_rule.groupBy(key, "name", "first").agg(F.max_by("found", "rule").alias("found"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("first", "name", "found"))), lambda x: F.struct(x["name"], x["found"]))
    tagged = by_name.groupBy(key).agg(F.map_from_entries(entries).alias("matched_entities"))
    return articles.join(tagged, key, "left").withColumn("matched_entities", F.coalesce("matched_entities", empty))


def entity_counts(tagged: DataFrame, order: str) -> DataFrame:
    """Per entity the number of keyword hits and its first place, for stable ties."""
    rows = tagged.select(order, F.explode("matched_entities").alias("entity", "hits"))
    return rows.where("entity <> ''").groupBy("entity").agg(F.sum(F.size("hits")).cast("long").alias("hits"), F.min(order).alias("first_pos"))


def top_entities(tagged: DataFrame, order: str, limit: int = 20) -> DataFrame:
    return entity_counts(tagged, order).orderBy(F.desc("hits"), "first_pos", "entity").limit(limit)


def summary_row(tagged: DataFrame) -> DataFrame:
    return tagged.agg(
        F.count("*").alias("article_count"),
        F.countDistinct("source").alias("source_count"),
        F.count_if(F.size("matched_entities") > 0).alias("matched_count"),
    )


def entity_days(tagged: DataFrame, ts: str) -> DataFrame:
    """Articles per entity and day; names of one letter don't count."""
    rows = tagged.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day"), F.explode(F.map_keys("matched_entities")).alias("entity"))
    return rows.where(F.length("entity") >= 2).groupBy("entity", "day").agg(F.count("*").alias("n"))


def title_word_days(articles: DataFrame, ts: str) -> DataFrame:
    """What stands in for entities where nothing is tagged: the titles' words."""
    words = F.transform(F.split(F.trim("title"), r"\s+"), lambda w: F.btrim(w, F.lit(".,!?;:()[]\"'")))
    rows = articles.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day"), F.explode(words).alias("entity"))
    return rows.where((F.length("entity") >= 2) & ~F.lower("entity").isin(*ENTITY_STOPWORDS)).groupBy("entity", "day").agg(F.count("*").alias("n"))


def heatmap(days: DataFrame, last_day: Column, width: int = 14, top: int = 15) -> DataFrame:
    """Zero-filled matrix of the top entities (by all days) over the last days.

    The top and the calendar are small by definition; only they meet in a cross product.
    """
    ranked = days.groupBy("entity").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "entity").limit(top)
    calendar = ranked.select("entity", F.explode(F.sequence(F.date_sub(last_day, width - 1), last_day)).alias("day"))
    return calendar.join(days, ["entity", "day"], "left").select("entity", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entity_or_word_days(tagged: DataFrame, day: Column, order: str) -> DataFrame:
    """Per entity and day the number of articles, and the first place (order, pos); untagged articles count their titles' words.

    A word counts as often as it stands in the title.  Articles without a day, and names of
    one letter, don't count.
    """
    rows = tagged.select(day.alias("day"), F.col(order).alias("order"), "title", "matched_entities").where("day is not null")
    words = F.transform(F.split(F.trim("title"), r"\s+"), lambda w: F.btrim(w, F.lit(".,!?;:()[]\"'")))
    words = F.filter(words, lambda w: ~F.lower(w).isin(*ENTITY_STOPWORDS))
    names = F.when(F.size("matched_entities") > 0, F.map_keys("matched_entities")).otherwise(words)
    named = rows.select("day", "order", F.posexplode(names).alias("pos", "entity")).where(F.length("entity") >= 2)
    return named.groupBy("entity", "day").agg(F.count("*").alias("n"), F.min(F.struct("order", "pos")).alias("first"))


def entity_matrix(days: DataFrame, last_day: Column, width: int = 14, top: int = 15) -> DataFrame:
    """The chart of entities by day (position, entity, label, n): the top by all days, equal totals by first place.

    The last days are filled with zeros; where all of them are zero, there is no chart (no rows).
    """
    ranked = days.groupBy("entity").agg(F.sum("n").alias("total"), F.min("first").alias("first")).orderBy(F.desc("total"), "first").limit(top)
    # at most ``top`` rows come here
    placed = ranked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("total"), "first")))
    calendar = placed.select("position", "entity", F.explode(F.sequence(F.date_sub(last_day, width - 1), last_day)).alias("day"))
    cells = calendar.join(days.select("entity", "day", "n"), ["entity", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    # these windows hold at most top * width rows
    cells = cells.withColumn("most", F.max("n").over(Window.partitionBy(F.lit(1))))
    return cells.where("most > 0").select("position", "entity", F.date_format("day", "MM-dd").alias("label"), "n")
