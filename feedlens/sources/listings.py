"""Listing JSON and feed XML sources."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.decode import feed_datetime
from feedlens.sources.html import unescape

LISTING = (
    "kind string, data struct<children:array<struct<kind:string,data:struct<title:string,selftext:string,permalink:string,id:string,"
    "subreddit:string,url:string,author:string,score:bigint,num_comments:bigint,created_utc:string,removed_by_category:string,removed:boolean>>>>"
)
FEED = (
    "channel struct<item:array<struct<title:string,link:string,description:string,summary:string,encoded:string,pubDate:string,updated:string,date:string>>>, "
    "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,published:string,updated:string>>"
)


def _body(d: Column) -> Column:
    own = F.trim(F.coalesce(d["selftext"], F.lit("")))
    cut = F.when(F.length(own) > 2000, F.concat(F.substring(own, 1, 2000), F.lit("..."))).otherwise(own)
    usable = F.coalesce(d["selftext"], F.lit("")) != ""
    usable &= ~F.coalesce(d["selftext"], F.lit("")).isin("[removed]", "[deleted]")
    url = F.coalesce(d["url"], F.lit(""))
    linked = F.when((url != "") & ~url.startswith("https://www.reddit.com"), F.concat(F.lit("Link: "), url)).otherwise("")
    return F.when(usable, cut).otherwise(linked)


def parse_listings(raw: DataFrame, limit: int = 25) -> DataFrame:
    """Articles of listing JSON rows (source, category, body): the first ``limit`` children, filtered afterwards."""
    parsed = raw.withColumn("j", F.from_json("body", LISTING)).where("j.kind = 'Listing'")
    rows = parsed.select("source", "category", F.posexplode(F.slice("j.data.children", 1, limit)).alias("pos", "child"))
    d = F.col("child.data")
    link = F.when(F.coalesce(d["permalink"], F.lit("")) != "", F.concat(F.lit("https://www.reddit.com"), d["permalink"])).when(
        (F.coalesce(d["id"], F.lit("")) != "") & (F.coalesce(d["subreddit"], F.lit("")) != ""),
        F.concat(F.lit("https://www.reddit.com/r/"), d["subreddit"], F.lit("/comments/"), d["id"], F.lit("/")),
    )
    meta = F.format_string(
        "[r/%s] by u/%s | %s points | %s comments",
        F.coalesce(d["subreddit"], F.lit("")),
        F.coalesce(d["author"], F.lit("[deleted]")),
        F.coalesce(d["score"], F.lit(0)).cast("string"),
        F.coalesce(d["num_comments"], F.lit(0)).cast("string"),
    )
    body = _body(d)
    kept = (F.col("child.kind") == "t3") & (F.coalesce(d["removed_by_category"], F.lit("")) == "") & ~F.coalesce(d["removed"], F.lit(False))
    kept &= (F.coalesce(d["title"], F.lit("")) != "") & (F.coalesce(d["title"], F.lit("")) != "[deleted]")
    return (
        rows.where(kept)
        .select(
            "source",
            "category",
            "pos",
            unescape(F.trim(d["title"])).alias("title"),
            link.alias("link"),
            unescape(F.trim(F.when(body != "", F.concat(meta, F.lit("\n\n"), body)).otherwise(meta))).alias("summary"),
            F.timestamp_seconds(d["created_utc"].try_cast("double")).alias("published"),
        )
        .where("link is not null")
    )


def listing_url(url: Column, sort: str = "new", limit: int = 25, old: bool = False) -> Column:
    """JSON address of a subreddit's listing, at the site's main host or at its older one; the scheme stays."""
    # fixed values: the site's hosts
    plain = F.regexp_replace(F.regexp_replace(url, r"\.rss/?$", ""), r"://(old\.)?reddit\.com", "://www.reddit.com")
    plain = F.replace(plain, F.lit("://www.reddit.com"), F.lit("://old.reddit.com")) if old else plain
    folder = F.when(plain.endswith("/"), plain).otherwise(F.concat(plain, F.lit("/")))
    return F.concat(folder, F.lit(f"{sort}.json?limit={min(limit, 100)}&raw_json=1"))


def parse_feeds(raw: DataFrame, limit: int = 50) -> DataFrame:
    """Articles of RSS or Atom rows (source, category, body); entries without a link drop after the limit.

    The summary is the entry's own, its description or its content; the time is the first
    of its dates that can be read.
    """
    rows = raw.withColumn("x", F.from_xml("body", F.lit(FEED), {"ignoreNamespace": "true"}))
    own = lambda i, *names: F.coalesce(*[F.nullif(F.trim(i[n]), F.lit("")) for n in names])
    rss = F.transform(
        "x.channel.item",
        lambda i: F.struct(i["title"].alias("title"), F.trim(i["link"]).alias("link"), own(i, "summary", "description", "encoded").alias("summary"), i["pubDate"].alias("a"), i["updated"].alias("b"), i["date"].alias("c")),
    )
    href = lambda e: F.get(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    atom = F.transform(
        "x.entry",
        lambda e: F.struct(e["title"].alias("title"), F.trim(href(e)).alias("link"), own(e, "summary", "content").alias("summary"), e["published"].alias("a"), e["updated"].alias("b"), F.lit(None).cast("string").alias("c")),
    )
    items = rows.select("source", "category", F.posexplode(F.slice(F.coalesce(rss, atom), 1, limit)).alias("pos", "item"))
    title = F.nullif(F.trim(unescape(F.coalesce("item.title", F.lit("")))), F.lit(""))
    return items.where(F.coalesce("item.link", F.lit("")) != "").select(
        "source",
        "category",
        "pos",
        F.coalesce(title, F.lit("(no title)")).alias("title"),
        F.col("item.link").alias("link"),
        unescape(F.trim(F.coalesce("item.summary", F.lit("")))).alias("summary"),
        feed_datetime(F.col("item.a"), F.col("item.b"), F.col("item.c")).alias("published"),
    )


def collected(parts: list[DataFrame]) -> DataFrame:
    """Articles of all collectors; columns that one of them doesn't have are null in its rows."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unsupported_errors(routed: DataFrame) -> DataFrame:
    """(source, error) of the routed sources that no collector takes."""
    # fixed value: the wording of the message
    error = F.format_string("%s: Source type '%s' is cataloged but not collected by the standard pipeline", F.col("name"), F.col("type"))
    return routed.where("collector = 'unsupported'").select(F.col("name").alias("source"), error.alias("error"))


def route(sources: DataFrame) -> DataFrame:
    """Enabled sources with the collector that their type asks for."""
    kind = F.lower(F.trim("type"))
    collector = F.when(kind == "rss", "feed").when(kind.isin("browser", "html", "javascript", "js", "web"), "page").when(kind == "reddit", "listing").otherwise("unsupported")
    return sources.where(F.coalesce("enabled", F.lit(True))).withColumn("collector", collector)
