"""URL filtering with a tree of path templates.

Per host, paths form a tree of segments, which is walked from node to node: what all paths
of a node have in common is one step, and then each child either keeps its own segment or
becomes part of the node's wildcard.  It does so if it is one of very many rare children,
or if it is statistically like its siblings: in its labelled share of blocked pages, and in
how its paths go on.  A template's purity is its labelled share of blocked pages, smoothed
towards that of the node above, from the host down.  Labels come from host
and path rules; what they say of a host's labelled branches so reaches the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.shared import written

#: Fixed values: (verdict, host and path prefix).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: A node with more children has variable segments: those of a share below RARE become wildcards.
BRANCHES = 20
RARE = 0.05
#: Chi-square of one degree of freedom at 5 %.
SIGNIFICANT = 3.841
#: Pages of its parent's purity that a template is taken to have beside its known ones; above the hosts stands the PRIOR.
SMOOTHING = 4.0
PRIOR = 0.25
REJECT = 0.5


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host, path) as a struct (rule, verdict), else null."""
    out = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def shape_of(path: Column) -> Column:
    """The path's segments, without empty ones; numbers and long hex ids in them are wildcards."""
    plain = F.regexp_replace(path, "[0-9a-f]{16,}", "*")
    plain = F.regexp_replace(plain, "[0-9]+", "*")
    return F.filter(F.split(plain, "/", -1), lambda s: s != "")


_SUMS = ("n", "known", "blocked", "ending", "varying")


def _sums(rows: DataFrame, *keys: str, names=_SUMS, prefix: str = "") -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(prefix + c) for c in names])


def _unlike(hits: str, size: str) -> Column:
    """Whether a child's share of hits differs significantly from its siblings'; shares of nothing don't."""
    others, rest = F.col(f"all_{size}") - F.col(size), F.col(f"all_{hits}") - F.col(hits)
    share = F.col(f"all_{hits}") / F.col(f"all_{size}")
    gap = F.col(hits) / F.col(size) - rest / others
    spread = share * (1 - share) * (1 / F.col(size) + 1 / others)
    return F.when((F.col(size) > 0) & (others > 0), gap * gap > SIGNIFICANT * spread).otherwise(False)


def _merged() -> Column:
    """Whether a child becomes part of the wildcard: one of many rare ones, or like its siblings."""
    varies = (F.col("kids") > BRANCHES) & (F.col("n") < RARE * F.col("all_n"))
    alike = ~(_unlike("blocked", "known") | _unlike("ending", "n") | _unlike("varying", "n"))
    return varies | ((F.col("kids") > 1) & alike)


def _purity(blocked: Column, known: Column, above: Column) -> Column:
    return F.round((blocked + SMOOTHING * above) / (known + SMOOTHING), 9)


def templates(shapes: DataFrame) -> DataFrame:
    """Rows (host, shape, template, purity) from (host, shape, n, known, blocked), a branching at a time.

    Each step reads the one before it several times, so each is written as a table: the
    plan stays one step deep, and a lost executor costs one step.  A path has as many
    steps as branchings, however many segments it has.
    """
    hosts = _sums(shapes, "host", names=("known", "blocked")).select("host", _purity(F.col("blocked"), F.col("known"), F.lit(PRIOR)).alias("purity"))
    own = shapes.join(hosts, "host").withColumns({"rest": F.col("shape"), "template": F.lit("")})
    own = written(own, "shapes")
    while not own.where(F.size("rest") > 0).isEmpty():
        ends = own.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        differ = F.array_position(F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        common = ends.select("host", "template", F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int").alias("shared"))
        at = own.join(common, ["host", "template"]).withColumns(
            {
                "jump": F.transform(F.slice("rest", F.lit(1), F.col("shared")), lambda x: F.concat(F.lit("/"), x)),
                # a path that ends at the node has the empty segment there
                "seg": F.coalesce(F.get("rest", F.col("shared")), F.lit("")),
                "rest": F.slice("rest", F.col("shared") + 2, F.size("rest")),
            }
        )
        after = F.get("rest", F.lit(0))
        told = at.withColumns({"ending": F.when(after.isNull(), F.col("n")).otherwise(0), "varying": F.when(after.contains("*"), F.col("n")).otherwise(0)})
        kids = _sums(told, "host", "template", "purity", "seg")
        live = kids.where("seg <> ''")
        nodes = _sums(live, "host", "template", prefix="all_").join(live.groupBy("host", "template").agg(F.count("*").alias("kids")), ["host", "template"])
        named = kids.join(nodes, ["host", "template"], "left").withColumn("as_seg", F.when((F.col("seg") != "") & _merged(), "*").otherwise(F.col("seg")))
        pure = _sums(named, "host", "template", "as_seg", names=("known", "blocked")).toDF("host", "template", "as_seg", "of_known", "of_blocked")
        turned = named.join(pure, ["host", "template", "as_seg"])
        # where no path goes on there is nothing to tell apart
        smoothed = F.when(F.col("kids").isNull(), F.col("purity")).otherwise(_purity(F.col("of_blocked"), F.col("of_known"), F.col("purity")))
        step = F.when(F.col("as_seg") == "", "").otherwise(F.concat(F.lit("/"), "as_seg"))
        turned = turned.select("host", "template", "seg", step.alias("step"), smoothed.alias("purity"))
        own = at.drop("purity").join(turned, ["host", "template", "seg"]).select(
            "host", "shape", "n", "known", "blocked", "purity", "rest", F.concat("template", F.array_join("jump", ""), "step").alias("template")
        )
        own = written(own, "templates")
    return own.select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdicts on pages (page_id, url): host, path, rule, verdict and the url's template.

    A rule's verdict stands; pages without one get their template's: block if its smoothed
    purity is at least REJECT.  A null url, or one without ``://``, has an empty host and
    path.  Of equally long rules none can fit the same url but the same rule.  Repeated
    rows count each; an empty table gives no rows; long urls are read whole.  Extra
    columns are ignored.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = named.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    known = F.when(F.col("found").isNotNull(), 1).otherwise(0)
    blocked = F.when(F.col("found.verdict") == "block", 1).otherwise(0)
    shapes = ruled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(known).alias("known"), F.sum(blocked).alias("blocked"))
    learnt = templates(shapes).withColumn("learnt", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return ruled.join(learnt, ["host", "shape"], "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "learnt").alias("verdict"), "template"
    )
