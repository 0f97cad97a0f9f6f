"""URL verdicts: listed rules first, then templates of paths learned from the rules' own verdicts.

The paths of each host form a tree by segments. Digits and long hexadecimal strings are
generalised at once; a level with about as many branches as pages becomes a wildcard; and
branches whose share of blocked labels does not differ from that of their siblings together
are merged into one. Each resulting template is rejected when its share of blocked labels,
smoothed towards its host and the whole table, is high. Only DataFrame functions are used,
and after the first grouping they work on distinct shapes, not on pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomarket.llm.tables import written


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # with all its subdomains
    path: str  # what the path begins with

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# Levels of the tree; what lies deeper belongs to one wildcard.
DEPTH = 3
# A level is variable with so many branches and fewer than twice as many pages.
VARIABLE_BRANCHES = 8
# Deviations by which a branch must differ from its siblings to stay apart.
DEVIATIONS = 3.0
# Labels that the prior is worth, and the blocked share above which a template is rejected.
SMOOTHING, REJECTED = 4.0, 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: Sequence[Rule], of: str) -> Column:
    """The name or verdict of the longest rule that fits ``host`` and ``path``; null without one."""
    choices = [
        F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path),
               F.lit(getattr(r, of)))
        for r in sorted(rules, key=lambda r: -len(r.name))
    ]
    return F.coalesce(*choices, F.lit(None).cast("string"))


def shape(of: Column) -> Column:
    """A path with long hexadecimal segments and all digits generalised, without slashes at its end."""
    plain = F.regexp_replace(of, r"(?<=/)[0-9a-fA-F-]{16,}(?=/|$)", "{x}")
    return F.regexp_replace(F.regexp_replace(plain, "[0-9]+", "{n}"), "/+$", "")


def _sums(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in ("pages", "labelled", "blocked")]


def _generalised(shapes: DataFrame, level: int) -> DataFrame:
    """Replace segment ``level`` by a wildcard where it is variable or its branch like its siblings."""
    at = shapes.withColumn("parent", F.slice("tree", 1, level)).withColumn("branch", F.get("tree", F.lit(level)))
    branches = at.where("branch is not null").groupBy("host", "parent", "branch").agg(*_sums())
    parents = branches.groupBy("host", "parent").agg(
        F.count("*").alias("branches"), *_sums("all_"))
    rate = F.when(F.col("all_labelled") > 0, F.col("all_blocked") / F.col("all_labelled")).otherwise(0.0)
    expected = F.col("labelled") * rate
    spread = F.sqrt(F.col("labelled") * rate * (1 - rate))
    variable = (F.col("branches") >= VARIABLE_BRANCHES) & (F.col("all_pages") < 2 * F.col("branches"))
    similar = F.abs(F.col("blocked") - expected) <= DEVIATIONS * spread
    wild = branches.join(parents, ["host", "parent"]).where((F.col("branches") > 1) & (variable | similar)).select(
        "host", "parent", "branch", F.lit(True).alias("wild"))
    after = F.slice("tree", F.lit(level + 2), F.greatest(F.lit(0), F.size("tree") - (level + 1)))
    tree = F.when(F.col("wild"), F.concat("parent", F.array(F.lit("*")), after)).otherwise(F.col("tree"))
    return at.join(wild, ["host", "parent", "branch"], "left").withColumn("tree", tree).drop("parent", "branch", "wild")


def templates(pages: DataFrame) -> DataFrame:
    """The template of each shape, its smoothed blocked share and whether it is rejected.

    Wants ``host``, ``path`` and ``label`` (allow, block or null) of each page.
    """
    shapes = pages.groupBy("host", shape(F.col("path")).alias("shape")).agg(
        F.count("*").alias("pages"), F.count("label").alias("labelled"),
        F.count(F.when(F.col("label") == "block", 1)).alias("blocked"))
    segments = F.array_remove(F.split("shape", "/"), "")
    tree = F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit("**")))).otherwise(segments)
    shapes = written(shapes.withColumn("tree", tree), "shapes")
    for level in range(DEPTH):
        shapes = written(_generalised(shapes, level), f"tree-{level}")
    by_template = shapes.groupBy("host", "tree").agg(*_sums())
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    overall = by_host.agg(F.sum("host_labelled").alias("all_labelled"), F.sum("host_blocked").alias("all_blocked"))

    def smoothed(blocked: str, labelled: str, prior: Column) -> Column:
        return (F.col(blocked) + SMOOTHING * prior) / (F.col(labelled) + SMOOTHING)

    prior = F.coalesce(F.col("all_blocked") / F.when(F.col("all_labelled") > 0, F.col("all_labelled")), F.lit(0.0))
    judged = by_template.join(by_host, "host").join(F.broadcast(overall), F.lit(True)).select(
        "host", "tree", smoothed("blocked", "labelled", smoothed("host_blocked", "host_labelled", prior)).alias("purity"))
    return shapes.select("host", "shape", "tree").join(judged, ["host", "tree"]).select(
        "host", "shape", F.concat(F.lit("/"), F.array_join("tree", "/")).alias("template"), "purity",
        (F.col("purity") > REJECTED).alias("rejected"))


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the template it was judged by.

    A null URL or one without ``://`` has an empty host and path and fits no rule. Repeated
    rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = parsed.select("*", listed(rules, "name").alias("rule"), listed(rules, "verdict").alias("label"))
    judged = written(templates(ruled), "templates")
    found = ruled.withColumn("shape", shape(F.col("path"))).join(judged, ["host", "shape"], "left")
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template")
