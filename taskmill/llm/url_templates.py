"""URL filters: fixed rules first, then a tree of path templates per host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import free_names
from taskmill.scale import lookup, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (action, host and path prefix) as the contract of the query gives them (fixed values).
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
# Segments below this depth are one tail segment of the template.
DEPTH = 8
# A place in the tree with so many different segments, each seen fewer times than SELDOM on average, varies.
MIN_CHILDREN, SELDOM = 8, 4
# A branch stays apart from its siblings if its share of bad pages lies so many deviations off theirs.
DEVIATIONS = 3.0
# Weight of the share one level up, and the smoothed share of bad pages from which a template is rejected.
PRIOR, REJECT = 4.0, 0.8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a url without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path starts the url's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    parts = F.array_remove(F.split(path, "/"), "")
    tail = F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts) - DEPTH + 1, F.lit(0))), "/")
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(
        F.concat(F.slice(parts, 1, DEPTH - 1), F.array(tail))
    )


def _share(bad: Column, good: Column, above: Column) -> Column:
    return (bad + PRIOR * above) / (bad + good + PRIOR)


def templates(shapes: DataFrame) -> DataFrame:
    """Add ``template`` to shapes (host, segments, n, bad, good), one level of the tree after the other.

    At each place a segment becomes ``*`` if the place has many children that are each seen seldom, or
    if it has labelled pages and these are not significantly worse or better than those of the place as a
    whole: all such branches are one from there on. A branch without a label is not alike for that. Every
    branch is compared with its parent, never with all others. A segment that is ``*`` itself is ``\\*``.
    """
    depth = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    tree = shapes.withColumn("template", F.lit(""))
    for level in range(depth):
        here = tree.withColumn("__seg", F.get("segments", F.lit(level)))
        children = here.where("__seg is not null").groupBy("host", "template", "__seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "bad", "good")]
        )
        labelled = F.col("bad") + F.col("good")
        share = (F.col("__bad") + 1.0) / (F.col("__bad") + F.col("__good") + 2.0)
        off = F.col("bad") - labelled * share
        varies = (F.col("__k") >= MIN_CHILDREN) & (F.col("__n") < SELDOM * F.col("__k"))
        alike = (labelled > 0) & (off * off <= DEVIATIONS * DEVIATIONS * labelled * share * (1.0 - share))
        literal = F.when(F.col("__seg") == "*", F.lit("\\*")).otherwise(F.col("__seg"))
        children = stage(children, "children")
        places = stage(children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("__k"), *[F.sum(c).alias(f"__{c}") for c in ("n", "bad", "good")],
        ), "places")
        chosen = lookup(children, places, ["host", "template"], "inner").select(
            "host", "template", "__seg",
            F.when(varies | ((F.col("__k") > 1) & alike), F.lit("*")).otherwise(literal).alias("__to"),
        )
        tree = stage(
            lookup(here, stage(chosen, "chosen"), ["host", "template", "__seg"]).withColumn(
                "template",
                F.when(F.col("__seg").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.lit("/"), "__to")
                ),
            ).drop("__seg", "__to"),
            "templates",
        )
    return tree


def judged_templates(tree: DataFrame) -> DataFrame:
    """Per host and template the share of bad among its labelled pages, smoothed by host and by everything."""
    counts = [F.sum(c).alias(c) for c in ("bad", "good")]
    total = tree.agg(*counts).first()
    overall = ((total["bad"] or 0) + 1.0) / ((total["bad"] or 0) + (total["good"] or 0) + 2.0)
    hosts = tree.groupBy("host").agg(*counts).select(
        "host", _share(F.col("bad"), F.col("good"), F.lit(overall)).alias("__host_share")
    )
    each = tree.groupBy("host", "template").agg(*counts)
    return each.join(hosts, "host").select(
        "host", "template", _share(F.col("bad"), F.col("good"), F.col("__host_share")).alias("bad_share")
    )


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    bad: Column | None = None,
) -> DataFrame:
    """Add ``host, path, rule, template, bad_share, verdict`` to every page.

    A page with a rule gets its verdict. All others are judged by the template of their path: it is
    blocked from a smoothed share of bad labelled pages of ``REJECT`` on. Labels come from ``bad`` (a
    boolean column, null where unknown) or else from the rules' own verdicts. Null urls and urls without
    ``://`` have an empty host and path and are a template of their own. Of a path with more than ``DEPTH``
    segments those from there on are one segment of the template; host and path are given whole, however
    long. A share of exactly ``REJECT`` blocks; of rules of one length that fit, blocking wins. Repeated
    rows are judged each for itself; an empty table gives an empty result; old columns of the new names
    are replaced.
    """
    new = ("host", "path", "rule", "template", "bad_share", "verdict")
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    host, path, rule, segments, marked = free_names(pages, "host", "path", "rule", "segments", "bad")
    parsed = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    parsed = parsed.withColumn(rule, matched_rule(F.col(host), F.col(path), rules))
    label = bad if bad is not None else F.col(f"{rule}.verdict") == "block"
    parsed = parsed.withColumns({segments: _segments(F.col(path)), marked: label})
    shapes = stage(
        parsed.groupBy(F.col(host).alias("host"), F.col(segments).alias("segments")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(marked)).alias("bad"), F.count_if(~F.col(marked)).alias("good"),
        ),
        "shapes",
    )
    tree = templates(shapes)
    # A template of a large host has many paths, so the shares are looked up instead of shuffled to them.
    found = lookup(
        tree.select("host", "segments", "template"), stage(judged_templates(tree), "shares"), ["host", "template"]
    )
    judged_template, judged_share = free_names(parsed, "template", "share")
    found = stage(found.select("host", "segments", "template", "bad_share"), "judged").toDF(
        host, segments, judged_template, judged_share
    )
    verdict = F.when(F.col(judged_share) >= REJECT, "block").otherwise("allow")
    return lookup(parsed.select(*columns, host, path, rule, segments), found, [host, segments]).select(
        *columns, F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{rule}.rule").alias("rule"),
        F.col(judged_template).alias("template"), F.col(judged_share).alias("bad_share"),
        F.coalesce(F.col(f"{rule}.verdict"), verdict).alias("verdict"),
    )
