"""URL filtering by rules and by a tree of path templates.

Every host has a tree of path templates.  A segment's digits and long hexadecimal strings become wildcards at once; a
segment below which too many different values occur is variable and becomes a wildcard as a whole.  Branches of the same parent
whose labelled shares do not differ significantly are merged.  A template is rejected when its share of bad urls,
smoothed towards a prior, is above a limit: a template without labels is kept.

The tree is walked level by level, to whatever depth.  Only paths below a prefix with more than ``VALUES`` distinct ones go on to
the next level: with fewer no segment further down can be variable, so that a few deep paths add no rounds.

All of it is counting: distinct paths with their counts are combined before each shuffle, so that a host with very
many urls is no more than its distinct paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import stored

#: A segment is variable when more values than this occur at its place and a value has fewer urls than ``PER_VALUE`` on average.
VALUES = 32
PER_VALUE = 20
#: Levels after which the finished paths are written as one table.
FOLD = 8
#: Branches are merged when each has ``LEAST_LABELS`` and their shares are closer than this many standard errors.
LEAST_LABELS = 5
SAME = 1.96
#: Smoothing: so many urls of the prior share are added; templates above the limit are rejected.
PRIOR_WEIGHT = 10.0
PRIOR = 0.1
LIMIT = 0.5

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host() -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path() -> Column:
    return F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = (F.col("host") == name) | F.col("host").endswith("." + name)
        if slash:
            fits &= F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _segments() -> Column:
    """The path's segments with digits and hexadecimal strings as wildcards."""
    plain = F.regexp_replace("path", r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{h}")
    return F.split(F.regexp_replace(F.regexp_replace(plain, r"[0-9]+", "{n}"), r"^/", ""), "/")


def templates(shapes: DataFrame) -> DataFrame:
    """``host, segments, template, labelled, bad`` for each distinct ``host, segments`` with its ``n, labelled, bad``.

    ``template`` is the path with variable segments as ``*``; ``labelled`` and ``bad`` are those of the template, or
    of all branches merged with it.
    """
    open_, done, level, left = shapes.withColumn("general", F.col("segments")), [], 0, 1
    while left:
        level += 1
        above = F.slice("general", 1, level - 1) if level > 1 else F.array().cast("array<string>")
        here = open_.withColumn("_above", above).withColumn("_here", F.get("general", F.lit(level - 1)))
        values = here.where("_here IS NOT NULL").groupBy("host", "_above", "_here").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"))
        many = values.groupBy("host", "_above").agg(
            F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.sum("paths").alias("paths")).where(F.col("paths") > VALUES).select(
            "host", "_above", ((F.col("v") > VALUES) & (F.col("n") < PER_VALUE * F.col("v"))).alias("_wide"))
        made = here.join(many, ["host", "_above"], "left").withColumn(
            "general", F.when(
                F.col("_wide") & F.col("_here").isNotNull(),
                F.concat("_above", F.array(F.lit("*")), F.slice("general", level + 1, F.size("general")))).otherwise(F.col("general")))
        further = F.col("_wide").isNotNull() & (F.size("general") > level)
        made, (left,) = stored(made.withColumn("_further", further).drop("_above", "_here", "_wide"), "templates", F.count_if("_further"))
        open_ = made.where("_further").drop("_further")
        done.append(made.where("NOT _further").drop("_further"))
        if len(done) > FOLD:
            done = [stored(reduce(DataFrame.unionByName, done), "templates")[0]]
    tree = reduce(DataFrame.unionByName, done)
    leaf = tree.groupBy("host", "general").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # the first segment tells branches of a host apart; below it the rest of the template is one shape
    leaf = leaf.withColumn("_shape", F.concat(F.lit("/"), F.array_join(F.slice("general", 2, F.size("general")), "/")))
    pooled = leaf.where(F.col("labelled") >= LEAST_LABELS).groupBy("host", "_shape").agg(
        F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"))
    both = leaf.join(pooled, ["host", "_shape"], "left")
    share, whole = F.col("bad") / F.col("labelled"), F.col("_bad") / F.col("_labelled")
    error = F.sqrt(whole * (1 - whole) / F.col("labelled"))
    same = F.coalesce((F.col("labelled") >= LEAST_LABELS) & (F.abs(share - whole) <= SAME * error), F.lit(False))
    merged = both.select(
        "host", "general",
        F.when(same, F.col("_labelled")).otherwise(F.col("labelled")).alias("labelled"),
        F.when(same, F.col("_bad")).otherwise(F.col("bad")).alias("bad"))
    return tree.select("host", "segments", "general").join(merged, ["host", "general"]).select(
        "host", "segments", F.concat(F.lit("/"), F.array_join("general", "/")).alias("template"), "labelled", "bad")


def classify(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, bad: Column | None = None) -> DataFrame:
    """One row for each page: ``page_id, host, path, rule, verdict, template, purity``.

    ``bad`` is the label of a url (true, false, or null for unknown), from any columns of ``pages``; without it, urls that a
    rule judges are the labelled ones.  A url that is null or has no ``://`` has empty host and path and
    the template of that host.  The longest rule wins over the template.  Repeated rows are judged alike, extra columns are
    ignored, an empty table gives no rows.
    """
    rule, verdict = judged(rules)
    seen = pages.withColumns({"host": host(), "path": path()}).withColumns({"rule": rule, "_ruled": verdict})
    label = F.col("_ruled") == "block" if bad is None else bad
    cut = seen.select("page_id", "host", "path", "rule", "_ruled", _segments().alias("segments"), label.alias("_label"))
    shapes, _ = stored(
        cut.groupBy("host", "segments").agg(
            F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"), F.count_if("_label").alias("bad")), "shapes")
    found, _ = stored(templates(shapes), "templates")
    purity = (F.col("bad") + PRIOR * PRIOR_WEIGHT) / (F.col("labelled") + PRIOR_WEIGHT)
    return cut.join(found, ["host", "segments"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("_ruled", F.when(purity > LIMIT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", purity.alias("purity"))
