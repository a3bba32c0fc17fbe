"""URL filters by path templates.

Every host has a tree of path segments. Segments are first written as shapes (runs of digits as ``#``, long hexadecimal
words as ``@``), which a map over the rows does; then, level by level from the top, the children of a node that are many
and each rare become one wildcard ``*``, and children whose labelled shares of bad pages do not differ
statistically are merged into it as well. Every path so has one template of its host. A template is rejected if the smoothed
share of good pages among its labelled ones is too low; the prior is its host's share, itself smoothed by the share of all.

All counting is grouped by shapes, not by pages: a hot host is summed before it moves, and what a level gathers are
distinct nodes. Explicit rules (host, path prefix) come before the templates; the longest one wins.

Defined cases: a url that is null or has no ``://`` has empty host and path; it is judged by its (empty) template like any
other; segments beyond ``DEPTH`` are taken as one; labels that repeat count as often as they occur, and pages without
labels only shape the tree; with no label at all nothing is rejected; repeated rows are judged each for itself; an empty
table gives an empty result; extra columns are kept, but for old ones of the added names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import BROADCAST_ROWS, saved

DEPTH = 8
# a node's children become one wildcard where there are more than so many and the largest has less than this share
FANOUT, RARE = 20, 0.2
# labelled pages that a host's, and a template's, prior is worth
HOST_PRIOR, TEMPLATE_PRIOR = 20.0, 10.0
# children are alike if their bad shares lie within so many standard errors of their parent's
ALIKE = 2.0
PURITY = 0.5
# words of eight and more hexadecimal digits, with a digit and a letter among them
_HEX = r"(?<![^/._~-])(?=[0-9a-fA-F-]*[0-9])(?=[0-9a-fA-F-]*[a-fA-F])[0-9a-fA-F-]{8,}(?![^/._~-])"
ADDED = ("host", "path", "rule", "template", "purity", "verdict")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null without one.

    A rule fits its host and all subdomains, if the path starts with its own.
    """
    rule = verdict = None
    for decision, domain, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = domain + prefix
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def shapes(path: Column, depth: int = DEPTH) -> Column:
    """Segments of the path as shapes; those beyond ``depth`` are one."""
    shape = F.regexp_replace(F.regexp_replace(path, _HEX, "@"), r"[0-9]+", "#")
    parts = F.split(F.regexp_replace(shape, "^/", ""), "/")
    tail = F.array_join(F.slice(parts, F.lit(depth), F.greatest(F.size(parts) - depth + 1, F.lit(0))), "/")
    folded = F.concat(F.slice(parts, F.lit(1), F.lit(depth - 1)), F.array(tail))
    return F.when(F.size(parts) > depth, folded).otherwise(parts)


def templates(shaped: DataFrame) -> DataFrame:
    """(host, shape, template) of the distinct (host, shape, n, labelled, bad): ``shape`` is an array of segments.

    One pass per level. What is generalised above decides which nodes are siblings below.
    """
    deepest = shaped.agg(F.max(F.size("shape"))).first()[0] or 0
    rows = shaped.withColumn("template", F.array().cast("array<string>"))
    for level in range(deepest):
        here = F.get("shape", F.lit(level))
        node = ["host", "template"]
        inner = rows.filter(F.size("shape") > level).withColumn("segment", here)
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        children = inner.groupBy(*node, "segment").agg(*sums)
        parents = children.groupBy(*[F.col(c).alias(f"_{c}") for c in node]).agg(
            F.count(F.lit(1)).alias("fanout"),
            F.sum("n").alias("all"),
            F.max("n").alias("largest"),
            F.try_divide(F.sum("bad"), F.sum("labelled")).alias("share"),
        )
        same = (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template"))
        both = children.join(parents, same)
        many = (F.col("fanout") > FANOUT) & (F.col("largest") < RARE * F.col("all"))
        variance = F.greatest(F.col("share") * (1 - F.col("share")), F.lit(0.01))
        error = F.sqrt(F.try_divide(variance, F.col("labelled")))
        far = F.abs(F.try_divide(F.col("bad"), F.col("labelled")) - F.col("share")) > ALIKE * error
        # a child whose labels differ stays; one that is merely rare does not
        differs = F.coalesce(far, F.lit(False))
        alike = (F.col("fanout") > 1) & (F.col("labelled") > 0)
        merged = F.when((many | alike) & ~differs, F.lit("*"))
        named = both.select("_host", "_template", F.col("segment").alias("_segment"), merged.alias("wild"))
        named = saved(named.filter("wild IS NOT NULL"), f"level{level}")
        same = same & (here == F.col("_segment"))
        rows = rows.join(named, same, "left")
        following = F.concat("template", F.array(F.coalesce("wild", here)))
        rows = rows.withColumn("template", F.when(F.size("shape") > level, following).otherwise(F.col("template")))
        rows = saved(rows.drop("_host", "_template", "_segment", "wild"), f"rows{level}")
    return rows


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    purity: float = PURITY,
    url: str = "url",
    key: str = "_label_key",
) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict (allow or block).

    ``labels`` are (key, bad 0/1) rows; ``key`` names the column of ``pages`` that they are joined on.
    """
    names = [c for c in pages.columns if c.lower() not in ADDED]
    inner = [f"_page{i}" for i in range(len(names))]
    rows = pages.select(*names).toDF(*inner)
    link, own = F.col(inner[names.index(url)]), F.col(inner[names.index(key)])
    rows = rows.withColumns({"host": host_of(link), "path": path_of(link)})
    rows = rows.withColumn("shape", shapes(F.col("path")))
    known = labels.groupBy(F.col("key").alias("_key")).agg(
        F.count(F.lit(1)).alias("_labelled"), F.sum(F.col("bad").cast("bigint")).alias("_bad")
    )
    light = rows.select("host", "shape", own.alias("_own")).join(known, F.col("_own") == F.col("_key"), "left")
    shaped = light.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("_labelled"), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"),
    )
    tree = templates(saved(shaped, "shapes"))
    rated = saved(_rated(tree), "templates")
    small = rated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    template = F.concat(F.lit("/"), F.array_join("template", "/")).alias("template")
    rated = rated.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), template, "purity")
    same = (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape"))
    rows = rows.join(F.broadcast(rated) if small else rated, same, "left")
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    own_verdict = F.when(F.col("purity") < purity, "block").otherwise("allow")
    rows = rows.withColumns({"rule": rule, "verdict": F.coalesce(decision, own_verdict)})
    return rows.select(*inner, *ADDED).toDF(*names, *ADDED)


def _rated(tree: DataFrame) -> DataFrame:
    """``purity``: the share of good pages among a template's labelled ones, shrunk to its host's and that to all."""
    total = tree.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad")).first()
    whole = 1 - (total["bad"] / total["n"] if total["n"] else 0.0)
    good = F.sum("labelled") - F.sum("bad")
    by_template = tree.groupBy("host", "template").agg(good.alias("good"), F.sum("labelled").alias("labelled"))
    by_host = by_template.groupBy(F.col("host").alias("_host")).agg(
        ((F.sum("good") + HOST_PRIOR * whole) / (F.sum("labelled") + HOST_PRIOR)).alias("prior")
    )
    purity = (F.col("good") + TEMPLATE_PRIOR * F.col("prior")) / (F.col("labelled") + TEMPLATE_PRIOR)
    rated = by_template.join(by_host, F.col("host") == F.col("_host"))
    rated = rated.select(F.col("host").alias("_host"), F.col("template").alias("_template"), purity.alias("purity"))
    same = (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template"))
    return tree.join(rated, same).select("host", "shape", "template", "purity")
