"""URL filters by a path-template tree, in DataFrame operations only.

Per host, paths are laid out as a tree of segments. Segments that are numbers, hashes or
dates by their shape, or that each hold little of their parent's pages, become wildcards;
sibling branches whose labelled shares do not differ by a chi-square bound are merged into
one. A template's labelled purity is smoothed with the prior, in which its unlabelled pages
take part with half a page each, so that a few labels do not condemn a large branch.
Labels are the verdicts of the given rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table, written

# The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH = 8  # segments told apart; what lies deeper is one tail
LITERAL_SHARE, LITERAL_PAGES = 0.05, 3  # a segment stays literal from these on
PSEUDO = 5.0  # pages' worth of prior
REJECT = 0.8  # smoothed blocked share that rejects a template


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), the longest that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """The segment, or a wildcard where its shape says that it varies."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{16,}$"), "{hash}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([A-Za-z0-9]{1,5})$", 1)))
        .when(F.length(segment) > 40, "{long}")
        .otherwise(segment))


def _templates(paths: DataFrame) -> DataFrame:
    """(host, path, tree: an array of segments) from distinct (host, path, n)."""
    segments = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    # Part of the shape: whether the path ends in a slash.
    rows = paths.select("host", "path", "n", F.transform(F.slice(segments, 1, DEPTH), _shape).alias("segments"), (F.size(segments) > DEPTH).alias("deep"))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    rows = written(rows.withColumn("tree", F.array().cast("array<string>")), "url-tree")
    for level in range(deepest):
        here = F.try_element_at("segments", F.lit(level + 1))
        live = rows.withColumn("here", F.coalesce(here, F.lit("")))
        children = live.groupBy("host", "tree", "here").agg(F.sum("n").alias("pages"))
        parents = children.groupBy("host", "tree").agg(F.sum("pages").alias("all"), F.count(F.lit(1)).alias("fan"))
        stays = (F.col("pages") >= LITERAL_PAGES) & (F.col("pages") >= LITERAL_SHARE * F.col("all")) | F.startswith("here", F.lit("{")) | (F.col("here") == "") | (F.col("fan") == 1)
        named = children.join(parents, ["host", "tree"]).select("host", "tree", "here", F.when(stays, F.col("here")).otherwise("*").alias("segment"))
        named = written(named, "url-segments")
        longer = F.when(F.col("segment") == "", F.col("tree")).otherwise(F.concat("tree", F.array("segment")))
        rows = written(live.join(named, ["host", "tree", "here"]).select("host", "path", "n", "segments", "deep", longer.alias("tree")), "url-tree")
    return rows.select("host", "path", F.when(F.col("deep"), F.concat("tree", F.array(F.lit("**")))).otherwise(F.col("tree")).alias("tree"))


def _merged(templates: DataFrame) -> DataFrame:
    """(host, tree, merged) from (host, tree, n, labelled, blocked), deepest segment first."""
    deepest = templates.agg(F.max(F.size("tree"))).first()[0] or 0
    now = written(templates.withColumn("merged", F.col("tree")), "url-merged")
    for level in range(deepest, 0, -1):
        wild = F.when(F.size("merged") >= level, F.concat(F.slice("merged", 1, level - 1), F.array(F.lit("*")), F.slice("merged", level + 1, DEPTH + 1))).otherwise(F.col("merged"))
        branches = now.groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).withColumn("wild", wild)
        square = F.when(F.col("l") > 0, F.col("b") * F.col("b") / F.col("l"))
        groups = branches.groupBy("host", "wild").agg(
            F.count(F.lit(1)).alias("branches"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.coalesce(F.sum(square), F.lit(0.0)).alias("squares"), F.count(square).alias("told"))
        share = F.try_divide("b", "l")
        spread = F.coalesce(F.try_divide(F.col("squares") - F.col("b") * share, share * (1 - share)), F.lit(0.0))
        freedom = F.greatest(F.col("told") - 1, F.lit(0))
        alike = (F.col("branches") > 1) & (spread <= freedom + 2 * F.sqrt(2 * freedom))
        groups = groups.where(alike).select("host", "wild", F.lit(True).alias("alike"))
        to = branches.select("host", "merged", "wild").join(groups, ["host", "wild"], "left").select("host", "merged", F.when(F.col("alike"), F.col("wild")).otherwise(F.col("merged")).alias("to"))
        now = written(now.join(to, ["host", "merged"]).select("host", "tree", "n", "labelled", "blocked", F.col("to").alias("merged")), "url-merged")
    return now


def template_verdicts(pages: DataFrame) -> DataFrame:
    """(host, path, template, purity, rejected) of each distinct host and path of
    ``pages`` (host, path, said: block, allow or null)."""
    paths = written(pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked")), "url-paths")
    trees = written(_templates(paths), "url-trees")
    sums = paths.join(trees, ["host", "path"]).groupBy("host", "tree").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    merged = _merged(sums)
    labelled, blocked = paths.agg(F.sum("labelled"), F.sum("blocked")).first()
    # At most a half, so that a template without labels is never rejected.
    prior = min(0.5, ((blocked or 0) + 1) / ((labelled or 0) + 2))
    whole = merged.groupBy("host", "merged").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    weight = F.lit(PSEUDO) + (F.col("n") - F.col("labelled")) / 2
    whole = whole.withColumn("purity", (F.col("blocked") + F.lit(prior) * weight) / (F.col("labelled") + weight))
    judged = merged.select("host", "tree", "merged").join(whole.select("host", "merged", "purity"), ["host", "merged"])
    return trees.join(judged, ["host", "tree"]).select("host", "path", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity", (F.col("purity") >= REJECT).alias("rejected"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    A null url, or one without ``://``, has an empty host and path; such pages share the
    template of the empty host. Null ids and repeated rows are judged each; an empty table
    gives no row; further columns are ignored. Where no page is labelled nothing is rejected.
    """
    ready(pages.sparkSession)
    host, path = host_and_path(pages[url_col])
    parsed = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parsed = written(parsed.select("page_id", "host", "path", rule.alias("rule"), said.alias("said")), "url-pages")
    judged = written(template_verdicts(parsed), "url-verdicts")
    verdict = F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow"))
    return parsed.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op8_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))
