"""URL filters: explicit rules first, then a path-template tree per host.

Every path is a list of segments under its host. Pages of one host and path are counted as one shape. Level by level, from the host
down, the children of a node are counted. They become one wildcard branch if they are variable (many, most of them with few
pages); children whose labelled shares do not differ from what all the labelled children of their node have merge too. A node with
under SPLIT pages, or with a single shape, is not split further: the rest of its paths is a wildcard, or stays as it is if all are
equal. So the tree is as deep as the pages support. What is left is a set of templates for each host. A template is rejected if its
smoothed labelled share of good pages is under a limit. Pages are aggregated to shapes once and meet the templates of their shapes
once; all else is work on shapes. Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import meet, stage_table

#: rule -> verdict. A rule is a host and a path; it fits the host and its subdomains where the path begins like the rule's.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ANY = "*"
REST = "**"
SPLIT = 16  # pages that a node needs to be split
RARE = 0.5  # a node whose children number more than this share of its pages has rare children
MANY = 16  # ... if it has so many at least
COMMON = 0.05  # share of such a node's pages that makes a child a branch of its own
ALIKE = 1.96  # standard errors within which a child's labelled share is its node's
PRIOR = 8.0  # labelled pages that the host's own, or all hosts', share counts for
PURITY = 0.5
BROADCAST_SHAPES = 100_000  # shapes of about 200 bytes; beyond, a shuffled join
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), F.lit(rule)).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _shapes(pages: DataFrame) -> DataFrame:
    """Distinct hosts and paths of ``pages(host, path, good)``: pages, labelled and good ones. Pages of one shape travel together."""
    return pages.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes(host, path, n, labelled, good)`` with the column ``template``."""
    first = {"left": _segments(F.col("path")), "node": F.array().cast("array<string>"), "template": F.lit(None).cast("string")}
    now, done, level = stage_table(shapes.withColumns(first), "shapes"), [], 0
    while True:
        # nodes that are not split: their shapes are finished
        node = now.groupBy("host", "node").agg(F.sum("n").alias("all_n"), F.count_distinct("left").alias("kinds"), F.count("*").alias("rows"))
        ends = (F.col("kinds") == 1) | (F.col("all_n") < SPLIT)
        rest = F.slice(F.col("left"), level + 1, F.greatest(F.size("left") - level, F.lit(0)))
        tail = F.when(F.col("kinds") == 1, rest).when(F.size("left") > level, F.array(F.lit(REST))).otherwise(F.array().cast("array<string>"))
        full = F.concat(F.lit("/"), F.array_join(F.concat("node", tail), "/"))
        now = meet(now, stage_table(node, "nodes"), ["host", "node"], "rows").withColumn("template", F.when(ends | (F.size("left") <= level), full))
        now = stage_table(now.drop("all_n", "kinds", "rows"), "shapes")
        done.append(now.where("template is not null").drop("left", "node"))
        now = now.where("template is null")
        if now.isEmpty():
            break
        seg = F.get("left", F.lit(level))
        now = now.withColumn("seg", seg)
        child = now.groupBy("host", "node", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "good")), F.count("*").alias("rows"))
        whole = child.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
        share = F.try_divide("all_good", "all_labelled")
        error = F.sqrt(share * (1 - share) / F.col("labelled"))
        rare = (F.col("kinds") >= MANY) & (F.col("kinds") > RARE * F.col("all_n")) & (F.col("n") < COMMON * F.col("all_n"))
        # evidence of likeness needs labels in the child and beside it
        alike = (F.col("kinds") > 1) & (F.col("labelled") > 0) & (F.col("labelled") < F.col("all_labelled")) & (F.abs(F.try_divide("good", "labelled") - share) <= ALIKE * error)
        merged = child.join(whole, ["host", "node"]).select("host", "node", "seg", "rows", F.coalesce(rare | alike, F.lit(False)).alias("merged"))
        now = meet(now, stage_table(merged, "children"), ["host", "node", "seg"], "rows")
        branch = F.concat("node", F.array(F.when(F.col("merged"), F.lit(ANY)).otherwise(F.col("seg"))))
        now = stage_table(now.withColumn("node", branch).drop("seg", "merged", "rows"), "shapes")
        level += 1
    return reduce(DataFrame.unionByName, done)


def template_purity(known: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, template, shapes, n, labelled, good and purity: the labelled share of good pages, smoothed by the host's, and that by all."""
    stats = stage_table(known.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "good")), F.count("*").alias("shapes")), "templates")
    hosts = stats.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("good").alias("h_good"))
    total = stats.agg(F.sum("labelled").alias("t_labelled"), F.sum("good").alias("t_good"))
    overall = F.coalesce(F.try_divide("t_good", "t_labelled"), F.lit(1.0))
    host = (F.col("h_good") + prior * overall) / (F.col("h_labelled") + prior)
    joined = stats.join(hosts.crossJoin(F.broadcast(total)).select("host", host.alias("base")), "host")
    return joined.select("host", "template", "shapes", "n", "labelled", "good", ((F.col("good") + prior * F.col("base")) / (F.col("labelled") + prior)).alias("purity"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str] | None = None, least: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity, a row for each row of ``pages(page_id, url, ...)``.

    ``labels(page_id, good)`` marks some pages (1 good, 0 bad); ids with several labels count as good if all are. A url without
    host is of the host '' and is judged like any other. Null page ids are judged but never labelled. Repeated rows count each.
    Very long urls and paths of any depth are judged whole; of rules of equal length the last in alphabetical order wins. Other
    columns are ignored; an empty table gives no rows. Without any label every template is allowed.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    marks = labels.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").cast("int").alias("good"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).join(marks, "page_id", "left")
    known = stage_table(templates(_shapes(parsed)), "known")
    pure = stage_table(template_purity(known).select("host", "template", "purity", "shapes"), "purity")
    judged = stage_table(meet(known, pure, ["host", "template"], "shapes").select("host", "path", "template", "purity", "n"), "judged")
    parsed = parsed.drop("good")
    judged = parsed.join(F.broadcast(judged), ["host", "path"]) if judged.count() <= BROADCAST_SHAPES else meet(parsed, judged, ["host", "path"], "n")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("rule")] if rules else F.lit(None), F.when(F.col("purity") < least, "block").otherwise("allow"))
    return judged.withColumn("rule", rule).withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
