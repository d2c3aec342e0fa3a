"""URL filters: given rules, and a tree of path templates per host for what no rule fits.

Paths are cut into segments. Segments that are plainly variable (numbers, dates, long
hexadecimal or mixed names) become wildcards, and so do all children of a node that has many children
with few pages each. The nodes of a host's tree are counted by aggregation, level by level. Sibling branches
that share the shape below them and whose share of blocked pages does not differ
significantly are merged. A template is rejected if its smoothed purity, the share of its labelled
pages that are blocked, is high enough; what has no labels takes the purity of its parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table, text_of
from plumbscore.session import materialize

ALLOW, BLOCK = "allow", "block"
MANY_CHILDREN = 20
FEW_PAGES = 3.0
SMOOTHING = 4.0
REJECT = 0.5
SIGNIFICANT = 1.96

# The rules of the query, as host, path and verdict.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
MAX_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and for text without ``://``."""
    text = text_of(url)
    rest = F.when(F.contains(text, F.lit("://")), F.expr(f"substring({_sql(url)}, locate('://', {_sql(url)}) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _sql(url: str) -> str:
    return f"coalesce(CAST(`{url}` AS STRING), '')"


def apply_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) plus ``rule`` and ``rule_verdict``, null where none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest
    rule, host and path together, wins, and of equally long ones the first by name. The
    rules are a parameter of at most ``MAX_RULES``; pages meet only those of their own host's suffixes.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.lower(), []).append((path, verdict))
    if not by_host:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    rows = [(h, [(-len(h + p), h + p, p, v) for p, v in ps]) for h, ps in by_host.items()]
    spark = pages.sparkSession
    known = spark.createDataFrame(rows, "suffix string, own array<struct<rank: int, rule: string, rule_path: string, verdict: string>>")
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = hosts.select("host", F.explode(suffixes).alias("suffix")).join(F.broadcast(known), "suffix")
    of_host = materialize(met.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("__rules")), "rules")
    fits = F.get(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    judged = pages.join(of_host, "host", "left").withColumn("__rule", fits)
    return judged.withColumns({"rule": F.col("__rule.rule"), "rule_verdict": F.col("__rule.verdict")}).drop("__rule", "__rules")


def generalise(segment: Column) -> Column:
    """A segment with what is plainly variable as a wildcard; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{2,5})$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(ending))
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), "{date}")
        .when(stem.rlike(r"^\d+$"), "{number}")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(stem.rlike(r"^(?=.*\d)(?=.*[A-Za-z])[\w-]{12,}$"), "{name}")
        .otherwise(stem)
    )
    return F.concat(kind, ending)


def _significant(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Whether shares ``a/n`` and ``b/m`` differ, by a pooled test of two proportions."""
    pooled = (a + b + 1.0) / (n + m + 2.0)
    return F.abs((a + 0.5) / (n + 1.0) - (b + 0.5) / (m + 1.0)) > SIGNIFICANT * F.sqrt(pooled * (1 - pooled) * (1 / (n + 1.0) + 1 / (m + 1.0)))


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages`` plus ``template``: all their generalised segments, wildcards by count included; and a row per shape.

    At each level the children of a node are counted; where there are more than
    ``MANY_CHILDREN`` with ``FEW_PAGES`` pages each or fewer on average, all of them become ``*``. There
    are as many levels as the longest path has segments.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    marked = pages.withColumn("segments", F.transform(parts, generalise))
    # Equal templates are one row from here on; pages get theirs back by a join on (host, raw).
    marked = marked.withColumn("raw", F.array_join("segments", "/"))
    shapes = materialize(marked.groupBy("host", "raw", "segments").agg(F.count("*").alias("pages"), _labels("block"), _labels("allow")), "shapes")
    depth = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    current = shapes.withColumn("template", F.array().cast("array<string>"))
    for level in range(depth):
        here = F.get("segments", F.lit(level))
        nodes = current.where(F.size("segments") > level).groupBy("host", "template").agg(
            F.count_distinct(here).alias("__children"), F.sum("pages").alias("__pages")
        )
        wild = nodes.where((F.col("__children") > MANY_CHILDREN) & (F.col("__pages") <= F.col("__children") * FEW_PAGES))
        wild = wild.select("host", "template", F.lit(True).alias("__wild"))
        joined = current.join(wild, ["host", "template"], "left")
        step = F.when(here.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("__wild"), "*").otherwise(here)))
        current = joined.withColumn("template", F.concat("template", step)).drop("__wild")
        if level % 2:
            current = materialize(current, "level")
    final = materialize(current, "templates")
    back = marked.drop("segments").join(final.select("host", "raw", "template"), ["host", "raw"], "left")
    return back, final


def _labels(verdict: str) -> Column:
    return F.sum((F.coalesce(F.col("rule_verdict"), F.lit("")) == verdict).cast("long")).alias(verdict)


def purities(final: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """``(host, template, purity)`` for every template, from the root of its host down.

    Counts of a node are those of all pages below it. The purity of a node is the share of
    its blocked pages among the labelled ones, smoothed towards that of its parent by
    ``smoothing`` pages; the root is smoothed towards that of all hosts. Similar
    siblings of one shape have their counts pooled.
    """
    everything = final.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.max(F.size("template")).alias("depth")).first()
    prior = ((everything["b"] or 0) + 0.5) / ((everything["b"] or 0) + (everything["a"] or 0) + 2.0)
    nodes = final.select(
        "host", "block", "allow", F.explode(F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.slice("template", F.lit(1), i))).alias("node")
    )
    counted = nodes.groupBy("host", "node").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    counted = counted.withColumn("level", F.size("node")).withColumn("parent", F.slice("node", F.lit(1), F.greatest(F.size("node") - 1, F.lit(0))))
    # The shape of what lies below a branch: the set of its children.
    below = counted.where("level > 0").groupBy("host", F.col("parent").alias("node")).agg(
        F.bit_xor(F.xxhash64(F.element_at("node", -1))).alias("shape")
    )
    shaped = counted.join(below, ["host", "node"], "left").withColumn("shape", F.coalesce("shape", F.lit(0)))
    # Siblings are compared with all siblings of the same shape together.
    family = shaped.groupBy("host", "parent", "level", "shape").agg(F.sum("block").alias("__b"), F.sum("allow").alias("__a"))
    pooled = shaped.join(family, ["host", "parent", "level", "shape"])
    differs = _significant(F.col("block"), F.col("block") + F.col("allow"), F.col("__b"), F.col("__b") + F.col("__a"))
    merged = (F.col("level") > 0) & ~differs
    pooled = pooled.withColumns({"b": F.when(merged, F.col("__b")).otherwise(F.col("block")), "a": F.when(merged, F.col("__a")).otherwise(F.col("allow"))})
    tree = materialize(pooled.select("host", "node", "parent", "level", "b", "a"), "tree")
    purity = tree.where("level = 0").select("host", "node", ((F.col("b") + smoothing * prior) / (F.col("b") + F.col("a") + smoothing)).alias("purity"))
    found = purity
    for level in range(1, (everything["depth"] or 0) + 1):
        above = purity.select("host", F.col("node").alias("parent"), F.col("purity").alias("above"))
        purity = tree.where(F.col("level") == level).join(above, ["host", "parent"])
        purity = purity.select("host", "node", ((F.col("b") + smoothing * F.col("above")) / (F.col("b") + F.col("a") + smoothing)).alias("purity"))
        # Written, so that a deep path does not make a plan that holds every level above again.
        purity = materialize(purity, "purity")
        found = found.union(purity)
    return found.select("host", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", keep: Sequence[str] = ("page_id",), reject: float = REJECT) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` of every row.

    The pages that a rule decides are the labelled ones. A page's verdict is its rule's; without one it is blocked
    if the purity of its template is at least ``reject``. Null and malformed addresses have
    an empty host and path, and are judged like any other. Rows that repeat count each.
    """
    host, path = host_and_path(url)
    ruled = apply_rules(pages.select(*keep, host.alias("host"), path.alias("path")), rules)
    ruled = materialize(ruled, "ruled")
    placed, final = templates(ruled)
    pure = materialize(purities(final), "purities")
    judged = placed.join(pure, ["host", "template"], "left")
    own = F.when(F.col("purity") >= reject, BLOCK).otherwise(ALLOW)
    return judged.select(
        *keep, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )


@query("op9_url_filters")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the rule that fits its address and the verdict on it."""
    return judge(table(spark, folder, "pages"), RULES)
