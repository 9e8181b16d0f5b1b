"""URL filter: given rules first, then a path-template tree per host; DataFrame operations only.

A rule is a host followed by the beginning of a path. It fits its host and all subdomains; the longest that fits wins.
URLs that no rule decides go by the template of their path. The tree of a host is built level by level: a segment is
generalised to a wildcard (with its file extension) if it holds a digit or if its node has very many different
children; then literal siblings merge into a wildcard too if what follows them, and how often labels block them, does
not differ from all siblings together by more than chance allows. A branch without labels gives no evidence: it stays apart
from siblings of which labels block some. A template's purity is the share of blocked URLs
among its labelled ones, smoothed towards the same template on all hosts, which is smoothed towards the overall share.
URLs with a purity above ``reject`` are blocked. Labels are the rules' own verdicts, or any given column.

Defined results: a null URL, or one without ``://``, has an empty host and path. Equal URLs get equal verdicts; rows are
never merged, and other columns are not read. Without labels every template is allowed.

Scale: the tree is as deep as the paths. A node with one URL is a leaf at once, and what all URLs of a node have in common
is passed in one step, so the rounds follow the number of branchings on a path. A node has at most MANY_CHILDREN literal
children that aren't generalised, each with at most 64 shapes of what follows, so comparing siblings holds few rows a node.
Nodes and branches with a large share of the rows are few and looked up by broadcast (see common.lookup).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import hot_bound, lookup, lookup_left, lower_ascii, stored

#: Fixed values of the registered query: rule and verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MANY_CHILDREN, RARE_CHILD = 20, 0.05
#: Segments that a shape of what follows a branch looks at.
SHAPE = 3
SIMILAR, FREQUENT_SHAPE, NOISE, WEIGHT, REJECT = 0.2, 0.1, 2.0, 4.0, 0.6
_PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    return lookup(rows, table, key, "rows", hot_bound(total))


def _joined(segments: Column) -> Column:
    """Segments, generalised where they hold a digit, each with the slash after it."""
    return F.array_join(F.transform(segments, lambda x: F.concat(F.when(x.rlike("[0-9]"), wildcard(x)).otherwise(x), F.lit("/"))), "")


def passed_over(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are done, and those still open with what their node's rows have in common moved to the template.

    A row is done when nothing is left of its path, or when it is the only one of its node.
    """
    open_rows = rows.where(F.size("left") > 0)
    spread = open_rows.groupBy("template").agg(F.count("*").alias("rows"), F.min("left").alias("first"), F.max("left").alias("last"))
    # arrays sort by their first difference, so all share what the first and the last share
    same = F.zip_with("first", "last", lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size("first"))
    looked = _looked_up(open_rows, spread.select("template", "rows", F.col("rows").alias("in_node"), common.cast("int").alias("common")), "template", total)
    ahead = F.when(F.col("in_node") == 1, F.size("left")).otherwise(F.col("common"))
    moved = looked.withColumn("ahead", ahead).withColumn("template", F.concat("template", _joined(F.slice("left", F.lit(1), F.col("ahead")))))
    moved = moved.withColumn("left", F.slice("left", F.col("ahead") + 1, F.size("left") + 1)).select(rows.columns)
    moved = stored(moved)
    return rows.where(F.size("left") == 0).unionByName(moved.where(F.size("left") == 0)), moved.where(F.size("left") > 0)


def one_level(rows: DataFrame, total: int) -> DataFrame:
    """Rows with something left of their path, moved on by one segment."""
    segment = F.element_at("left", 1)
    variable = segment.rlike("[0-9]")
    letter = lambda s: F.when(~s.rlike("[0-9]"), "a").when(s.rlike(r"\.[A-Za-z]{1,5}$"), ".").otherwise("*")
    shape = F.array_join(F.transform(F.slice("left", 2, SHAPE), letter), "")
    here = rows.withColumn("segment", F.when(variable, wildcard(segment)).otherwise(segment)).withColumn("variable", variable)
    labelled, blocked = F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.coalesce("bad", F.lit(0)) * F.col("n"))
    by_shape = here.groupBy("template", "segment", "variable", shape.alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), labelled.alias("labelled"), blocked.alias("blocked"))
    # branches of all nodes; at most 64 shapes each
    branches = by_shape.groupBy("template", "segment", "variable").agg(*[F.sum(c).alias(c) for c in ("n", "rows", "labelled", "blocked")], F.collect_list(F.struct("shape", F.col("n").alias("k"))).alias("shapes"))
    branches = stored(branches)
    # 1. rare ones among very many children are variable too
    nodes = branches.groupBy("template").agg(F.count("*").alias("children"), F.sum("n").alias("in_node"))
    crowded = nodes.where(F.col("children") >= MANY_CHILDREN)
    branches = lookup_left(branches, crowded.withColumn("rows_", F.col("children")), "template", "rows_", hot_bound(branches.count()))
    rare = F.coalesce(F.col("n") < RARE_CHILD * F.col("in_node"), F.lit(False))
    branches = branches.withColumn("general", F.when(F.col("variable"), F.col("segment")).when(rare, wildcard(F.col("segment"))).otherwise(F.col("segment")))
    # 2. literal siblings that behave alike: those with the same frequent shapes of what follows them are compared
    literal = branches.where(~F.col("variable") & ~rare)
    kind = F.array_sort(F.transform(F.filter("shapes", lambda s: s["k"] >= FREQUENT_SHAPE * F.col("n")), lambda s: s["shape"]))
    literal = literal.withColumn("kind", F.array_join(kind, ","))
    siblings = literal.groupBy("template", "kind").agg(
        F.collect_list(F.struct("segment", "n", "labelled", "blocked", "shapes")).alias("each"), F.flatten(F.collect_list("shapes")).alias("pool"), *[F.sum(c).alias(f"kind_{c}") for c in ("n", "labelled", "blocked")]
    ).where(F.size("each") > 1)

    def shared(shapes: Column, n: Column) -> Column:
        in_pool = lambda s: F.aggregate(F.filter("pool", lambda p: p["shape"] == s["shape"]), F.lit(0).cast("long"), lambda t, p: t + p["k"]) / F.col("kind_n")
        return F.aggregate(shapes, F.lit(0.0), lambda t, s: t + F.least(s["k"] / n, in_pool(s)))

    x = F.col("x")
    rate, rate_all = x["blocked"] / F.greatest(x["labelled"], F.lit(1)), F.col("kind_blocked") / F.greatest("kind_labelled", F.lit(1))
    alike = (1 - F.col("overlap") <= SIMILAR + F.sqrt(F.size(x["shapes"]) / x["n"]) / 2) & (
        ((x["labelled"] == 0) & (F.col("kind_blocked") == 0)) | (x["labelled"] > 0) & (F.abs(rate - rate_all) <= NOISE * F.sqrt(rate_all * (1 - rate_all) / F.greatest(x["labelled"], F.lit(1))) + 1e-9)
    )
    compared = siblings.select("template", "pool", "kind_n", "kind_labelled", "kind_blocked", F.explode("each").alias("x")).withColumn("overlap", shared(x["shapes"], x["n"]))
    merged = compared.where(alike).select("template", "x.segment", F.lit("*").alias("merged"))
    named = branches.join(merged, ["template", "segment"], "left").select(F.xxhash64("template", "segment", "variable").alias("branch"), F.coalesce("merged", "general").alias("general"), "rows")
    found = _looked_up(here.withColumn("branch", F.xxhash64("template", "segment", "variable")), named, "branch", total)
    return found.withColumn("template", F.concat("template", "general", F.lit("/"))).withColumn("left", F.slice("left", 2, F.size("left"))).select(rows.columns)


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, bad: 1, 0 or null, n: how many) with ``template``: host and generalised path of its tree's leaf."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    root = F.concat("host", F.when(F.endswith("path", F.lit("/")), F.lit("//")).otherwise(F.lit("/")))
    rows = stored(urls.withColumn("left", segments).withColumn("template", root))
    total = rows.count()
    done, rows = passed_over(rows, total)
    while not rows.isEmpty():
        finished, rows = passed_over(stored(one_level(rows, total)), total)
        done = done.unionByName(finished)
    return done.drop("left")


def purity(rows: DataFrame) -> DataFrame:
    """template, purity and rows of each template of ``templates``."""
    labelled, blocked = F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.coalesce("bad", F.lit(0)) * F.col("n"))
    own = rows.withColumn("path_template", F.expr("substring(template, length(host) + 1)")).groupBy("template", "path_template").agg(labelled.alias("labelled"), blocked.alias("blocked"), F.count("*").alias("rows"))
    own = stored(own)
    shared = own.groupBy("path_template").agg(F.sum("labelled").alias("path_labelled"), F.sum("blocked").alias("path_blocked"), F.count("*").alias("hosts"))
    overall = own.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 1.0)).alias("p")).first()[0]
    by_path = (F.col("path_blocked") + WEIGHT * overall) / (F.col("path_labelled") + WEIGHT)
    return lookup(own, shared, "path_template", "hosts", hot_bound(own.count())).select("template", ((F.col("blocked") + WEIGHT * by_path) / (F.col("labelled") + WEIGHT)).alias("purity"), "rows")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the template and purity that decide where no rule does."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parts = stored(parts.withColumn("rule", rule).withColumn("given", verdict).withColumn("url_key", F.sha2(F.concat_ws("\n", "host", "path"), 256)))
    bad = F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0)
    urls = parts.groupBy("url_key", "host", "path", bad.alias("bad")).agg(F.count("*").alias("n"))
    named = stored(templates(urls))
    pure = purity(named)
    verdicts = _looked_up(named.select("url_key", "template", F.col("n").alias("copies")), pure, "template", named.count()).select("url_key", "template", "purity", F.col("copies").alias("rows"))
    return _looked_up(parts, verdicts, "url_key", parts.count()).select(
        "page_id", "host", "path", "rule", F.coalesce("given", F.when((F.col("purity") > reject) & F.lit(bool(rules)), "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )
