"""URL filters: host and path rules, then a path-template tree per host.

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's path, and the longest rule wins.
For other URLs each host has a tree of path segments. Segments that are numbers, hashes, dates or otherwise variable (a node
with more than ``max_values`` distinct ones) become typed wildcards. Sibling branches whose continuations and labels do not
differ statistically are merged into one wildcard branch. A template with labels is rejected if its smoothed share of good ones
is below a limit.

Trees are built level by level from counts, as deep as the paths go: rows are aggregated by (host, path shape) before any step, so
a host with a third of all URLs is as many rows as it has shapes. A shape that is the only one below its node is finished at once,
as no further segment of it has siblings.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which are a host of their own; a null page id is
returned as it is; repeated rows are repeated rows of the result and each counts; labels other than 0 and 1 are left out; a literal
segment that begins with < gets a backslash, so that it is no wildcard; a very long path is one level for each segment that has
siblings; empty tables give empty results, or allow all; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import small, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host/path, e.g. example.com/de/

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


@dataclass(frozen=True)
class Tree:
    depth: int = 4  # of the SQL alone, which agrees with the operator where no path is deeper
    max_values: int = 20  # distinct literal segments under a node, above which they are variable
    prior: float = 5.0  # pseudo-labels at the overall share of good labels
    min_labels: int = 20  # of the SQL alone, which agrees where no template with fewer labels is below the limit
    min_purity: float = 0.5
    spread: float = 3.0  # standard deviations within which siblings count as similar


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, or nulls."""
    pattern = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def kind(segment: Column) -> Column:
    """Typed wildcard of a segment that is variable by its form; other segments stay as they are."""
    stem = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    tail = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    named = (
        F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "<date>").when(stem.rlike(r"^[0-9]+$"), "<num>")
        .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F]{8,}$"), "<hex>").when(stem.rlike(r"^[A-Za-z]+([-_][A-Za-z0-9]+){3,}$"), "<slug>")
        .when(F.length(stem) > 40, "<long>").when(stem.startswith("<"), F.concat(F.lit("\\"), stem)).otherwise(stem)
    )
    return F.concat(named, tail)


def segments(path: Column) -> Column:
    """All typed segments."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), kind)


def summed(rows: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    """Adds sums by key: an aggregate that is combined before its shuffle, and a join that Spark broadcasts or splits where a key has many rows."""
    return rows.join(rows.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items())), keys)


def templates(shapes: DataFrame, tree: Tree) -> DataFrame:
    """host, shape, template of each path shape. shapes: host, shape (array), n, labelled, good."""
    rows = shapes.select("host", "shape", "n", "labelled", "good", F.array().cast("array<string>").alias("node"))
    done, level = [], 0
    at = lambda i: F.coalesce(F.get("shape", F.lit(i)), F.lit("<end>"))
    while level == 0 or not rows.isEmpty():
        here = rows.withColumn("seg", at(level)).withColumn("next", at(level + 1))
        by_next = here.groupBy("host", "node", "seg", "next").agg(F.count("*").alias("shapes"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        by_next = table(by_next, f"url-next{level}")
        e = summed(by_next, ["host", "node"], all_n="n", all_l="labelled", all_g="good")
        e = summed(summed(e, ["host", "node", "next"], next_n="n"), ["host", "node", "seg"], seg_n="n")
        expected = F.col("seg_n") * F.col("next_n") / F.col("all_n")
        by_seg = e.withColumn("x", F.pow(F.col("n") - expected, 2) / expected).withColumn("e", expected).groupBy("host", "node", "seg").agg(
            F.sum("x").alias("x"), F.sum("e").alias("e"), F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum("shapes").alias("shapes"), F.sum("labelled").alias("l"), F.sum("good").alias("g"), F.max("all_l").alias("all_l"), F.max("all_g").alias("all_g")
        )
        # cells that a branch lacks add their expected counts
        chi = F.col("x") + F.col("n") - F.col("e")
        df = F.greatest(F.col("cells") - 1, F.lit(1))
        share = (F.col("all_g") + 1) / (F.col("all_l") + 2)
        off = F.abs(F.col("g") - F.col("l") * share) / F.sqrt(F.col("l") * share * (1 - share) + 1)
        alike = (chi <= df + tree.spread * F.sqrt(2 * df)) & (off <= tree.spread)
        literal = ~F.col("seg").startswith("<")
        by_seg = by_seg.withColumn("alike", alike & literal)
        by_seg = table(by_seg.withColumns({"one_alike": F.col("alike").cast("int"), "one_literal": literal.cast("int")}), f"url-segments{level}")
        by_seg = summed(by_seg, ["host", "node"], n_alike="one_alike", values="one_literal")
        name = F.when(literal & (F.col("values") > tree.max_values), "<*>").when(F.col("alike") & (F.col("n_alike") > 1), "<=>").otherwise(F.col("seg"))
        by_seg = by_seg.withColumn("name", name).select("host", "node", "seg", "name", "shapes")
        by_seg = summed(by_seg, ["host", "node", "name"], all_shapes="shapes").drop("shapes").withColumnRenamed("all_shapes", "shapes")
        rows = here.join(by_seg, ["host", "node", "seg"]).withColumn("node", F.concat("node", F.array("name"))).drop("seg", "next", "name")
        rows = table(rows, f"url-level{level}")
        over = (F.col("shapes") == 1) | (F.size("shape") <= level)
        whole = F.filter(F.concat("node", F.slice("shape", level + 2, F.size("shape"))), lambda s: s != "<end>")
        done.append(rows.filter(over).withColumn("template", F.concat(F.lit("/"), F.array_join(whole, "/"))).drop("node", "shapes"))
        rows, level = rows.filter(~over).drop("shapes"), level + 1
    return reduce(DataFrame.unionByName, done)


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], tree: Tree = Tree(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every URL. labels: page_id, good (0 or 1)."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    p = p.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    p = p.withColumn("shape", segments(F.col("path")))
    good = labels.selectExpr("cast(page_id as long) page_id", "cast(good as int) good").filter("good in (0, 1)").groupBy("page_id").agg(F.min("good").alias("good"))
    counted = p.select("page_id", "host", "shape").join(good, "page_id", "left").groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    named = table(templates(table(counted, "url-shapes"), tree), "url-templates")
    total = named.agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("overall"))
    by = named.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).join(F.broadcast(total))  # one row
    purity = (F.col("g") + tree.prior * F.col("overall")) / (F.col("l") + tree.prior)
    by = by.select("host", "template", purity.alias("purity"), ((F.col("l") > 0) & (purity < tree.min_purity)).alias("rejected"))
    found = table(named.select("host", "shape", "template").join(by, ["host", "template"]), "url-verdicts")
    pattern, verdict = rule(rules, F.col("host"), F.col("path"))
    out = p.join(small(found, 100_000), ["host", "shape"], "left")
    return out.select("page_id", "host", "path", pattern.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity")
