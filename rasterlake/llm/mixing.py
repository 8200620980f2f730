"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent t and normalised: t = 1 keeps the natural mix, t = 0 weighs all sources alike.
The exponent is bisected so that the mix meets a target: the largest repetition of any source stays within a limit, or the
entropy of the weights reaches a value. Weights become token budgets, scaled so that the least repeated source is read exactly
once: no document is ever left out, and the others repeat. A budget is realised as whole passes over a permutation of the
source's blocks, and a last pass that starts no document once it is spent. Blocks are a fixed number of hashed sets of
documents, so that no source, however large, is ordered in one place.

Edge cases: a null source is a source of its own; a null text has no tokens; sources without tokens are read once; a null id
is ordered first; repeated rows are repeated rows of the result; an empty table gives an empty result; a very long text is one
document of as many tokens as it has words; other columns than those carried are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import small, table

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """max_repeat bounds every source's passes; entropy, if given, is the wanted share of the most even mix's entropy."""

    max_repeat: float = 2.0
    entropy: float | None = None
    steps: int = 40
    seed: str = "mix"
    hex_digits: int = 3  # 16 ** hex_digits blocks of a source


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _entropy(x: str) -> str:
    """SQL of the entropy of weights p**x over the array p."""
    total = f"aggregate(p, 0D, (a, v) -> a + pow(v, {x}))"
    return f"ln({total}) - {x} * aggregate(p, 0D, (a, v) -> a + pow(v, {x}) * ln(v)) / {total}"


def solve(sources: DataFrame, target: Target) -> DataFrame:
    """src, n_tokens, share, t, weight, repeats of each source with tokens. sources: one row (src, n_tokens) for each."""
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.filter("n_tokens > 0").withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(every))
    mid = "((s.lo + s.hi) / 2)"
    if target.entropy is None:  # repetitions go with share**(t-1): the least share repeats most, the largest least
        met, towards = f"pow(element_at(p, 1) / element_at(p, -1), {mid} - 1) <= {float(target.max_repeat)!r}D", "hi"
    else:  # the lower t, the more even
        met, towards = f"{_entropy(mid)} >= {float(target.entropy)!r}D * ln(size(p))", "lo"
    low, high = ("s.lo", mid) if towards == "hi" else (mid, "s.hi")
    other_low, other_high = (mid, "s.hi") if towards == "hi" else ("s.lo", mid)
    step = f"if({met}, named_struct('lo', {low}, 'hi', {high}), named_struct('lo', {other_low}, 'hi', {other_high}))"
    one = s.agg(F.sort_array(F.collect_list("share")).alias("p"))
    one = one.select(F.expr(f"aggregate(sequence(1, {target.steps}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> {step})").alias("s"))
    one = one.select(F.round(F.col(f"s.{towards}"), 6).alias("t"))
    s = s.join(F.broadcast(one))  # a single row
    s = s.withColumn("w", F.pow("share", "t")).withColumn("weight", F.col("w") / F.sum("w").over(every)).withColumn("ratio", F.col("weight") / F.col("share"))
    return s.withColumn("repeats", F.round(F.col("ratio") / F.min("ratio").over(every), 4)).select("src", "n_tokens", "share", "t", "weight", "repeats")


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def plan_blocks(blocks: DataFrame, target: Target) -> DataFrame:
    """Of each block (src, block, block_tokens): passes that read it whole, and the tokens that its partial pass may take."""
    plan = solve(blocks.groupBy("src").agg(F.sum("block_tokens").alias("n_tokens")), target)
    b = blocks.join(plan.select("src", "repeats", F.col("n_tokens").alias("src_tokens")), "src", "left").withColumn("repeats", F.coalesce("repeats", F.lit(1.0)))
    b = b.withColumn("passes", F.floor("repeats").cast("int"))
    b = b.withColumn("budget", F.coalesce(F.floor((F.col("repeats") - F.col("passes")) * F.col("src_tokens")).cast("long"), F.lit(0)))
    before = Window.partitionBy("src").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("block_key", _md5(F.lit(target.seed), F.col("passes"), F.col("block")))
    b = b.withColumn("room", F.col("budget") - F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    whole = (F.col("room") > 0) & (F.col("room") >= F.col("block_tokens"))
    return b.select("src", "block", "repeats", F.col("passes").alias("last"), (F.col("passes") + whole.cast("int")).alias("whole"), F.when((F.col("room") > 0) & ~whole, F.col("room")).otherwise(0).alias("room"))


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and pass: doc_id, src, n_tokens, pass (from 0), block, order_key, repeats, and columns carried as c_<name>.

    order_key orders a source's documents within a pass: the pass's permutation of blocks, then a permutation in the block.
    """
    source = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("src"), tokens(F.col(text_col).cast("string")).alias("n_tokens"),
        _md5(F.lit(target.seed), F.col(id_col).cast("long")).alias("doc_key"), *(F.col(c).alias(f"c_{c}") for c in carry),
    ).withColumn("block", F.substring("doc_key", 1, target.hex_digits))
    blocks = table(rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    placed = rows.join(small(table(plan_blocks(blocks, target), "mix-plan")), ["src", "block"])
    whole = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    inside = Window.partitionBy("src", "block").orderBy("doc_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = placed.filter("room > 0").withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    part = part.filter("before < room").drop("before").withColumn("pass", F.col("last"))
    both = whole.unionByName(part)
    order = F.concat(_md5(F.lit(target.seed), F.col("pass"), F.col("block")), F.col("doc_key"))
    return both.select("doc_id", "src", "n_tokens", "pass", "block", order.alias("order_key"), "repeats", *(f"c_{c}" for c in carry))
