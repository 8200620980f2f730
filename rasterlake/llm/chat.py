"""Chat formatting with cumulative-snapshot collapse.

Logging a chat after each turn leaves snapshots that are prefixes of the final conversation. Every turn gets a rolling hash of
the conversation up to it: the exclusive-or of 128 bits per (position, role, text), which a running window extends turn by
turn. The hash of a whole conversation that is also the hash of a proper prefix of another marks a snapshot, and anti-joins
retain the maximal conversations, which are then rendered.

Edge cases: turns are ordered by (turn, role, text) with nulls first; exact repeats of a row count once; a null role or text
differs from an empty one in the hash and is rendered as an empty string; rows with a null conversation id belong to no
conversation and are left out; equal conversations keep the smallest id; a very long text is hashed and rendered whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import table

#: Turns of one conversation that one window orders; longer ones are ordered span by span.
SPAN = 256


def _halves(position: Column, role: Column, text: Column) -> list[Column]:
    parts = [position, F.coalesce(role, F.lit("")), role.isNull(), F.coalesce(text, F.lit("")), text.isNull()]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (11, 29)]


def distinct_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    cols = [F.col(c).cast(kind).alias(name) for c, kind, name in ((id_col, "long", "conv_id"), (turn_col, "long", "turn"), (role_col, "string", "role"), (text_col, "string", "text"))]
    return turns.select(*cols).filter("conv_id is not null").distinct()


def prefixes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position of each distinct turn (from 1) and rolling hash (h1, h2) of the conversation up to it."""
    t = distinct_turns(turns, id_col, turn_col, role_col, text_col)
    t = t.withColumn("span", F.coalesce(F.expr(f"turn div {SPAN}"), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
        """Running sums inside a span plus those of all earlier spans."""
        rows = rows.select("*", *(F.expr(f"{f}({c})").over(inside).alias(f"in_{c}") for c, f in sums.items()))
        whole = rows.groupBy("conv_id", "span").agg(*(F.expr(f"{f}({c})").alias(f"all_{c}") for c, f in sums.items()))
        whole = whole.select("conv_id", "span", *(F.coalesce(F.expr(f"{f}(all_{c})").over(before), F.lit(0)).alias(f"pre_{c}") for c, f in sums.items()))
        return rows.join(whole, ["conv_id", "span"])

    t = carried(t.withColumn("one", F.lit(1)), {"one": "sum"}).withColumn("position", F.col("in_one") + F.col("pre_one"))
    t = t.drop("one", "in_one", "pre_one")
    a, b = _halves(F.col("position"), F.col("role"), F.col("text"))
    t = carried(t.withColumns({"a": a, "b": b}), {"a": "bit_xor", "b": "bit_xor"})
    return t.select("conv_id", "position", F.expr("in_a ^ pre_a").alias("h1"), F.expr("in_b ^ pre_b").alias("h2"))


def render(role: Column, text: Column) -> Column:
    """One turn in a chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies (equal conversations, itself included), rendered."""
    hashed = table(prefixes(turns, id_col, turn_col, role_col, text_col), "chat-prefixes")
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    classes = ends.groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashed.join(ends.select("conv_id", F.col("position").alias("n")), "conv_id").filter("position < n").select("position", "h1", "h2").distinct()
    kept = classes.join(proper, ["position", "h1", "h2"], "left_anti").select("conv_id", "n_copies")
    said = distinct_turns(turns, id_col, turn_col, role_col, text_col).join(kept, "conv_id")
    said = said.groupBy("conv_id", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return said.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"])), "").alias("rendered"))
