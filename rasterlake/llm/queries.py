"""The registered queries of the training-data operators, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake import attach

from . import chat, fertility, gam, jaccard, lm, mixing, oracles, packing, substrings, urls, vectors


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read(spark, sf_dir, "conversations"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read(spark, sf_dir, "documents"), fertility.Rules(tokenizer("piece_bpe_32k.model")))


def op3_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(read(spark, sf_dir, "documents"), digest=True)


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


RULES = [urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/")]


def op9_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages are those of the documents with the same id: a page is good if its quality is 1."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.judge(read(spark, sf_dir, "pages"), labels, RULES)


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_snapshots, op2_tokeniser_fertility, op3_product_quantisation, op4_suffix_automata, op5_additive_quality, op6_token_groups, op7_shortest_pack_first, op8_context_mixing, op9_path_templates, op10_temperature_mix)
}

ORACLE: dict[str, str] = {
    "op1_chat_snapshots": oracles.CHAT,
    "op3_product_quantisation": oracles.VECTORS,
    "op4_suffix_automata": oracles.SUBSTRINGS,
    "op6_token_groups": oracles.JACCARD,
    "op9_path_templates": oracles.templates(RULES),
    "op10_temperature_mix": oracles.MIXING,
}
