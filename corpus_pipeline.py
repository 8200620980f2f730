"""A training-data pipeline over documents: classify, drop near copies, cut repeated passages, mix sources, pack.

Every stage reads the five columns of documents by name and returns them; any others, whatever their names, end at the first stage.

Edge cases: a null or empty text is scored like any other text, is nobody's near copy, loses no passage and packs as its end id alone; a
null id passes the classifier and near copies, is no reference for passages, and packs like any other; repeated rows are judged
alike, and all rows of a kept id stay; an empty table gives empty results; very long texts pass every stage whole, in memory that grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake import attach
from rasterlake.llm import gam, jaccard, mixing, packing, substrings
from rasterlake.llm.queries import read, tokenizer
from rasterlake.llm.runtime import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a batch between Spark and Python; Spark's own limit is 64 MB, beside its heap.
BATCH = "4m"


def ready(spark: SparkSession) -> SparkSession:
    """A session whose Python workers find this package, and whose batches are small unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll and spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH)
    return attach(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive quality classifier does not reject."""
    ready(spark)
    return gam.reject(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies."""
    ready(spark)
    return jaccard.representatives(docs.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document with a smaller id holds too."""
    ready(spark)
    cut = substrings.dedupe(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), F.col("c_lang").alias("lang"), F.col("c_source").alias("source"), F.length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources repeat up to twice."""
    ready(spark)
    out = mixing.mix(docs, mixing.Target(max_repeat=2.0), carry=COLUMNS)
    return out.select(*(F.col(f"c_{c}").alias(c) for c in COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    ready(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", passages), ("mixing sources", mix), ("packing", pack)]

#: The stages use trained models, automata and tokenisers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, f"stage{i}")
    return docs
