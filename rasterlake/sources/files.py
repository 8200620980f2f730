"""Files of a folder as rows, and tables kept as TOML files."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators.lookup import supported


def scan(spark: SparkSession, folder: str, recursive: bool = True, only_supported: bool = True) -> DataFrame:
    """path, length, digest and content of a folder's files, with its subfolders; only those with the extension of a raw image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.filter(supported(F.col("path"))) if only_supported else files
    return files.select("path", "length", F.md5("content").alias("digest"), "content")


def toml_tables(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """path, at, row (JSON) of every entry of an array of tables, in all TOML files of a folder with its subfolders, numbered by path and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, i, json.dumps(x, default=str)) for p, c in zip(batch["path"], batch["content"], strict=True) for i, x in enumerate(tomllib.loads(bytes(c).decode()).get(key, []))]
            yield pd.DataFrame(found, columns=["path", "i", "row"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.toml").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, i long, row string").orderBy("path", "i")
