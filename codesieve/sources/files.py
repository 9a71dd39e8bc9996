"""Samples from folders, and manifests of their digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.native import hashes, integrity


def samples(spark: SparkSession, path: str, glob: str | None = None, skip: str | None = None) -> DataFrame:
    """path, length, content and text (bad UTF-8 replaced) of files; a scan that reads only what is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if skip:
        df = df.filter(~F.col("path").rlike(skip))
    return df.select("path", "length", "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifest(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(key).alias("rel_path"), hashes(F.col(content))["sha256"].alias("sha256"))


def check_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """rel_path and status (ok, mismatch, missing) of each expected file."""
    return expected.alias("e").join(actual.alias("a"), "rel_path", "left").select("rel_path", integrity(F.col("e.sha256"), F.col("a.sha256")).alias("status"))
