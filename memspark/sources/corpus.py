"""Corpora: walked file trees and rows with text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash


def list_corpus(spark: SparkSession, root: str, context: str = "default", contents: bool = False) -> DataFrame:
    """context, root, rel, size, mtime (seconds) of every file below root; with contents also content and hash. Without, no file is read."""
    return file_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, context, contents)


def relative(path: Column, root: str) -> Column:
    """The part of a file's path below root."""
    base = root.rstrip("/").removeprefix("file://")
    if "://" in base:
        return F.element_at(F.split(path, "\\Q" + base + "/\\E"), -1)
    return F.substring(F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?(?=/)", ""), len(base) + 2, 1 << 30)


def file_rows(files: DataFrame, root: str, context: str = "default", contents: bool = False) -> DataFrame:
    """The same of binary files (path, modificationTime, length, content), read or streamed."""
    rows = files.select(
        F.lit(context).alias("context"), F.lit(root).alias("root"), relative(F.col("path"), root).alias("rel"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if contents else []),
    )
    return rows.withColumn("hash", content_hash(F.col("content"))) if contents else rows


def from_rows(df: DataFrame, id_col: str, text_col: str, source_col: str | None = None) -> DataFrame:
    """Units of rows with text; the source is source_col, or inline/<id>.txt."""
    source = F.concat(F.lit("inline/"), F.col(id_col).cast("string"), F.lit(".txt"))
    return df.select(*(["context"] if "context" in df.columns else [F.lit("default").alias("context")]), F.coalesce(source_col, source).alias("source_path") if source_col else source.alias("source_path"), F.col(text_col).alias("text"))
