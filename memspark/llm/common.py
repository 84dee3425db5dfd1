"""Shared helpers: table access, the shared folder, checkpoints, batch sizes, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stage_folder, staged

#: Upper and lower-case ASCII; lower-casing is limited to A-Z throughout.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, all above ASCII.
WORD_BYTES = rb"[0-9A-Za-z\x80-\xff]+"
#: Byte table that lower-cases A-Z and turns every byte outside such words into a space.
FOLD = bytes((b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Rows of an Arrow batch: a few MB of text, however long single documents are.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share."""
    return stage_folder(spark, name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation of earlier rounds."""
    return staged(df)


def doc_id() -> Column:
    """doc_id as a bigint; one that is no number counts as null."""
    return F.col("doc_id").try_cast("bigint").alias("doc_id")


def row_key(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with k1, k2: 128 bits of (doc_id, text). Equal rows share them, and share every decision."""
    text = F.col("text").cast("string")
    return df.withColumns({"k1": F.xxhash64(name, text), "k2": F.xxhash64(F.lit(1), text, name)})


def joined_by_count(rows: DataFrame, facts: DataFrame, keys: str | list[str], many: int) -> DataFrame:
    """rows joined with facts, which has one row per key and n, the number of rows with that key.

    Keys of over a thousandth of the rows (`many` at most) are joined by a broadcast of at most 1,000 facts, so that a key with a
    third of all rows meets in no single task; the others are joined by the key. n is dropped. Both tables should be materialised.
    """
    keys, least = [keys] if isinstance(keys, str) else keys, max(1000, many // 1000)
    hot, rest = facts.where(F.col("n") > least).drop("n"), facts.where(F.col("n") <= least).drop("n")
    if hot.isEmpty():
        return rows.join(rest, keys)
    often = rows.join(F.broadcast(hot), keys)
    seldom = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return often.unionByName(seldom)


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def arrow_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply fn to the columns of each Arrow batch, as Python lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = list(to_arrow_schema(_parse_datatype_string(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=pa.schema(fields))

    return df.mapInArrow(run, schema)


def ascii_lower(column) -> Column:
    return F.translate(column, UPPER, LOWER)
