"""Turning arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def exploded(df: DataFrame, keep: list[str], array: Column | str, pos: str, value: str) -> DataFrame:
    """keep, pos (from 0), value: a row per element; empty and null arrays give none.

    The outer form with a test of pos behind it keeps the optimiser from adding a test of the array's size below, which
    would compute the array twice, or once per element where it is used inside a lambda.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def numbered(df: DataFrame, by: list[str], order: list[str], number: str, count: str) -> DataFrame:
    """df with the place of each row (from 1) among those of its `by` in the given order, and their count.

    Rows are dealt to sorted ranges and numbered inside them; a running sum of the ranges' counts gives where each begins. So a group
    of any size is split among tasks, and only counts of ranges (one row a range and group) are put in order. Nulls of `by` are a group.
    """
    ranges = staged(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    counts = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    starts = counts.select(
        *(F.col(b).alias(f"_{b}") for b in by), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias(count),
    )
    same = F.col("_range") == F.col("_r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    placed = ranges.withColumn("_own", own).join(starts, same)
    return placed.withColumn(number, F.col("_before") + F.col("_own")).select(*df.columns, number, count)
