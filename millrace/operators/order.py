"""Consecutive numbers and running totals in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.tables import stored

#: monotonically_increasing_id: the partition's number above, the row's number in it below.
_ROW_BITS = 33


def by_range(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted over partitions by range, stored, with `_place` (a number that grows with the order) and `_part` (its range).

    Ranges are sampled and so may differ from run to run; the stored table holds one choice.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return stored(placed, "sorted").withColumn("_part", F.shiftright("_place", _ROW_BITS))


def joined_by_range(df: DataFrame, by_part: DataFrame) -> DataFrame:
    """df with the columns of by_part, which has a row a range and so is sent to all tasks."""
    return df.join(F.broadcast(by_part), "_part")


def _before(df: DataFrame, value: Column) -> DataFrame:
    """(_part, _base): what the ranges before each have in sum."""
    parts = df.groupBy("_part").agg(value.alias("_own"))
    return parts.select("_part", (F.sum("_own").over(W.orderBy("_part")) - F.col("_own")).alias("_base"))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the rows' numbers from 0 in the given order.

    Rows that the order doesn't tell apart are numbered in any order among themselves, and stay in one
    range: end the order with what tells rows apart. An empty table gives an empty result.
    """
    rows = by_range(df, order)
    number = F.col("_base") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return joined_by_range(rows, _before(rows, F.count("*"))).withColumn(name, number).select(*[f"`{c}`" for c in df.columns], name)


def summed_before(df: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over the rows before each in the given order (0 for the first; nulls count 0).

    Each range is summed by itself; what stands before it is added. Rows that the order doesn't tell
    apart count in any order among themselves.
    """
    rows = by_range(df, order)
    own = F.coalesce(F.col(f"`{value}`"), F.lit(0))
    inside = F.sum(own).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)) - own
    return joined_by_range(rows.withColumn(name, inside), _before(rows, F.sum(own))).withColumn(name, F.col("_base") + F.col(name)).select(*[f"`{c}`" for c in df.columns], name)
