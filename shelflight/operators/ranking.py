"""Row numbers within groups that may be too large for one task; counted broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflight.settings import SMALL_ROWS
from shelflight.sources.sinks import freeze


def spread_row_number(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``row_number()`` over ``group`` by ``order`` without one task per group.

    A range sort spreads every group over as many partitions as its rows need.
    The sorted rows are written with their place (a repeated range sort may cut
    elsewhere), so a row's number is its distance from the group's first row of the
    partition, plus the group's rows in earlier partitions: two numbers for each
    (partition, group), read from two columns of the written table and attached by a
    join that leaves the rows where they are while that table is small.
    """
    placed = df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    frozen = (
        freeze(placed, "sorted-rows")
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_group", F.struct(*group))
    )
    sizes = frozen.groupBy("_part", "_group").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    before = (
        Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    starts = sizes.select("_part", "_group", (F.col("_first") - earlier).alias("_start"))
    return (
        frozen.join(starts, ["_part", "_group"])
        .withColumn(name, (F.col("_at") - F.col("_start") + 1).cast("int"))
        .drop("_group", "_part", "_at", "_start")
    )


def row_numbers(
    df: DataFrame, group: list[str], order: list[Column], name: str, spread: bool
) -> DataFrame:
    """Plain window where groups are bounded by a hit list, spread otherwise."""
    if spread:
        return spread_row_number(df, group, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def is_small(df: DataFrame) -> bool:
    """Whether a table has SMALL_ROWS rows at most, by counting no more than that."""
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def small_side(df: DataFrame) -> DataFrame:
    """A table that is broadcast if its counted rows allow it, else as Spark chooses."""
    return F.broadcast(df) if is_small(df) else df
