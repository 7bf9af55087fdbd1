"""Operator 8: a keyed pseudo-random permutation of all rows, and shards from it.

Rows are numbered 0 to n - 1 in the order of their id. A Feistel network permutes
a domain of a * a numbers, the smallest square that holds n; a number that lands
outside 0 to n - 1 goes through the network again (cycle walking), which makes it
a permutation of the row numbers. Row number p of the shuffled order goes to
shard p mod k, slot p div k. So any row's place is computable from its number,
the seed, n and k alone, shards differ by one row at most, and slots have no gaps.

DataFrame functions only. The round function is MD5, which SQL engines share.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflight.llm.common import column
from shelflight.sources.sinks import freeze

ROUNDS = 4
# Network passes unrolled in one expression. A pass leaves the domain with
# probability below 2 / sqrt(n); rows not home after these take more passes.
PASSES = 6


def _div(number: Column, by: int) -> Column:
    return ((number - number % by) / by).cast("bigint")


def _network(number: Column, side: int, seed: int) -> Column:
    """One pass: (left, right) -> (right, (left + f(right)) mod side), ROUNDS times."""

    def turn(state: Column, i: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), i.cast("string"), state["r"].cast("string"))
        noise = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
        return F.struct(state["r"].alias("l"), ((state["l"] + noise) % side).alias("r"))

    start = F.struct(_div(number, side).alias("l"), (number % side).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * side + s["r"]
    )


def permuted(numbered: DataFrame, number: str, n: int, seed: int, name: str) -> DataFrame:
    """Adds ``name``, the place of row ``number`` (0 to n - 1) in the shuffled order."""
    side = isqrt(max(n - 1, 0)) + 1

    def walk(value: Column, passes: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(passes)), value,
            lambda x, _: F.when(x < n, x).otherwise(_network(x, side, seed)),
        )

    out = numbered.withColumn(name, walk(_network(F.col(number), side, seed), PASSES))
    while out.where(F.col(name) >= n).limit(1).count():  # practically never
        out = freeze(out.withColumn(name, walk(F.col(name), 64)), "walk")
    return out


def numbered_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of ``order`` over all rows.

    A range sort spreads the rows; the sorted rows are written, numbered within
    their part file by position, and shifted by the rows of the files before (one
    number a file, summed in a table that has one row for each file).
    """
    ordered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    written = freeze(ordered, "numbered").withColumn("_part", F.shiftright("_at", 33))
    sizes = written.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        written.join(F.broadcast(shifts), "_part")
        .withColumn(name, within + F.col("_shift"))
        .drop("_part", "_at", "_shift")
    )


def shard(
    docs: DataFrame, shards: int, seed: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, place, shard, slot`` of every row.

    Rows are numbered by ``doc_id`` (null first); rows that repeat an id by size
    and checksum, and rows equal in all three are interchangeable. ``size`` is the
    text's UTF-8 bytes plus 1. A null text has size 1 and checksum 0. An empty
    table gives no rows. Other columns are left behind.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(column(text_col), F.lit(""))
    light = docs.select(
        column(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered = numbered_rows(light, ["doc_id", "size", "text_crc32"], "row_number")
    n = numbered.count()
    return permuted(numbered, "row_number", n, seed, "place").withColumns({
        "shard": (F.col("place") % shards).cast("int"),
        "slot": _div(F.col("place"), shards),
    })
