"""CSV files with line breaks in cells, read by several tasks for each file.

Whether a line begins a record depends on all quotes before it: it does if their number
is even. So quotes are counted for each split of a file first, a running sum over the
splits (one number each) tells whether a split begins inside of a cell, and a second scan
joins the lines of each split to records on that ground. A record that reaches over a
split is put together from the end of one split and the beginnings of those that follow.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.sources.sinks import freeze

# Tasks get this module by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, OPEN, MORE = 0, 1, 2
_PARTS = T.StructType([
    T.StructField("_file", T.StringType()), T.StructField("_block", T.LongType()),
    T.StructField("_seq", T.LongType()), T.StructField("_kind", T.IntegerType()), T.StructField("text", T.StringType()),
])


class _Split:
    """Joins the lines of one split to records."""

    def __init__(self, place: tuple[str, int], inside: int):
        self.place, self.inside, self.seq = place, inside, 0
        self.held: list[str] = []
        self.kind = MORE if inside else WHOLE

    def take(self, lines: list[str], odd: np.ndarray) -> list[tuple]:
        """Rows of the records that these lines end; ``odd`` tells which lines hold an odd
        number of quotes."""
        made = []
        for line, turns in zip(lines, odd.tolist()):
            self.held.append(line)
            self.inside ^= turns
            if not self.inside:
                made += self._row()
        return made

    def _row(self) -> list[tuple]:
        text = "\n".join(self.held).removesuffix("\r").replace("\r\n", "\n")
        kind, self.held, self.kind = self.kind, [], WHOLE
        if kind == WHOLE and not text.strip(" "):
            return []  # blank lines are no rows
        row = (*self.place, self.seq, kind, text)
        self.seq += kind != MORE
        return [row]

    def end(self) -> list[tuple]:
        """The record that is still open, if any."""
        if not self.held:
            return []
        self.kind = MORE if self.kind == MORE else OPEN
        return self._row()


def _parts(lines: DataFrame) -> DataFrame:
    """Whole records, open ends and continuations of every split, from lines in order."""
    arrow = to_arrow_schema(_PARTS)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        split = None
        for batch in batches:
            files, blocks = batch.column("_file").to_pylist(), batch.column("_block").to_numpy()
            inside, value = batch.column("_inside").to_numpy(), batch.column("value")
            odd = pc.count_substring(value, '"').to_numpy(zero_copy_only=False) % 2
            lines, made = value.to_pylist(), []
            changes = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1] or blocks[i] != blocks[i - 1]]
            for a, b in zip(changes, [*changes[1:], len(files)]):
                place = files[a], int(blocks[a])
                if split is None or split.place != place:
                    made += split.end() if split else []
                    split = _Split(place, int(inside[a]))
                made += split.take(lines[a:b], odd[a:b])
            if made:
                yield batch_of(made)
        rest = split.end() if split else []
        if rest:
            yield batch_of(rest)

    return lines.mapInArrow(run, _PARTS)


def multi_line_records(spark: SparkSession, path) -> DataFrame:
    """``_file, _block, _seq, text``: every record, by the file, the split (its first byte)
    and the place in the split where it begins. A CR before a line end counts as part of
    it. A quote left open at the end of a file fails the job.

    The sums of splits are broadcast: there are as many as the tasks that the scheduler
    holds for the same scan.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = freeze(lines.groupBy("_file", "_block").agg((F.sum(quotes) % 2).alias("_odd")), "split-quotes")
    so_far = Window.partitionBy("_file").orderBy("_block")
    before = F.coalesce(F.sum("_odd").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    last = F.sum("_odd").over(Window.partitionBy("_file")) % 2 == 1
    error = F.raise_error(F.concat(F.lit("a quote is open at the end of "), F.col("_file"))).cast("long")
    inside = counted.select("_file", "_block", F.when(last, error).otherwise(before).cast("long").alias("_inside"))
    parts = freeze(_parts(lines.join(F.broadcast(inside), ["_file", "_block"])), "csv-records")

    # few rows: two for each split at most
    ends = parts.where(F.col("_kind") != WHOLE)
    in_order = Window.partitionBy("_file").orderBy("_block", F.col("_kind") == OPEN)
    begins = F.when(F.col("_kind") == OPEN, F.struct("_block", "_seq"))
    owner = F.last(begins, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    piece = F.struct("_block", F.col("_kind") == OPEN, "text")
    joined = ends.withColumn("_owner", owner).groupBy("_file", "_owner").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces")
    ).select("_file", "_owner.*", F.array_join(F.transform("_pieces", lambda p: p["text"]), "\n").alias("text"))
    return parts.where(F.col("_kind") == WHOLE).select("_file", "_block", "_seq", "text").unionByName(joined)
