"""Operator 13: runs of periodically repeated words, and texts collapsed to one period.

A run is a stretch of consecutive words whose smallest period is q, at least
``max(shortest, 2 * q)`` words long, that no neighbouring word extends.

1. A document is exploded into tiles for each octave of periods (2^k up to 2^(k+1)).
   A tile is at least 16 times as long as the octave's least period and overlaps the
   next by more than twice its greatest one, so every run is seen in each tile that
   holds enough of it. Octaves whose tiles are equal share them. A text of up to
   ``long_bytes`` is one tile and solved where its row is; the tiles of longer texts
   are dealt over all tasks.
2. A tile is solved by itself. Boundaries stand at every m-th word; a run with period
   q spans a whole step of m words that recurs q words later. Boundaries where a step
   recurs are chained, and the Z-values (how far the words before the first boundary
   and after the last one agree with those q further) close each chain on both sides.
   Values come from hashes of 1, 2, 4, ... words, all boundaries at once; the result
   is compared word by word, and solved again with other hashes if one had collided.
3. Fragments of the long texts are shuffled by document and period; those that overlap
   by a period or more are one stretch. Of equal stretches the least period is a run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm.common import id_and_text, text_slices

SHORTEST = 12
# Bytes of a text up to which it is one tile.
LONG_BYTES = 1 << 16
# Words of a long text's smallest tile.
TILE_WORDS = 1 << 14
# Bytes of text solved as one array.
TOGETHER = 1 << 20
# Comparisons of boundaries with later words at once.
AT_ONCE = 1 << 22

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.uint64(31), np.uint64(29)


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> _SHIFTS[0]
    values *= _ODD
    values ^= values >> _SHIFTS[1]
    return values


class _Steps:
    """Hashes of every 1, 2, 4, ... consecutive words of an array."""

    def __init__(self, numbers: np.ndarray, seed: int):
        self.factor = np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
        self.levels = [_mixed(numbers.astype(np.int64).view(np.uint64) + np.uint64(seed))]

    def of(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            size = max(len(last) - half, 0)
            self.levels.append(_mixed(last[:size] * self.factor + last[half:half + size]))
        return self.levels[level]

    def agree(self, level: int, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether 2^level words from ``at`` recur ``period`` words later; places
        outside of the array never do."""
        step = self.of(level)
        inside = (at >= 0) & (at + period < len(step))
        if not len(step):
            return inside
        x = np.where(inside, at, 0)
        return inside & (step[x] == step[np.where(inside, at + period, 0)])


def _boundary_step(octave: int, shortest: int) -> int:
    """Level of the greatest step that fits at boundaries into every run of the octave."""
    low = 1 << octave
    least = min(max(shortest - q, q) for q in range(low, 2 * low)) if low <= shortest else low
    return ((least + 1) // 2).bit_length() - 1


def _octave(steps: _Steps, n: int, octave: int, shortest: int) -> list[np.ndarray]:
    """(start, stop, period) of the stretches with a period of the octave."""
    low, level = 1 << octave, _boundary_step(octave, shortest)
    m = 1 << level
    step = steps.of(level)
    rows = max((len(step) - low + m - 1) // m, 0)
    padded = np.concatenate([step[low:], np.zeros(low, np.uint64)])
    later = np.lib.stride_tricks.as_strided(padded, (rows, low), (m * 8, 8), writeable=False)
    own, hits = step[::m], []
    for at in range(0, rows, max(AT_ONCE // low, 1)):
        some = slice(at, min(at + max(AT_ONCE // low, 1), rows))
        row, col = np.nonzero(later[some] == own[some, None])
        hits.append(((row + at) * m, col + low))
    place, period = (np.concatenate(side) for side in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 2
    inside = place + period < len(step)
    place, period = place[inside], period[inside]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    opens = np.ones(len(place), bool)
    opens[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + m)
    first, q = place[opens], period[opens]
    last = place[np.append(np.flatnonzero(opens)[1:] - 1, len(place) - 1)] + m if len(place) else first
    for j in reversed(range(level)):
        first = first - (steps.agree(j, first - (1 << j), q) << j)
        last = last + (steps.agree(j, last, q) << j)
    stop = last + q
    enough = stop - first >= np.maximum(2 * q, shortest)
    return [first[enough], stop[enough], q[enough]]


def stretches(
    numbers: np.ndarray, low: int = 0, high: int | None = None, shortest: int = SHORTEST, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of the stretches of an array, by start and stop; of the
    periods in octaves ``low`` to ``high`` that a stretch has, the least."""
    n = len(numbers)
    top = (n // 2).bit_length() - 1 if n > 1 else -1
    high = top if high is None else min(high, top)
    steps = _Steps(numbers, seed)
    found = [_octave(steps, n, k, shortest) for k in range(low, high + 1)]
    start, stop, period = (
        np.concatenate([np.zeros(0, np.int64), *side]).astype(np.int64) for side in (zip(*found) if found else ((), (), ()))
    )
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    for a, b, q in zip(start.tolist(), stop.tolist(), period.tolist()):
        if not np.array_equal(numbers[a:b - q], numbers[a + q:b]):
            return stretches(numbers, low, high, shortest, seed + 1)
    return start, stop, period


def tiles(n: int, tile: int = TILE_WORDS, shortest: int = SHORTEST) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, low, high): the tiles of a document of ``n`` words and the octaves
    to look for in each."""
    top = (n // 2).bit_length() - 1 if n > 1 else -1
    low = 0
    while low <= top:
        size = max(tile, 16 << low, 2 * shortest)
        high = top if size >= n else max((size // 16).bit_length() - 1, low)
        stride = size - (4 << high) - shortest
        for start in range(0, n, stride) if size < n else (0,):
            yield start, min(start + size, n), low, high
            if start + size >= n:
                break
        low = high + 1


def _keep(n: int, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Mask of the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) == 0


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _run_lists(owner: np.ndarray, rows: int, start, length, period) -> pa.Array:
    """One list of runs for each row; ``owner`` is ascending."""
    kind = to_arrow_schema(T.StructType([T.StructField("r", _RUN)]))[0].type
    values = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (start, length, period)], fields=list(kind))
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _number(words: list[bytes], known: defaultdict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _solved(texts: list[bytes], shortest: int):
    """(words of each text, runs of each, collapsed texts), all texts as one array with a
    number of its own between two texts."""
    known = defaultdict(count().__next__)
    split = [text.split() for text in texts]
    parts, at = [], 0
    starts = np.zeros(len(texts), np.int64)
    for i, words in enumerate(split):
        starts[i] = at
        parts += [_number(words, known), np.array([-1 - i])]
        at += len(words) + 1
    numbers = np.concatenate(parts)
    longest = max(map(len, split))
    high = (longest // 2).bit_length() - 1 if longest > 1 else -1
    start, stop, period = stretches(numbers, 0, high, shortest)
    owner = np.searchsorted(starts, start, side="right") - 1
    order = np.lexsort((period, start))
    start, stop, period, owner = start[order], stop[order], period[order], owner[order]
    keep = _keep(len(numbers), start, stop, period)
    touched = set(owner.tolist())
    made = [
        b" ".join(compress(words, keep[a:a + len(words)].tolist()) if i in touched else words)
        for i, (words, a) in enumerate(zip(split, starts.tolist()))
    ]
    return [len(w) for w in split], _run_lists(owner, len(texts), start - starts[owner], stop - start, period), made


def _short(given: DataFrame, result: T.StructType, shortest: int) -> DataFrame:
    arrow = to_arrow_schema(result)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, TOGETHER):
                sizes, runs, made = _solved(part.column("text").to_pylist(), shortest)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), runs.cast(arrow[2].type), pa.array(made, pa.binary())],
                    schema=arrow,
                )

    return given.mapInArrow(run, result)


def _exploded(given: DataFrame, tile: int, shortest: int) -> DataFrame:
    """``doc_id, text_hash, start, low, high, words``: the tiles of each document, its
    words as little-endian int32 numbers of the document's own vocabulary."""
    fields = [given.schema["doc_id"], T.StructField("text_hash", T.LongType())]
    schema = T.StructType([
        *fields, T.StructField("start", T.LongType()), T.StructField("low", T.IntegerType()),
        T.StructField("high", T.IntegerType()), T.StructField("words", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                known = defaultdict(count().__next__)
                numbers = _number(batch.column("text")[i].as_py().split(), known).astype("<i4")
                for start, stop, low, high in tiles(len(numbers), tile, shortest):
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(i, 1), batch.column("text_hash").slice(i, 1),
                        pa.array([start], pa.int64()), pa.array([low], pa.int32()), pa.array([high], pa.int32()),
                        pa.array([numbers[start:stop].tobytes()]),
                    ], schema=arrow)

    return given.mapInArrow(run, schema)


def _fragments(tiled: DataFrame, shortest: int) -> DataFrame:
    """``doc_id, text_hash, period, start, stop`` of every stretch of every tile."""
    schema = T.StructType([
        tiled.schema["doc_id"], tiled.schema["text_hash"],
        *[T.StructField(c, T.LongType()) for c in ("period", "start", "stop")],
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["start", "low", "high", "words"]).to_pylist()):
                numbers = np.frombuffer(row["words"], "<i4")
                start, stop, period = stretches(numbers, row["low"], row["high"], shortest)
                if len(start):
                    at = pa.array(np.full(len(start), i))
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                        pa.array(period), pa.array(start + row["start"]), pa.array(stop + row["start"]),
                    ], schema=arrow)

    return tiled.mapInArrow(run, schema)


def _stitched(fragments: DataFrame) -> DataFrame:
    """``doc_id, text_hash, runs``: overlapping fragments of a period joined, the least
    period of each stretch, and the runs of a document by start and period."""
    key = ["doc_id", "text_hash"]
    ahead = Window.partitionBy(*key, "period").orderBy("start", "stop")
    before = F.max("stop").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > before - F.col("period")).cast("int"), F.lit(1))
    joined = (
        fragments.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(ahead))
        .groupBy(*key, "period", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    least = joined.groupBy(*key, "start", "stop").agg(F.min("period").alias("period"))
    one = F.struct("start", "period", (F.col("stop") - F.col("start")).alias("length"))
    return least.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("_runs")).select(
        *key, F.transform("_runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs")
    )


def _collapsed(joined: DataFrame, result: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(result)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("text")[i].as_py().split()
                runs = batch.column("runs").slice(i, 1)
                flat = runs.flatten()
                start, length, period = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "period"))
                keep = _keep(len(words), start, start + length, period)
                made = b" ".join(compress(words, keep.tolist()))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, 1), pa.array([len(words)], pa.int64()), runs.cast(arrow[2].type),
                    pa.array([made], pa.binary()),
                ], schema=arrow)

    return joined.select("doc_id", "text", "runs").mapInArrow(run, result)


def periodic_runs(
    docs: DataFrame, shortest: int = SHORTEST, long_bytes: int = LONG_BYTES, tile_words: int = TILE_WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    Words are what white space of ASCII separates, numbered from 0. ``runs`` is an array
    of (start, length, period) by start, then period. ``collapsed`` is the text without
    the words that a run holds after its first period, joined by a space.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Rows
    are independent: repeated rows and ids stay, null ids stay, an empty table gives no
    rows, other columns are left behind. A text longer than ``long_bytes`` is spread
    over tasks; its own words must fit in one, at about 8 bytes a word for each octave
    of the text's longest possible period.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")
    given = id_and_text(docs, id_col, text_col)
    result = T.StructType([
        given.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("collapsed", T.BinaryType()),
    ])
    large = F.length("text") > long_bytes
    short = _short(given.where(~large), result, shortest)
    long = given.where(large).withColumn("text_hash", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _exploded(long, tile_words, shortest).repartition(parts, "doc_id", "text_hash", "start", "low")
    runs = _stitched(_fragments(dealt, shortest)).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    none = F.array().cast(T.ArrayType(_RUN))
    joined = long.join(
        runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left"
    ).withColumn("runs", F.coalesce("runs", none))
    made = short.unionByName(_collapsed(joined, result))
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` where a tenth of the ids, chosen by their checksum, get a text
    that repeats a stretch of its own words up to its end (the digest's test texts)."""
    key, text = F.col("`" + id_col + "`"), F.coalesce(F.col("`" + text_col + "`"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(s: Column) -> Column:
        n, g = F.size(s["w"]).cast("bigint"), s["g"]
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        made = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(s["w"], place(i)))
        return F.when(n > 0, F.array_join(made, " ")).otherwise("")

    h = F.crc32(key.cast("string").cast("binary"))
    state = F.array(F.struct(words.alias("w"), F.floor(h / 10).cast("bigint").alias("g")))
    return docs.select(
        key.alias("doc_id"), F.when(h % 10 == 0, F.get(F.transform(state, repeated), F.lit(0))).otherwise(text).alias("text")
    )


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run and digests of all runs and of the rest."""
    order = F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period")
    ))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    length = -F.col("_best.rank")
    return found.withColumn("_best", F.array_min(order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        length.alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
