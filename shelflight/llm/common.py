"""What the operators share: document columns, Arrow tasks, word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Unicode white space (property White_Space), as the tokenizers' patterns read \s (fixed value).
WHITE = "".join(map(chr, [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# A text is taken apart in pieces of about this many bytes or characters, so that
# the memory a task needs does not follow the longest text.
PIECE = 1 << 20


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and the text's UTF-8 bytes; a null text is empty.

    Other columns are left behind, whatever their names.
    """
    text = F.coalesce(column(text_col), F.lit("")).cast("binary")
    return docs.select(column(id_col).alias("doc_id"), text.alias("text"))


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def giving_back(run: Callable) -> Callable:
    """A task's function that returns freed memory to the system when the task has ended:
    a worker process serves many tasks, and what one of them freed helps no other process."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def map_arrow(df: DataFrame, schema: T.StructType | str, start: Callable) -> DataFrame:
    """Arrow batches through a task's function.

    ``start()`` runs once in each task and returns a function from a batch to a
    list of columns (arrays or Python lists) in the order of ``schema``.
    """
    schema = schema_of(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            columns = [
                made if isinstance(made, pa.Array) else pa.array(made, type=field.type)
                for made, field in zip(step(batch), arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def blocks(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Slices of about ``size`` bytes that end before a space, so no word is cut."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def text_slices(batch: pa.RecordBatch, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of its binary column ``name``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def list_array(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array for each row."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bytes that are not part of a word become spaces and A-Z lower case (fixed values).
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, in
    lower case as far as A-Z go."""
    return text.translate(WORD_BYTES).split()


def word_numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers of a vocabulary; 0 for any other word."""
    parts = [np.zeros(0, np.int32)]
    for piece in blocks(text.translate(WORD_BYTES)):
        split = piece.split()
        parts.append(np.fromiter(map(vocabulary.get, split, repeat(0)), np.int32, len(split)))
    return np.concatenate(parts)


def known_runs(numbers: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, word places) of the runs of at least ``shortest`` known words, each
    closed by a 0."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], numbers > 0, [False]))))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= shortest
    starts, stops = starts[long], stops[long]
    sizes = stops - starts + 1
    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index += np.repeat(starts, sizes)
    run = np.append(numbers, 0)[index]
    run[np.cumsum(sizes) - 1] = 0
    return run, index
