"""Operator 7: token ids in files compressed by Re-Pair grammars.

Texts are encoded by the tokenizers library, sorted by id over the whole table and
written in shards of about ``SHARD_TOKENS`` ids. In a shard, the most frequent pairs
of neighbouring symbols become nonterminals, again and again: all frequent pairs of
a round at once, each from the left, never across the end of a document.

The file format is a Parquet table with one row for each shard (Spark's writer
commits whole files, so lost executors leave no half-written shard):

=============  ===============================================================
part, block    place of the shard in the global order
start          ids before it in its part
doc_ids        its documents, in order
doc_symbols    symbols up to each document's end
doc_tokens     ids of each document, the end id included
terminals      symbols below this number are ids; number ``terminals + i`` is rule i
rules          little-endian uint32 pairs (left, right), each of earlier symbols
lengths        little-endian uint32, ids that each rule stands for
width          bytes of a symbol, 2 or 4
symbols        little-endian symbols
=============  ===============================================================

The lengths give the place of any id without decoding what lies before it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm.common import WHITE, id_and_text, list_array

END_ID = 0
# Ids of a shard; a longer document is a shard by itself.
SHARD_TOKENS = 1 << 20
# A pair must occur this often in a shard to become a rule.
LEAST_COUNT = 24
ROUNDS = 5
# Rules of one round; rounds let later pairs hold earlier nonterminals.
ROUND_RULES = 4096
# Bits of a pair's hash in the first count; the counts then stay in a core's cache.
HASH_BITS = 17
# Bytes of cached encodings in a worker.
CACHE_BYTES = 256 << 20
# New units given to the library as one text.
STRUNG = 512
# Characters of text that are split at once.
TOGETHER = 1 << 19

# A unit ends before white space that follows something else; the pre-tokenizer
# always splits there and merges stay within its parts.
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Encoder:
    """The library's ids of whole texts, encoding each distinct unit once.

    New units are given to the library strung together, as they stand in a text:
    each begins with white space after something else. The ids are told apart by the
    bytes that each id stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.terminals = max(vocabulary.values(), default=-1) + 1
        # a byte-level token's text has one character for each byte
        self.bytes = np.zeros(self.terminals, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, units: list[str]) -> None:
        alone = [u for u in units if u[0] not in WHITE or u[-1] in WHITE]
        for unit, made in zip(alone, self._library(alone)):
            self.known[unit] = made.tobytes()
        strung = list(set(units).difference(alone))
        groups = [strung[i:i + STRUNG] for i in range(0, len(strung), STRUNG)]
        for group, ids in zip(groups, self._library(["".join(g) for g in groups])):
            ends = np.cumsum(self.bytes[ids])
            sizes = np.fromiter((len(u.encode()) for u in group), np.int64, len(group))
            cuts = (4 * (np.searchsorted(ends, np.cumsum(sizes)) + 1)).tolist()
            data = ids.tobytes()
            self.known.update(zip(group, (data[a:b] for a, b in zip([0, *cuts], cuts))))
        self.held += sum(map(len, units)) * 5 + 160 * len(units)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.frombuffer(array("I", e.ids), np.uint32).astype("<u4", copy=False) for e in made]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        split = [_UNIT.findall(text) for text in texts]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _spread(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def compress(symbols: np.ndarray, last: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules) after Re-Pair; ``last`` marks each document's last symbol."""
    symbols, rules, number = symbols.astype(np.uint32), [], terminals
    room = (1 << 16) - terminals if terminals < 1 << 16 else 1 << 20
    for _ in range(ROUNDS):
        quota = min(ROUND_RULES, room - (number - terminals))
        if quota <= 0 or len(symbols) < 2:
            break
        inner = np.flatnonzero(~last[:-1])
        key = (symbols[inner].astype(np.uint64) << np.uint64(32)) | symbols[inner + 1]
        # count hashed pairs first, so that only the frequent ones are sorted
        bucket = _spread(key)
        seen = np.bincount(bucket, minlength=1 << HASH_BITS)
        least = max(LEAST_COUNT, int(np.partition(seen, -quota)[-quota]))
        often = np.flatnonzero(seen[bucket] >= least)
        pairs, counts = np.unique(key[often], return_counts=True)
        enough = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(enough):
            break
        top = enough[np.lexsort((pairs[enough], -counts[enough]))[:quota]]
        chosen = np.sort(pairs[top])
        at = np.minimum(np.searchsorted(chosen, key[often]), len(chosen) - 1)
        hit = chosen[at] == key[often]
        place, rule = inner[often[hit]], at[hit]
        # in a run of overlapping places every second one stays, from the left
        opens = np.ones(len(place), bool)
        opens[1:] = place[1:] != place[:-1] + 1
        first = np.maximum.accumulate(np.where(opens, np.arange(len(place)), 0))
        even = (np.arange(len(place)) - first) % 2 == 0
        place, rule = place[even], rule[even]
        symbols[place] = number + rule
        last[place] = last[place + 1]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, last = symbols[keep], last[keep]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        number += len(chosen)
    return symbols, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule stands for."""
    length = np.ones(terminals + len(rules), np.int64)
    for i, (left, right) in enumerate(rules.tolist()):
        length[terminals + i] = length[left] + length[right]
    return length[terminals:]


class Grammar:
    """Expands symbols of one shard."""

    def __init__(self, terminals: int, rules: np.ndarray, lengths: np.ndarray):
        self.length = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
        self.start = np.concatenate([np.arange(terminals), terminals + np.cumsum(lengths) - lengths]).astype(np.int64)
        flat = np.zeros(terminals + int(lengths.sum()), np.uint32)
        flat[:terminals] = np.arange(terminals)
        start, size = self.start.tolist(), self.length.tolist()
        for i, (left, right) in enumerate(rules.tolist()):
            at = start[terminals + i]
            middle = at + size[left]
            flat[at:middle] = flat[start[left]:start[left] + size[left]]
            flat[middle:middle + size[right]] = flat[start[right]:start[right] + size[right]]
        self.flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.length[symbols]
        shift = np.repeat(self.start[symbols] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))]

    def between(self, symbols: np.ndarray, low: int, high: int) -> np.ndarray:
        """Ids ``low`` to ``high`` of a symbol sequence; only the symbols that hold
        them are expanded."""
        ends = np.cumsum(self.length[symbols])
        first, stop = np.searchsorted(ends, [low, high - 1], side="right")
        part = symbols[first:stop + 1]
        before = int(ends[first - 1]) if first else 0
        return self.expand(part)[low - before:high - before]


def _fields(id_type: T.DataType) -> T.StructType:
    long, binary = T.LongType(), T.BinaryType()
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("start", long), T.StructField("n_tokens", long),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_symbols", T.ArrayType(long)),
        T.StructField("doc_tokens", T.ArrayType(long)), T.StructField("terminals", T.IntegerType()),
        T.StructField("rules", binary), T.StructField("lengths", binary),
        T.StructField("width", T.IntegerType()), T.StructField("symbols", binary),
    ])


def _shard_row(ids: list[bytes], names: pa.Array, terminals: int, part: int, block: int, start: int) -> list:
    tokens = np.array([len(x) // 4 for x in ids], np.int64)
    symbols = np.frombuffer(b"".join(ids), "<u4")
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(tokens) - 1] = True
    symbols, last, rules = compress(symbols, last, terminals)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    return [
        [part], [block], [start], [int(tokens.sum())],
        pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
        list_array([np.flatnonzero(last) + 1], pa.int64()), list_array([tokens], pa.int64()),
        [terminals], [rules.astype("<u4").tobytes()],
        [rule_lengths(rules, terminals).astype("<u4").tobytes()], [width],
        [symbols.astype(f"<u{width}").tobytes()],
    ]


def _encoded(library: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """The ids of a batch's texts, about TOGETHER characters at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py().decode("utf-8", "replace"))
        size += len(held[-1])
        if size >= TOGETHER:
            yield from library.encode(held)
            held, size = [], 0
    yield from library.encode(held)


def write_shards(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write the shards at ``path``.

    Documents are in ascending ``doc_id`` order (null first; rows that repeat an id
    by their text's hash). A null or empty text is the end id alone. An empty table
    writes no shard. Other columns are left behind. ``tokenizer_file`` is a path that
    every worker can open.
    """
    given = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = _fields(given.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        library, part = encoder(tokenizer_file), TaskContext.get().partitionId()
        ids, names, size, start, block = [], [], 0, 0, 0

        def shard():
            columns = _shard_row(ids, pa.concat_arrays(names), library.terminals, part, block, start)
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            taken = 0
            for i, made in enumerate(_encoded(library, batch.column("text"))):
                ids.append(made + end)
                size += len(made) // 4 + 1
                if size >= shard_tokens:
                    names.append(batch.column("doc_id").slice(taken, i + 1 - taken))
                    yield shard()
                    start, block, taken = start + size, block + 1, i + 1
                    ids, names, size = [], [], 0
            names.append(batch.column("doc_id").slice(taken))
        if ids:
            yield shard()

    ordered.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first``, the ids of all documents before each: a running sum
    over the parts, of which there are as many as write tasks."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return shards.join(F.broadcast(shifts), "part").withColumn("first", F.col("start") + F.col("_before")).drop("_before")


def decoded_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian uint32 bytes) of every document."""
    named = shards.select(
        "first", "doc_ids", "doc_tokens", "terminals", "rules", "lengths", "width", "symbols"
    )
    id_type = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                tokens = row["doc_tokens"].values.to_numpy()
                ends = np.cumsum(tokens)
                ids = read_grammar(row).expand(read_symbols(row)).astype("<u4")
                made = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), tokens.tolist())]
                start = row["first"].as_py() + ends - tokens
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values.cast(arrow[0].type), pa.array(start), pa.array(tokens), pa.array(made, arrow[3].type)],
                    schema=arrow,
                )

    return named.mapInArrow(run, schema)


def read_grammar(row) -> Grammar:
    rules = np.frombuffer(row["rules"].as_py(), "<u4").reshape(-1, 2)
    return Grammar(row["terminals"].as_py(), rules, np.frombuffer(row["lengths"].as_py(), "<u4").astype(np.int64))


def read_symbols(row) -> np.ndarray:
    return np.frombuffer(row["symbols"].as_py(), f"<u{row['width'].as_py()}").astype(np.int64)


def digest(documents: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
