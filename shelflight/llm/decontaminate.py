"""Operator 2: benchmark decontamination by suffix arrays of the training texts.

Every Arrow batch of documents is a shard. Its words become numbers of the test
vocabulary (0 for any other word), runs of known words too short to match are left
out, and the rest is one sequence with a suffix array. Every test suffix is
binary-searched in it; the interval found holds all places where its window
occurs, and each place is followed to the end of the verbatim match.

The tests go to the tasks in blocks of bounded size, whatever the benchmark's size:
each task reads one block after the other and keeps the matches per document. No
document is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelflight.llm.common import column, id_and_text, known_runs, map_arrow, word_numbers, words

WINDOW = 10
# Bytes of test texts in one broadcast block.
BLOCK_BYTES = 16 << 20
# (suffix, place) pairs handled at once.
PAIRS = 1 << 20

MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
])


@dataclass
class Tests:
    """A block of test items as word numbers; ``starts`` delimits the items."""

    window: int
    names: list[str] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    numbers: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=lambda: [0])

    def add(self, name: str, text: bytes) -> None:
        found = words(text)
        if found:
            number = self.vocabulary
            self.names.append(name)
            self.numbers += [number.setdefault(w, len(number) + 1) for w in found]
            self.starts.append(len(self.numbers))


class Suffixes:
    """The suffixes of a block's items that begin a window, as arrays."""

    def __init__(self, tests: Tests):
        self.names = tests.names
        self.vocabulary = tests.vocabulary
        starts = np.array(tests.starts)
        lengths = np.diff(starts)
        need = np.minimum(lengths, tests.window)
        counts = lengths - need + 1
        self.item = np.repeat(np.arange(len(lengths)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.offset = within
        self.at = starts[self.item] + within
        self.stop = starts[self.item + 1]
        self.need = need[self.item]
        self.depth = int(lengths.max(initial=1))
        self.shortest = int(need.min(initial=tests.window))
        # room to look past the end: 0 equals no test word
        self.numbers = np.array(tests.numbers + [0] * tests.window, np.int32)
        width = int(need.max(initial=1))
        self.patterns = self.numbers[np.minimum(
            self.at[:, None] + np.arange(width)[None, :], len(self.numbers) - 1
        )]


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` numbers or more,
    by prefix doubling."""
    n = len(sequence)
    if not n:
        return np.zeros(0, np.int64)
    rank = sequence.astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        after = np.zeros(n, np.int64)
        after[:max(n - known, 0)] = rank[known:] + 1
        key = rank * (int(max(rank.max(), after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        steps = np.zeros(n, np.int64)
        steps[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        if rank[order[-1]] == n - 1:
            break
        known *= 2
    return order


def _below(sequence, order, patterns, need, upper: bool) -> np.ndarray:
    """For each pattern (its first ``need`` numbers) the number of suffixes that are
    smaller, or with ``upper`` not larger: one binary search for all patterns."""
    low = np.zeros(len(patterns), np.int64)
    high = np.full(len(patterns), len(order))
    columns = np.arange(patterns.shape[1])
    inside = columns[None, :] < need[:, None]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        seen = sequence[order[middle][:, None] + columns[None, :]]
        differs = (seen != patterns[open_]) & inside[open_]
        first = differs.argmax(axis=1)
        rows = np.arange(len(open_))
        equal = ~differs[rows, first]
        smaller = seen[rows, first] < patterns[open_][rows, first]
        right = np.where(equal, upper, smaller)
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def find_matches(documents: list[bytes], tests: list[Suffixes]) -> tuple[list[int], list[list[tuple]]]:
    """Word counts, and per document its maximal verbatim matches of a window or
    more: (item name, item word, document word, words), sorted."""
    counts: list[int] = [0] * len(documents)
    found: list[list[tuple]] = [[] for _ in documents]
    for number, block in enumerate(tests):
        runs, places, owners = [], [], []
        for d, text in enumerate(documents):
            ids = word_numbers(text, block.vocabulary)
            if not number:
                counts[d] = len(ids)
            run, index = known_runs(ids, block.shortest)
            if len(run):
                runs.append(run)
                places.append(index)
                owners.append(np.full(len(run), d))
        if runs:
            _match_block(block, np.concatenate(runs), np.concatenate(places), np.concatenate(owners), found)
    for rows in found:
        rows.sort(key=lambda m: (m[0] is None, m[0] or "", *m[1:]))
    return counts, found


def _match_block(block: Suffixes, sequence, places, owners, found) -> None:
    order = suffix_array(sequence, block.depth)
    padded = np.append(sequence, np.zeros(block.patterns.shape[1], np.int32))
    low = _below(padded, order, block.patterns, block.need, upper=False)
    high = _below(padded, order, block.patterns, block.need, upper=True)
    hits = np.maximum(high - low, 0)
    ends = np.cumsum(hits)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
        suffix = np.searchsorted(ends, pair, side="right")
        at = order[low[suffix] + pair - (ends[suffix] - hits[suffix])]
        test = block.at[suffix]
        # a match that can be longer to the left is part of another one
        maximal = (block.offset[suffix] == 0) | (at == 0)
        maximal |= sequence[at - 1] != block.numbers[test - 1]
        suffix, at, test = suffix[maximal], at[maximal], test[maximal]
        length = block.need[suffix].copy()
        growing = np.arange(len(at))
        while len(growing):
            next_test = test[growing] + length[growing]
            same = next_test < block.stop[suffix[growing]]
            growing, next_test = growing[same], next_test[same]
            growing = growing[padded[at[growing] + length[growing]] == block.numbers[next_test]]
            length[growing] += 1
        for d, i, o, p, n in zip(
            owners[at].tolist(), block.item[suffix].tolist(), block.offset[suffix].tolist(),
            places[at].tolist(), length.tolist(),
        ):
            found[d].append((block.names[i], o, p, n))


def test_blocks(
    benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int
) -> list:
    """Broadcast variables with the items in blocks of about ``block_bytes``. Items
    without words are left out. The driver holds one block at a time."""
    sent, current, size = [], Tests(window), 0
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(
        column(item_col).cast("string").alias("item"),
        F.coalesce(column(text_col), F.lit("")).cast("binary").alias("text"),
    )
    for row in items.toLocalIterator():
        if size and size + len(row["text"]) > block_bytes:
            sent.append(context.broadcast(current))
            current, size = Tests(window), 0
        current.add(row["item"], bytes(row["text"]))
        size += len(row["text"])
    if current.names:
        sent.append(context.broadcast(current))
    return sent


def _prepared(sent: list) -> list[Suffixes]:
    return [Suffixes(block.value) for block in sent]


def verbatim_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, matches`` of every row of ``docs``.

    ``matches`` lists the maximal verbatim matches of at least ``window`` words, or
    of a whole shorter item: item_id (as text), item_start, start (0-based words)
    and n_words. Null and blank texts have no words; items without words match
    nothing; a null item id matches under a null name and items that repeat an id
    count as one item in the digest. Repeated rows and null ids stay. Without items
    all lists are empty.
    """
    sent = test_blocks(benchmark, window, item_col, item_text_col, block_bytes)
    given = id_and_text(docs, id_col, text_col)
    schema = T.StructType([
        given.schema["doc_id"], T.StructField("n_words", T.LongType()),
        T.StructField("matches", T.ArrayType(MATCH)),
    ])

    def start():
        tests = _prepared(sent)

        def step(batch):
            texts = [t.as_py() for t in batch.column("text")]
            counts, found = find_matches(texts, tests)
            if not tests:
                counts = [len(words(t)) for t in texts]
            rows = [
                [dict(zip(("item_id", "item_start", "start", "n_words"), m)) for m in ms] for ms in found
            ]
            return [batch.column("doc_id"), counts, rows]

        return step

    return map_arrow(given, schema, start)


def covered_words(matches: Column) -> Column:
    """Words inside any match, each counted once."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["start"].alias("a"), (m["start"] + m["n_words"]).alias("b")
    )))

    def add(state, span):
        reach = F.greatest(state["reach"], span["b"])
        return F.struct(
            reach.alias("reach"),
            (state["n"] + reach - F.greatest(state["reach"], span["a"])).alias("n"),
        )

    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))
    return F.aggregate(spans, start, add, lambda s: s["n"].cast("long"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    made = found.select("doc_id", "n_words", covered_words(F.col("matches")).alias("n_hit"), items.alias("items"))
    return made.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs.

    Null, empty and blank texts hold no window and stay, as do all rows if the benchmark
    is empty or has no words. Rows are judged one by one on their whole texts, repeated
    ones too; an empty table gives no rows.
    """
    sent = test_blocks(benchmark, window, item_col, item_text_col, block_bytes)
    at = docs.columns.index(text_col)

    def run(batches):
        tests = _prepared(sent)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            _, found = find_matches([t or b"" for t in texts], tests)
            yield batch.filter(pa.array([not ms for ms in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
