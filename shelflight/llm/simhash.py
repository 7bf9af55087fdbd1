"""Operator 1: near-duplicate documents by SimHash fingerprints and BK-trees.

1. Each text's fingerprint is computed where the row is.
2. Distinct fingerprints (exact copies have become one) are dealt to shards. The
   64 bits are cut in ``radius + agree`` blocks: two fingerprints within
   ``radius`` bits agree in ``agree`` whole blocks at least, so they meet in the
   shard of one of those block choices. ``agree`` only sets how fine the shards
   are, never which links exist; it follows the number of fingerprints.
3. Each shard key has a BK-tree, asked by the shard's own fingerprints. Trees do
   not pass through the driver: together they hold every fingerprint, so they are
   built where their shard is and the questions go to them. A key with more than
   ``shard_rows`` fingerprints is cut in chunks, and each pair of chunks is a
   shard of its own (the tree is sent to every chunk that must ask it).
4. A shard yields a spanning forest of its links, never pairs; alternating star
   contractions turn the forests into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm.bktree import spanning_links
from shelflight.llm.common import PIECE, blocks, column, id_and_text, map_arrow
from shelflight.sources.sinks import freeze

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
# Mean fingerprints per shard key that the choice of ``agree`` aims at.
KEY_ROWS = 256
# A key with more fingerprints than this is cut in chunks.
SHARD_ROWS = 1 << 15

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = (np.arange(8) * 256)[None, :]
# White space between words other than the space itself (fixed value).
_BREAKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    lanes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _LANE
    seen = np.bincount(lanes.ravel(), minlength=8 * 256).reshape(8, 256)
    return (seen @ _BYTE_BITS).ravel()


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> Iterator[list[int]]:
    """XXH64 values of the shingles of ``width`` words, in lists.

    Words are what white space of ASCII separates, after lower-casing A-Z. Fewer
    words than ``width`` form one shingle; no words give none.
    """
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    some, tail = False, []
    text = text.lower()
    if len(text) > PIECE:
        text = text.translate(_BREAKS)
    for block in blocks(text):
        words = tail + block.split()
        last = len(words) - width + 1
        if last > 0:
            yield [hashed(join(words[i:i + width]), seed) for i in range(last)]
            some = True
        tail = words[max(last, 0):]
    if not some and tail:
        yield [hashed(join(tail), seed)]


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values.

    Text without words gives 0.
    """
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        counts += _bit_counts(hashes)
        total += len(hashes)
    bits = np.flatnonzero(2 * counts > total)
    return int(sum(1 << int(b) for b in bits))


def fingerprints(
    docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a signed bigint) of every row."""
    given = id_and_text(docs, id_col, text_col)
    schema = T.StructType([given.schema["doc_id"], T.StructField("fingerprint", T.LongType())])

    def start():
        def step(batch):
            made = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            return [batch.column("doc_id"), pa.array(np.array(made, np.uint64).view(np.int64))]

        return step

    return map_arrow(given, schema, start)


def blocks_to_agree(n: int, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> int:
    """The fewest agreeing blocks whose bits leave ``key_rows`` or fewer of ``n`` per key."""
    agree = 1
    while agree < 6 and n > key_rows * 2.0 ** (BITS * agree / (radius + agree)):
        agree += 1
    return agree


def block_masks(radius: int, agree: int) -> list[int]:
    """One mask for each choice of ``agree`` of the ``radius + agree`` bit blocks."""
    count = radius + agree
    edges = [BITS * i // count for i in range(count + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, agree)]
    assert len(masks) == comb(count, agree)
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shard_keys(codes: DataFrame, radius: int, agree: int) -> DataFrame:
    """One row for each block choice: ``key`` (the agreeing bits, hashed) and ``code``."""
    keys = [
        F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(_signed(mask))))
        for i, mask in enumerate(block_masks(radius, agree))
    ]
    return codes.select(F.explode(F.array(*keys)).alias("key"), "code")


def _cut_large(keyed: DataFrame, shard_rows: int) -> DataFrame:
    """``key, a, b, code``: keys over ``shard_rows`` become pairs (a, b) of chunks."""
    plain = [F.lit(0).alias("a"), F.lit(0).alias("b")]
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard_rows)
    large = freeze(
        sizes.select("key", F.ceil(F.col("_n") / F.lit(shard_rows)).cast("int").alias("_chunks")),
        "large-keys",
    )
    if not large.limit(1).count():
        return keyed.select("key", *plain, "code")
    joined = keyed.join(large, "key", "left")
    mine = F.pmod(F.xxhash64("code"), F.col("_chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: c != mine)
    split = joined.where(F.col("_chunks") > 1).select(
        "key", "code", mine.alias("_mine"), F.explode(others).alias("_other")
    ).select("key", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b"), "code")
    return joined.where("_chunks is null").select("key", *plain, "code").unionByName(split)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, codes) of whole shards, from rows sorted by shard."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table):
        names = [table[c].to_numpy() for c in ("key", "a", "b")]
        changed = np.zeros(table.num_rows, bool)
        for values in names:
            changed[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(changed)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held)
        changes = cut(whole)
        if len(changes):
            last = int(changes[-1])
            yield np.append(0, changes[:-1]), whole["code"].to_numpy()[:last]
            held = whole.slice(last).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield np.append(0, cut(whole)), whole["code"].to_numpy()


LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def links(codes: DataFrame, n: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``u, v``: links between distinct fingerprints that join the same ones as all
    pairs within ``radius`` bits do. ``codes`` has ``n`` distinct values."""
    keyed = _cut_large(_shard_keys(codes, radius, blocks_to_agree(n, radius)), shard_rows)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    arrow = to_arrow_schema(LINK)

    def run(batches):
        for starts, codes in _groups(batches):
            codes = codes.view(np.uint64)
            made = [
                spanning_links(part, radius) for part in np.split(codes, starts[1:]) if len(part) > 1
            ]
            made = [pair for pair in made if len(pair[0])]
            if made:
                u, v = (np.concatenate(side).view(np.int64) for side in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=arrow)

    return dealt.mapInArrow(run, LINK).distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star contraction of edges (u > v).

    Large: every larger neighbour of a node is linked to the smallest of the node
    and its neighbours. Small: the node and its smaller neighbours are.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return made.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of an edge its component's smallest node.

    Each round is written to the shared folder, so lineage stays short. Rounds
    grow with the logarithm of the longest chain.
    """
    edges = freeze(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(),
        "edges",
    )

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())

    before = state(edges)
    while before[0]:
        edges = freeze(_stars(_stars(edges, large=True), large=False), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the smallest ``doc_id`` that links reach. Null, empty and
    blank texts have fingerprint 0 and are linked like any other. A null
    ``doc_id`` keeps its row and never is a component's id unless all its ids are
    null. Repeated rows stay. An empty table gives no rows.
    """
    marked = freeze(fingerprints(docs, width, id_col, text_col), "fingerprints")
    rooted = _rooted(marked, radius, shard_rows)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_code = rooted.join(named, "root").select(F.col("code").alias("fingerprint"), "component_id")
    return marked.join(by_code, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def _rooted(marked: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``code, first_id, root``: each fingerprint, its smallest id, its component."""
    codes = freeze(
        marked.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("first_id")), "codes"
    )
    roots = components(links(codes.select("code"), codes.count(), radius, shard_rows))
    return freeze(with_roots(codes, roots), "roots")


def with_roots(codes: DataFrame, roots: DataFrame) -> DataFrame:
    """``code, first_id, root`` of ``code, first_id``; a code without links is its own root."""
    return codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root")
    )


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart and orders them: id (null last), hashes of text and row."""
    known = [column(id_col).isNull(), column(id_col), F.xxhash64(column(text_col)), F.xxhash64(*[
        F.to_json(F.struct(column(f.name))) if "map<" in f.dataType.simpleString() else column(f.name)
        for f in docs.schema
    ])]
    return F.struct(*[c.alias(n) for c, n in zip(known, ("nameless", "id", "text_hash", "row_hash"))])


def first_rows(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` with the smallest ``row_key`` of each component.

    A row travels as one struct, so no column of it meets a name of the join.
    """
    first = rooted.groupBy("root").agg(F.min("first_id").alias("kept")).select("kept")
    packed = docs.select(F.struct("*").alias("row"), row_key(docs, id_col, text_col).alias("key"))
    staying = packed.join(
        first,
        F.col("key.id").eqNullSafe(F.col("kept.id")) & (F.col("key.text_hash") == F.col("kept.text_hash"))
        & (F.col("key.row_hash") == F.col("kept.row_hash")),
        "left_semi",
    )
    return staying.dropDuplicates(["key"]).select("row.*")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    width: int = SHINGLE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id, null ids last;
    of several such rows the one with the smallest hash of its text, then of the row.

    All columns are kept, whatever their names. Rows of one id whose texts are not linked
    are of different components, and so are rows with null ids. Null, empty and blank
    texts have fingerprint 0 and are linked like any other; repeated rows are one. Texts
    of any length are read whole, in pieces. An empty table gives no rows.
    """
    given = docs.select(row_key(docs, id_col, text_col).alias("doc_id"), column(text_col).alias("text"))
    marked = freeze(fingerprints(given, width), "fingerprints")
    return first_rows(docs, _rooted(marked, radius, shard_rows), id_col, text_col)


def hex_digits(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")
