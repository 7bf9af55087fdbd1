"""Operator 3: nearest neighbours by randomly rotated one-bit codes.

A vector of unit length is rotated by a random orthogonal matrix and kept as the
signs of its components, packed in bits, with one correction scalar: the inner
product of the vector and its code. The code's inner product with a rotated query,
divided by that scalar, estimates the cosine without bias, and the scalar also gives
the estimate's error bound. A vector is measured exactly only where estimate plus
bound reaches the query's current k-th best cosine.

What a query's k-th best cosine is at least, a look at a bounded sample of the index
tells before the search; it leaves out no row that belongs in a list.

Queries are a stated set. They pass to the tasks in blocks of bounded size, and each
task streams its part of the index past a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelflight.llm.common import column
from shelflight.sources.sinks import freeze

# Width of the error bound, in standard deviations of the estimate's error.
BOUND = 3.0
# Queries in one broadcast block, and rows and queries measured at once.
QUERY_BLOCK = 1 << 14
TILE_ROWS, TILE_QUERIES = 2048, 1024
FIRST_ROWS = 128
PAIRS = 1 << 16
# Rows of the index that give each query's first bound.
SAMPLE_ROWS = 4096

CODED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("code", T.BinaryType()),
    T.StructField("fit", T.FloatType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
])
FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    made, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return made * np.sign(np.diag(upper))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part: with an id, not
    null, not zero, all components finite, and of the most frequent width (the larger
    if tied)."""
    rows = vectors.select(
        column(id_col).cast("long").alias("vec_id"),
        column(vector_col).cast("array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    width = rows.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    common = width.orderBy(F.desc("n"), F.desc("w")).first()
    return rows.where(F.size("embedding") == (common["w"] if common else 0))


def _matrix(array) -> np.ndarray:
    """Rows scaled by powers of two, so that no square over- or underflows; a cosine
    is the same to the last bit."""
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.reshape(len(array), -1)) if len(array) else np.zeros((0, 1))


def _scaled(rows: np.ndarray) -> np.ndarray:
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def index(vectors: DataFrame, seed: int = 3) -> DataFrame:
    """``vec_id, code, fit, embedding`` of usable vectors, a row each."""

    def run(batches: Iterator[pa.RecordBatch]):
        turn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("embedding"))
            if turn is None:
                turn = rotation(rows.shape[1], seed)
            rotated = _unit(rows) @ turn
            codes = np.packbits(rotated > 0, axis=1)
            fit = np.abs(rotated).sum(axis=1) / np.sqrt(rows.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(fit.astype(np.float32)), batch.column("embedding")],
                names=CODED.names,
            )

    return vectors.mapInArrow(run, CODED)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in the components' order."""
    return np.cumsum(a * b, axis=1)[:, -1]


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, k: int, bound: np.ndarray):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.vec = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.bound = bound.copy()

    def add(self, query, vec, score) -> None:
        query = np.concatenate([self.query, query])
        vec = np.concatenate([self.vec, vec])
        score = np.concatenate([self.score, score])
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        opens = np.ones(len(query), bool)
        opens[1:] = query[1:] != query[:-1]
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(opens, np.arange(len(query)), 0))
        keep = rank < self.k
        full = rank == self.k - 1
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        self.bound[query[full]] = np.maximum(self.bound[query[full]], score[full])


def _search(batches, ids: np.ndarray, vectors: np.ndarray, first: np.ndarray, k: int, seed: int, bound: float):
    width = vectors.shape[1]
    rotated = (_unit(vectors) @ rotation(width, seed) / np.sqrt(width)).astype(np.float32)
    best = _Best(k, first)
    query_squares = inner(vectors, vectors)
    tile_rows = FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            tile = batch.slice(at, tile_rows)
            at, tile_rows = at + tile_rows, TILE_ROWS
            own = tile.column("vec_id").to_numpy()
            rows = _matrix(tile.column("embedding"))
            packed = np.frombuffer(b"".join(tile.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            squares = inner(rows, rows)
            signs = np.unpackbits(packed, axis=1, count=width).astype(np.float32) * 2 - 1
            fit = tile.column("fit").to_numpy()
            reach = bound * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(max(width - 1, 1)) + 1e-5
            for lo in range(0, len(ids), TILE_QUERIES):
                hi = min(lo + TILE_QUERIES, len(ids))
                upper = signs @ rotated[lo:hi].T / fit[:, None] + reach[:, None]
                row, query = np.nonzero((upper >= best.bound[lo:hi]) & (own[:, None] != ids[lo:hi]))
                for p in range(0, len(row), PAIRS):
                    r, q = row[p:p + PAIRS], query[p:p + PAIRS] + lo
                    score = inner(rows[r], vectors[q]) / np.sqrt(squares[r] * query_squares[q])
                    near = score >= best.bound[q]
                    best.add(q[near], own[r[near]], score[near])
    return ids[best.query], best.vec, best.score


def _query_blocks(queries: DataFrame, size: int):
    ids, rows = [], []
    for row in queries.toLocalIterator():
        ids.append(row["vec_id"])
        rows.append(row["embedding"])
        if len(ids) == size:
            yield np.array(ids), _scaled(np.array(rows))
            ids, rows = [], []
    if ids:
        yield np.array(ids), _scaled(np.array(rows))


def _bounds(found: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the smallest of its k scores; none if it has fewer."""
    rows = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    least = {r["query_id"]: r["least"] for r in rows.where(F.col("n") == k).collect()}
    return np.array([least.get(i, -np.inf) for i in ids.tolist()])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 3, bound: float = BOUND,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each query by cosine.

    Both tables have ``vec_id, embedding`` as ``usable`` gives them. A row with the
    query's own id is no candidate. Nearest first, ties to the smaller ``vec_id``;
    rows that repeat an id are candidates each, queries that do share one list; fewer
    candidates give fewer rows, and empty tables none. Scores are exact; a neighbour
    is missed only where its estimate's error exceeds ``bound`` standard deviations.
    """
    spark = vectors.sparkSession
    coded = freeze(index(vectors, seed), "vector-codes")
    parts = []
    for ids, rows in _query_blocks(queries.select("vec_id", "embedding").distinct(), query_block):
        least = np.full(len(ids), -np.inf)
        for of in (coded.limit(SAMPLE_ROWS), coded):
            sent = spark.sparkContext.broadcast((ids, rows, least))

            def run(batches, sent=sent):
                query, vec, score = _search(batches, *sent.value, k, seed, bound)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], names=FOUND.names)

            found = of.mapInArrow(run, FOUND)
            if of is coded:
                parts.append(freeze(found, "neighbours"))
            else:
                least = _bounds(found, ids, k)
            sent.unpersist()
    if not parts:
        parts = [spark.createDataFrame([], FOUND)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
