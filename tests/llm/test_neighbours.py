"""One-bit-code neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelflight.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted((-float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))), v) for v, y in vectors if v != q)
        out[q] = [(v, -s) for s, v in scored[:k]]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(found, expected):
    hits = sum(len({v for v, _ in found.get(q, [])} & {v for v, _ in near}) for q, near in expected.items())
    return hits / sum(map(len, expected.values()))


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_recall_and_scores_on_given_table(spark, block):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect()]
    vectors = neighbours.usable(table)
    found = lists(neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), query_block=block))
    expected = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert recall(found, expected) >= 0.99
    exact = {v: x for v, x in rows}
    for q, near in found.items():
        assert len(near) == 5 and [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for v, s in near:
            assert abs(s - np.dot(exact[q], exact[v]) / np.linalg.norm(exact[q]) / np.linalg.norm(exact[v])) < 1e-12


def test_bound_saves_measurements(monkeypatch):
    draw = np.random.default_rng(4)
    rows = draw.standard_normal((6000, 64))
    measured = []
    real = neighbours.inner
    monkeypatch.setattr(neighbours, "inner", lambda a, b: measured.append((a is not b) * len(a)) or real(a, b))
    turn = neighbours.rotation(64, 3)
    rotated = neighbours._unit(rows) @ turn
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([
        pa.array(np.arange(6000)), pa.array([c.tobytes() for c in np.packbits(rotated > 0, axis=1)], pa.binary()),
        pa.array((np.abs(rotated).sum(axis=1) / 8).astype(np.float32)), pa.array(rows.tolist()),
    ], names=neighbours.CODED.names)
    ids = np.arange(0, 6000, 600)
    query, vec, score = neighbours._search([batch], ids, rows[ids], np.full(10, -np.inf), 5, 3, neighbours.BOUND)
    assert sum(measured) < 0.5 * 6000 * len(ids)
    expected = brute(list(enumerate(rows)), [(i, rows[i]) for i in ids], 5)
    found = {}
    for q, v, s in sorted(zip(query.tolist(), vec.tolist(), score.tolist()), key=lambda t: (t[0], -t[2], t[1])):
        found.setdefault(q, []).append((v, s))
    assert recall(found, expected) == 1


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
        (50, [1.0, 1.0]), (2, [1.0, 0.0]), (10, []), (100, [2.0**-100, 0.0]),
    ]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as code")
    vectors = neighbours.usable(table)
    found = lists(neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0")))
    assert sorted(found) == [0, 50, 100]
    assert [v for v, _ in found[0]] == [1, 2, 2, 100, 50]
    assert [v for v, _ in found[50]] == [0, 1, 2, 2, 3]
    huge = spark.createDataFrame(
        [(0, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [0.0, 1e200])], "vec_id long, embedding array<double>"
    )
    scores = {v: s for v, s in lists(neighbours.nearest(huge, huge.where("vec_id = 0")))[0]}
    assert abs(scores[1] - 0.5**0.5) < 1e-15 and abs(scores[2] - 0.5**0.5) < 1e-15
    few = neighbours.nearest(vectors.where("vec_id in (0, 3)"), vectors.where("vec_id = 0"))
    assert [(r.vec_id, r.score) for r in few.collect()] == [(3, 0.0)]
    none = neighbours.usable(spark.createDataFrame([], SCHEMA))
    assert neighbours.nearest(none, none).count() == 0
    assert neighbours.nearest(vectors, vectors.where("false")).count() == 0
