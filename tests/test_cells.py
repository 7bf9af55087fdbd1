"""Search in cells: the lists of the plain search, and files that stay unread."""

import tracemalloc

import numpy as np
import pytest

import shelflight as sl
from shelflight.operators import cells as cells_module
from shelflight.operators.cells import ODD, knn_in_cells, read_cells, write_cells
from tests.test_search import CATALOG, REQUESTS, brute


def clustered(rng, n, groups, dim):
    centres = rng.normal(0, 100, (groups, dim))
    return (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.5, (n, dim))).astype(np.float32)


def tables(spark, rows, queries, limits):
    catalog = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], CATALOG).repartition(3)
    asked = [(f"q{i}", "", 1, int(n), 0.0, q.tolist()) for i, (q, n) in enumerate(zip(queries, limits))]
    return catalog, spark.createDataFrame(asked, REQUESTS)


def lists(df):
    return sorted((r.query_id, r["rank"], r.row_id, r.dist) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kind", ["clustered", "ties"])
def test_cells_give_the_lists_of_the_plain_search(spark, tmp_path, seed, kind):
    rng = np.random.default_rng(seed)
    n, dim = 600, 3
    rows = clustered(rng, n, 7, dim) if kind == "clustered" else rng.integers(-2, 3, (n, dim)).astype(np.float32)
    queries = np.concatenate([rows[:5], rng.normal(0, 60, (4, dim)).astype(np.float32)])
    limits = rng.integers(1, 40, len(queries))
    limits[-1] = 5000
    catalog, asked = tables(spark, rows, queries, limits)
    index = write_cells(catalog, f"{tmp_path}/cells", cells=9)
    expected = lists(sl.knn_candidates(asked, catalog))
    assert lists(knn_in_cells(asked, index)) == expected
    assert lists(knn_in_cells(asked, read_cells(spark, f"{tmp_path}/cells"), limit_bytes=700)) == expected
    assert len(expected) == len(brute(queries, limits, range(n), rows))


def test_files_of_far_cells_stay_unread(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 3000, 12, 6)
    catalog, asked = tables(spark, rows, rows[:2], [10, 10])
    index = write_cells(catalog, f"{tmp_path}/cells", cells=12)
    read = []
    found = knn_in_cells(asked, index, read=read)
    assert lists(found) == lists(sl.knn_candidates(asked, catalog))
    assert 0 < len(read[0]) <= 4 < len(index.numbers)
    chosen = index.vectors.where(index.vectors["cell"].isin([*map(int, read[0])]))
    scan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in scan
    files = chosen.selectExpr("input_file_name() f").distinct().count()
    assert files < index.vectors.selectExpr("input_file_name() f").distinct().count() / 2


def test_uniform_vectors_are_read_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = rng.uniform(-1, 1, (800, 16)).astype(np.float32)
    catalog, asked = tables(spark, rows, rng.uniform(-1, 1, (6, 16)).astype(np.float32), [20] * 6)
    index = write_cells(catalog, f"{tmp_path}/cells", cells=6)
    read = []
    assert lists(knn_in_cells(asked, index, read=read)) == lists(sl.knn_candidates(asked, catalog))
    assert len(read) == 1 and len(set(read[0])) == len(read[0]) <= 6


def test_odd_tables(spark, tmp_path):
    rows = np.array([[1, 2], [np.nan, 0], [np.inf, 1], [1, 2], [3e38, -3e38], [0, 0]], np.float32)
    catalog, asked = tables(spark, rows, np.array([[1, 2], [0, np.nan]], np.float32), [6, 3])
    index = write_cells(catalog, f"{tmp_path}/odd", cells=2)
    assert index.vectors.where(f"cell = {ODD}").count() == 2
    got, want = (
        [(r.query_id, r["rank"], r.row_id) for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"]))]
        for df in (knn_in_cells(asked, index), sl.knn_candidates(asked, catalog))
    )
    assert got == want
    none = write_cells(catalog.where("false"), f"{tmp_path}/none")
    assert knn_in_cells(asked, none).count() == 0
    assert knn_in_cells(asked.where("false"), index).count() == 0


def test_centres_are_fitted_in_bounded_memory():
    sample = np.random.default_rng(1).normal(size=(20_000, 4))
    tracemalloc.start()
    try:
        centres = cells_module._fit(sample, 500)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(centres) == 500 and peak < 40 << 20  # all distances at once: 80 MB, three times


def test_cells_files_and_bounds_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells_module, "MOST_CELLS", 8)
    monkeypatch.setattr(cells_module, "GAPS_AT_ONCE", 20)  # bounds of two requests at once
    rng = np.random.default_rng(7)
    rows = np.concatenate([clustered(rng, 900, 20, 4), np.zeros((900, 4), np.float32)])  # one very large cell
    queries = np.concatenate([rows[:5], rows[-1:], rng.normal(0, 60, (2, 4)).astype(np.float32)])
    catalog, asked = tables(spark, rows, queries, [3, 30, 1, 0, 9, 40, 7, 2000])
    index = write_cells(catalog, f"{tmp_path}/cells", cells=300)
    assert 1 < len(index.numbers) <= 8 and index.rows.sum() == len(rows)
    files = index.vectors.selectExpr("cell", "input_file_name() f").distinct().groupBy("cell").count().collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in files) < len(index.numbers) + parts and max(r["count"] for r in files) > 1
    assert lists(knn_in_cells(asked, index)) == lists(sl.knn_candidates(asked, catalog))
