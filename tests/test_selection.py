"""Pools of any width: equal to lists, and no task that holds one request's pool."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import shelflight as sl
from shelflight import settings
from shelflight.operators import selection
from tests.conftest import rows_of
from tests.test_search import CATALOG, REQUESTS, brute

ASKED = [("a", 4000, 3), ("b", 5, 2), ("c", 10**6, 4), ("d", 1, 60), ("e", 0, 0), ("f", 700, -2)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = (rng.integers(-3, 4, (5000, 4)) / 2).astype(np.float32)  # many ties
    queries = (rng.integers(-3, 4, (len(ASKED), 4)) / 2).astype(np.float32)
    catalog = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], CATALOG).repartition(5)
    requests = spark.createDataFrame(
        [(n, "", k, pool, 0.0, q.tolist()) for (n, pool, k), q in zip(ASKED, queries)], REQUESTS
    )
    limits = [max(pool, k, 0) for _, pool, k in ASKED]
    expected = brute(queries, limits, range(len(rows)), rows)
    return catalog, requests, [(ASKED[q][0], d, i) for q, d, i in expected]


@pytest.mark.parametrize("wide, limit_bytes", [(100, 64 << 20), (0, 64 << 20), (100, 300), (10**7, 64 << 20)])
def test_wide_pools_equal_brute_force(data, wide, limit_bytes):
    catalog, requests, expected = data
    found = sl.knn_candidates(requests, catalog, limit_bytes=limit_bytes, wide_pool=wide)
    assert sorted((r.query_id, r.dist, r.row_id) for r in found.collect()) == sorted(expected)
    ranks = {}
    for name, _, row in expected:
        ranks[name, row] = sum(n == name for n, _ in ranks) + 1
    assert {(r.query_id, r.row_id): r["rank"] for r in found.collect()} == ranks


def test_no_task_ranks_a_whole_pool(spark, data):
    catalog, requests, _ = data
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # would join the small parts of a test
    try:
        found = sl.knn_candidates(requests.where("query_id = 'c'"), catalog, wide_pool=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    written = glob.glob(f"{settings.shared_dir(spark).removeprefix('file:')}/sorted-rows-*")
    sorted_rows = spark.read.parquet(max(written, key=os.path.getmtime))
    per_task = sorted_rows.groupBy(F.input_file_name()).count().collect()
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "WindowGroupLimit" in line]
    assert windows and all("_group" in line and "query_id" not in line.split("windowspecdefinition")[0] for line in windows)


def test_rerank_of_wide_pools_equals_windows(data):
    catalog, requests, _ = data
    found = sl.knn_candidates(requests, catalog, wide_pool=100).withColumn(
        "brand_phonetic", F.when(F.col("row_id") % 3 == 0, "A").otherwise("B")
    ).withColumns({n: F.lit("x") for n in ("brand_sku_id", "label", "brandLabel", "category")}).drop("rank")
    asked = requests.select("query_id", "k", F.lit(0.7).alias("boost"), F.array(F.lit("A")).alias("codes"))
    plain, spread = (sl.phonetic_rerank(found, asked, spread=s) for s in (False, True))
    columns = ("query_id", "row_id", "score", "rank")
    assert rows_of(plain, *columns) == rows_of(spread, *columns)
    assert rows_of(sl.best_k(plain)) == rows_of(sl.best_k(spread))
    counts = {r.query_id: r["count"] for r in sl.best_k(spread).groupBy("query_id").count().collect()}
    assert counts == {"a": 3, "b": 2, "c": 4, "d": 60, "f": 698}


def test_odd_distances_keep_their_order():
    values = np.array([0.0, 5e-324, 1e-300, 1.0, 1.001, 1.01, 4.0, 1e300, np.inf, np.nan, -np.nan])
    made = selection.buckets(values)
    assert (np.diff(made) >= 0).all() and made[-1] == made[-2] > made[-3]


def test_a_folder_of_the_drivers_machine_is_refused_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        settings.shared_dir(Cluster)
    Cluster.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://shared/checkpoints")
    assert settings.shared_dir(Cluster) == "hdfs://shared/checkpoints/shelflight-app"
