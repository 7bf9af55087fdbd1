"""Headline queries at one scale; prints one JSON line.

Every query runs once to warm the JVM and then ``BENCH_RUNS`` times (default 3);
the median counts. Results are written to Spark's no-op sink, so every column
of every row is produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from shelflight import clear_scratch, hybrid_search  # noqa: E402
from workload.queries import EMBEDDER, QUERIES, built_index, text_requests  # noqa: E402

HEADLINE = (
    "knn_candidates", "hybrid_search", "facet_counts", "price_range_facets", "filter_skus",
    "single_search", "filter_products", "facet_options", "facet_bundle", "facets_for_hits",
    "filter_products_no_broadcast", "filter_skus_no_broadcast",
    "knn_cells", "knn_wide", "filter_skus_indexed", "hybrid_search_double",
)
UNBROADCAST = "_no_broadcast"


def single_search(spark, sf_dir):
    """A batch of one."""
    one = text_requests(spark, sf_dir).limit(1)
    return hybrid_search(one, built_index(spark, sf_dir), EMBEDDER)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in {
        **settings, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        query = {**QUERIES, "single_search": single_search}[name.removesuffix(UNBROADCAST)]
        if name.endswith(UNBROADCAST):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        return took

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)

    pairs = text_requests(spark, sf_dir).count() * built_index(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "query_row_pairs": pairs,
                "pairs_per_sec": {
                    name: round(pairs / seconds[name])
                    for name in ("knn_candidates", "hybrid_search")
                    if name in seconds
                },
                "cpus": cpus,
                "settings": settings,
            }
        )
    )
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
