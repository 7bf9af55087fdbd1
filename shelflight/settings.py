"""Defaults and size limits shared by the operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Search defaults (fixed values).
DEFAULT_K = 5
DEFAULT_POOL = 50
DEFAULT_BOOST = 0.2
# Defaults of the faceted search entry point, which uses a wider pool.
FACETED_K = 20
FACETED_POOL = 100
REQUEST_K = 50

# A query batch is shipped to every task only while its measured footprint
# (vectors plus running top lists) stays below this many bytes.
BATCH_LIMIT_BYTES = 64 << 20

# Fan-in of the first of the two top-k merges: one query's partial lists are
# spread over this many groups, so a single query never lands in one task.
MERGE_FANIN = 32

# Pools above this many rows are selected without lists (see operators/selection.py).
WIDE_POOL = 1 << 17

# Hit rows (two short ids each) that may be broadcast, after counting them.
SMALL_ROWS = 500_000

# Name of the synthetic price facet.
PRICE_KEY = "price_range"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for intermediate data of this application:
    below ``spark.checkpoint.dir`` where the session names one, else the context's
    checkpoint folder, else the session's warehouse. On a cluster the warehouse must not
    be a folder of the driver's machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and root.startswith(("/", "file:")):
            raise ValueError(f"set spark.checkpoint.dir: executors may not reach {root}")
    return os.path.join(root, f"shelflight-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate data. DataFrames that were returned
    before read from it, so their results must be written by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
