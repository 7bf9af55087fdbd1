"""Index, lookup and metadata output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelflight.settings import scratch_path


def write_index(index: DataFrame, path: str) -> None:
    """Vectors and metadata in one Parquet table: a vector scan and a metadata
    scan each read their own columns, and nothing is aligned by position."""
    index.write.mode("errorifexists").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_lookup(lookup: DataFrame, path: str) -> None:
    """JSON Lines in ``row_id`` order across the part files."""
    lookup.orderBy("row_id").write.mode("errorifexists").json(path)


def write_bucketed_lookup(lookup: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """A catalog table of the lookup, bucketed and sorted by ``row_id``: a join with it on
    that column moves the other side only, whatever the table's size."""
    options = {"path": path} if path else {}
    dealt = lookup.repartition(buckets, "row_id")
    dealt.write.bucketBy(buckets, "row_id").sortBy("row_id").mode("errorifexists").saveAsTable(table, **options)


def write_meta(meta: DataFrame, path: str) -> None:
    """The one metadata record as JSON."""
    meta.write.mode("errorifexists").json(path)


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and
    return the written table: it is computed once, survives lost executors, and
    its real size decides how it is joined."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
