"""Shape checks and build statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F


def vector_check(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: counts and vector lengths, and whether they agree."""
    size = F.size(column)
    return df.agg(
        F.count(F.lit(1)).alias("num_items"),
        F.count(column).alias("num_vectors"),
        F.min(F.when(F.col(column).isNotNull(), size)).alias("min_dim"),
        F.max(F.when(F.col(column).isNotNull(), size)).alias("max_dim"),
    ).withColumn(
        "consistent",
        (F.col("num_items") == F.col("num_vectors"))
        & F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(True)),
    )


def require_consistent_vectors(df: DataFrame, column: str = "embedding") -> Row:
    """The row of ``vector_check``; raises when rows lack a vector or vectors differ
    in length."""
    found = vector_check(df, column).first()
    if not found.consistent:
        raise ValueError(
            f"{found.num_items} rows, {found.num_vectors} vectors of length "
            f"{found.min_dim} to {found.max_dim}"
        )
    return found


def meta_record(spark: SparkSession, found: Row, model: str) -> DataFrame:
    """The index metadata record from a checked index's counts."""
    return spark.createDataFrame(
        [(found.num_items, found.max_dim or 0, model, "exact_l2")],
        "num_items bigint, embedding_dim int, model string, index_type string",
    )


def index_meta(index: DataFrame, model: str) -> DataFrame:
    """The index metadata record."""
    return index.agg(
        F.count(F.lit(1)).alias("num_items"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("int").alias("embedding_dim"),
    ).select("num_items", "embedding_dim", F.lit(model).alias("model"), F.lit("exact_l2").alias("index_type"))
