"""Catalog input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelflight.functions.text import missing_to_null
from shelflight.operators.ranking import spread_row_number
from shelflight.sources.multiline import multi_line_records

# The columns a catalog must have (fixed values).
REQUIRED_COLUMNS = ("brand_sku_id", "product_name", "brand_name", "category_name")

_OPTIONS = {
    "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "mode": "FAILFAST",
}


def require_columns(df: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"catalog is missing required columns: {missing}")
    return df


def scan_csv(
    spark: SparkSession, path, max_rows: int | None = None, multi_line: bool = False
) -> DataFrame:
    """Read a catalog CSV with a header; all columns are text, ``row_id`` is the
    0-based position over the files in path order.

    The read is complete or fails: a record with too few or too many cells, a file
    whose header differs from the first one's, and a quote left open at the end of a
    line raise an error in the job. Line breaks inside quotes need ``multi_line=True``;
    files are then split as well, see ``multiline``, at the price of a second scan, and a
    quote left open fails the job at the end of its file.

    The position needs no sort of the data: rows are numbered within their file
    split, and splits are shifted by the rows before them (one number per split).
    Identity thus depends on the files alone. Blank lines are no rows.
    """
    header = spark.read.options(header=True, multiLine=multi_line, **_OPTIONS).csv(path)
    names = header.columns
    require_columns(header)
    parsed = F.from_csv("text", _ddl(names), _OPTIONS).alias("_record")
    if multi_line:
        records = multi_line_records(spark, path).select(parsed, "_file", "_block", F.col("_seq").alias("_seen"))
    else:
        lines = spark.read.text(path).where(F.trim("value") != "").where(_closed_quotes()).select(
            F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        records = lines.select(parsed, "_file", "_block").withColumn("_seen", F.monotonically_increasing_id())

    headers = F.when(F.col("_block") == 0, 1).otherwise(0)

    splits = records.groupBy("_file", "_block").agg(
        F.min("_seen").alias("_first"), (F.count(F.lit(1)) - headers).alias("_rows")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift")
    )
    place = F.col("_seen") - F.col("_first") - headers
    numbered = records.join(offsets, ["_file", "_block"]).where(
        F.when(place >= 0, True).otherwise(_same_header(names))
    ).select(
        (place + F.col("_shift")).alias("row_id"),
        *[missing_to_null(F.col("_record")[name]).alias(name) for name in names],
    )
    if max_rows is not None and max_rows > 0:
        numbered = numbered.where(F.col("row_id") < max_rows)
    return numbered


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + name.replace("`", "``") + "` string" for name in names)


def _closed_quotes() -> Column:
    """True, or an error if a quote is open at the end of the line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    error = F.raise_error(F.lit("a quote is open at the end of a line: set multi_line=True"))
    return F.when(quotes % 2 == 0, True).otherwise(error.cast("boolean"))


def _same_header(names: list[str]) -> Column:
    """False (a header is no row), or an error if it differs from ``names``."""
    cells = F.array(*[F.coalesce(F.col("_record")[n], F.lit(f"_c{i}")) for i, n in enumerate(names)])
    error = F.raise_error(F.concat(F.lit("another header in "), F.col("_file")))
    return F.when(cells == F.array(*map(F.lit, names)), False).otherwise(error.cast("boolean"))


def dealt_out(catalog: DataFrame) -> DataFrame:
    """The same rows, spread over tasks by ``row_id``. A catalog's files are small beside
    the work on their texts: a table of two splits would keep two cores busy."""
    return catalog.repartition("row_id")


def catalog_head(catalog: DataFrame, max_rows: int | None) -> DataFrame:
    """The first ``max_rows`` rows by ``row_id``; all rows for none or 0.

    Rows stay in their partitions: ids that count from 0, as the readers give them,
    are cut by value; of other ids the last one to stay is looked up first.
    """
    if max_rows is None or max_rows <= 0:
        return catalog
    below = F.col("row_id") < max_rows
    seen = catalog.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(below, 1)).alias("below"), F.min("row_id").alias("least")
    ).first()
    if seen["rows"] == 0 or (seen["least"] >= 0 and seen["below"] == min(max_rows, seen["rows"])):
        return catalog.where(below)
    numbered = spread_row_number(catalog.withColumn("_all", F.lit(1)), ["_all"], [F.col("row_id")], "_place")
    return numbered.where(F.col("_place") <= max_rows).select(*catalog.columns)


def read_table(spark: SparkSession, source: str, fmt: str | None = None, **options) -> DataFrame:
    """A relational table: a catalog table name, or a path with a format."""
    if fmt is None:
        return spark.table(source)
    return spark.read.format(fmt).options(**options).load(source)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
    partitions: int, properties: dict[str, str],
) -> DataFrame:
    """A database table, read by ranges of a numeric column in parallel."""
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=properties,
    )
