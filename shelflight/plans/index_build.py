"""Catalog preparation and index build."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflight.functions.phonetic import METAPHONE, PhoneticEncoder
from shelflight.functions.text import normalise, search_text, strip
from shelflight.operators.checks import meta_record, require_consistent_vectors
from shelflight.operators.embedding import HashedNGrams, embed_table
from shelflight.sources.catalog import catalog_head, dealt_out, require_columns
from shelflight.sources.sinks import freeze, read_index, write_index, write_lookup, write_meta


def prepare_catalog(
    raw: DataFrame, null_text: str = "nan", phonetic: PhoneticEncoder = METAPHONE
) -> DataFrame:
    """Normalised texts, the text to embed and the brand's phonetic code, all
    computed on the row's own partition. Ids stay text."""
    require_columns(raw)
    brand, product, category = (
        normalise(F.col(name), null_text) for name in ("brand_name", "product_name", "category_name")
    )
    prepared = raw.select(
        "row_id",
        F.coalesce(F.col("brand_sku_id").cast("string"), F.lit(null_text)).alias("brand_sku_id"),
        product.alias("product_name"),
        brand.alias("brand_name"),
        category.alias("category_name"),
    )
    return prepared.withColumns(
        {
            "search_text": search_text(F.col("brand_name"), F.col("product_name"), F.col("category_name")),
            "brand_phonetic": phonetic.brand(F.col("brand_name")),
        }
    )


def lookup_columns(prepared: DataFrame, *extra: str) -> DataFrame:
    """Metadata shown with a hit, plus any ``extra`` columns of the same row."""
    return prepared.select(
        "row_id",
        strip(F.col("brand_sku_id")).alias("brand_sku_id"),
        strip(F.col("product_name")).alias("label"),
        strip(F.col("brand_name")).alias("brandLabel"),
        strip(F.col("category_name")).alias("category"),
        strip(F.col("brand_phonetic")).alias("brand_phonetic"),
        *extra,
    )


def lookup_export(lookup: DataFrame) -> DataFrame:
    """The lookup record of each row, under its export names."""
    return lookup.select(
        "row_id", F.col("brand_sku_id").alias("id"), "label", "brandLabel", "category", "brand_phonetic"
    )


def brand_codes(prepared: DataFrame, phonetic: PhoneticEncoder = METAPHONE) -> DataFrame:
    """Phonetic code of every distinct brand."""
    brands = prepared.select("brand_name").distinct()
    return brands.select("brand_name", phonetic.brand(F.col("brand_name")).alias("brand_phonetic"))


def build_catalog_index(
    raw: DataFrame, path: str, embedder=None, max_rows: int | None = None, null_text: str = "nan",
    phonetic: PhoneticEncoder = METAPHONE,
) -> DataFrame:
    """Build and write the index, lookup and metadata below ``path``; returns
    the index as read back. Nothing is written there before the vectors are checked:
    the index is built in the shared folder first, and one pass over its vectors
    serves the check and the metadata. Texts are encoded and embedded on all cores,
    whatever the splits of ``raw``."""
    embedder = embedder or HashedNGrams()
    prepared = prepare_catalog(dealt_out(catalog_head(raw, max_rows)), null_text, phonetic)
    embedded = embed_table(prepared, "search_text", embedder)
    staged = freeze(lookup_columns(embedded, "embedding"), "staged-index")
    found = require_consistent_vectors(staged)
    write_index(staged, f"{path}/index")
    index = read_index(raw.sparkSession, f"{path}/index")
    write_lookup(lookup_export(index), f"{path}/lookup")
    write_meta(meta_record(raw.sparkSession, found, embedder.name), f"{path}/meta")
    return index
