"""From raw documents to token ids, one written table after the other.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``shelflight.llm``.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflight.llm import bpe, decontaminate, langid, simhash
from shelflight.llm.common import table
from shelflight.sources.sinks import freeze

# No SQL: fingerprints, suffix arrays and merges are not SQL-expressible.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null, empty and blank ones too), or that no known language
    explains, go, whatever their length. Rows are judged one by one; an empty table, or one
    without labelled rows, gives no rows."""
    return langid.in_known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints of four-word shingles within 4 bits the
    one with the smallest id stays (null ids last; of equal ids the smallest hash of text
    and row). Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows are one; long texts are read whole; an empty table gives no rows."""
    return simhash.one_of_each(docs, radius=simhash.RADIUS, width=simhash.SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none
    and stay; rows are judged one by one on whole texts; an empty table gives no rows, and
    an empty benchmark takes none away."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of every document, with the digests of the ids and of the bytes
    that they decode to. A null or empty text has no ids; repeated rows and null ids stay;
    long texts are encoded in parts, whole; an empty table gives no rows."""
    made = bpe.round_trip(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    return made.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
