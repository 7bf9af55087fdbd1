"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflight.llm import (
    bpe, chunkbpe, collocations, decontaminate, langid, licenses, neighbours, periods, repair,
    sharding, simhash, warc, wordpiece,
)
from shelflight.llm.common import table
from shelflight.llm.oracle import ORACLE_SQL  # noqa: F401
from shelflight.settings import scratch_path


def op1_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    documents, benchmark = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontaminate.digest(decontaminate.verbatim_matches(documents, benchmark))


def op3_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, sf, "embeddings"))
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op4_warc_in_zip(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf, "documents"), licenses.templates(spark))
    runs = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return found.withColumn("spans", F.array_join(runs, ";"))


def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks, pattern = vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN
    encoded = bpe.encode(table(spark, sf, "documents"), ranks, pattern)
    return bpe.round_trip_digest(bpe.decode(encoded, ranks, pattern))


def op7_repair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    repair.write_shards(table(spark, sf, "documents"), path, vocabularies.path("byte_bpe_50k.json"))
    return repair.digest(repair.decoded_documents(repair.read_shards(spark, path)))


def op8_feistel_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_wordpiece_counts(spark: SparkSession, sf: str) -> DataFrame:
    return wordpiece.token_counts(
        table(spark, sf, "documents"), vocabularies.path("byte_bpe_multi_50k.tiktoken")
    )


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = langid.identify(table(spark, sf, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op12_chunked_bpe(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = vocabularies.path("byte_bpe_50k.json")
    return chunkbpe.digest(chunkbpe.encode(table(spark, sf, "documents"), tokenizer, decoded=True))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periods.digest(periods.periodic_runs(periods.looped(table(spark, sf, "documents"))))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_warc_in_zip": op4_warc_in_zip,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_repair_tokens": op7_repair_tokens,
    "op8_feistel_sharding": op8_feistel_sharding,
    "op9_wordpiece_counts": op9_wordpiece_counts,
    "op10_language_id": op10_language_id,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_chunked_bpe": op12_chunked_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
