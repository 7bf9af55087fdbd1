"""The pipeline against its operators' plain versions on the smallest table."""

import corpus_pipeline
import public_tokenizers as vocabularies

from shelflight.llm import bpe
from tests.llm.test_decontaminate import plain_digest
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.known_language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == len(rows)

    prints = {d: plain_fingerprint(t) for d, t in rows.items()}
    roots = plain_components(sorted(set(prints.values())), 4)
    first = {}
    for d in sorted(rows):
        first.setdefault(roots[prints[d]], d)
    single = {d: rows[d] for d in first.values()}

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d: t for d, t in single.items() if not plain_digest(t, items)[-1]}

    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    enc = bpe.encoding(vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    assert found == {d: enc.encode_ordinary(t) for d, t in clean.items()}
    assert len(found) < len(rows)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        assert made.count() == 0


def test_stages_on_odd_rows(spark, sf):
    rows = [
        (None, "some words here", "en", None, None), (1, None, None, None, None), (2, "", "en", "s", 0),
        (3, "some words here", None, None, None), (4, "autre chose", "fr", None, None),
    ]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == schema.names
    assert sorted(r.doc_id for r in docs.collect()) == [3, 4]
