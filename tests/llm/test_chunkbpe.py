"""Chunked encoding against one call of the library for each whole text."""

import hashlib
import json

import numpy as np
import public_tokenizers as vocabularies
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shelflight.llm import chunkbpe, queries
from tests.llm.helpers import by_id, docs_of

FILE = vocabularies.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
SMALL = chunkbpe.Encoder(FILE, cache_bytes=20_000)


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.fixture
def small_chunks(monkeypatch):
    for name, value in {"LEAST": 3, "MOST": 17, "MEAN": 7, "WINDOW": 4}.items():
        monkeypatch.setattr(chunkbpe, name, value)


PARTS = st.sampled_from([
    "a", "Zß", " ", "  ", "\n", "\t ", "'s", "'", "re", "12", "!?", "é", "漢", "字。", "　", "\x85", "\x1c", "😀",
    "<|endoftext|>", "<|endof", "text|>", ". ", "foo", "the", "​", "ªº", "х,",
])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=60).map("".join), min_size=1, max_size=4))
def test_joins_are_exact(texts):
    saved = chunkbpe.LEAST, chunkbpe.MOST, chunkbpe.MEAN
    chunkbpe.LEAST, chunkbpe.MOST, chunkbpe.MEAN = 3, 17, 7
    try:
        for _ in range(2):
            assert [ids_of(x) for x in SMALL.encode(texts)] == [whole(t) for t in texts]
    finally:
        chunkbpe.LEAST, chunkbpe.MOST, chunkbpe.MEAN = saved


def test_chunks_follow_the_content(small_chunks):
    rng = np.random.default_rng(3)
    passage = "".join(map(chr, rng.integers(97, 123, 400)))
    cuts = [set(chunkbpe.chunks(lead + passage)) for lead in ("", "xyz ", "some other start of a text ")]
    assert all("".join(chunkbpe.chunks(passage)) == passage for _ in cuts)
    assert len(cuts[0] & cuts[1] & cuts[2]) > 0.8 * len(cuts[0])
    assert all(len(c) <= 17 for c in cuts[0])


def test_shared_chunks_are_encoded_once():
    rng = np.random.default_rng(4)
    words = [f"{''.join(map(chr, rng.integers(97, 123, 5)))}" for _ in range(5000)]
    passage = " ".join(words)
    enc = chunkbpe.Encoder(FILE)
    texts = [f"document {i} begins here {passage} and ends {i}" for i in range(20)]
    assert [ids_of(x) for x in enc.encode(texts)] == [whole(t) for t in texts]
    assert enc.encoded < 0.1 * enc.asked


def test_query_on_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = by_id(queries.op12_chunked_bpe(spark, sf), "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(found) == len(rows)
    for row in rows:
        ids = whole(row.text)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert found[row.doc_id] == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )


def test_very_long_texts():
    enc = chunkbpe.Encoder(FILE)
    texts = [" " * 300_000 + "x", "ab" * 60_000, "word " * 100_000, "漢字、" * 50_000, "\n" * 100_000, "漢" * 60_000]
    made = [np.frombuffer(x, "<u4") for x in enc.encode(texts)]
    assert [m.tolist() for m in made] == [whole(t) for t in texts]
    assert enc.decode(made) == texts


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "a <|endoftext|> b"), (None, "a <|endoftext|> b"), (4, "x\u0000y")]
    docs = docs_of(spark, rows).selectExpr("*", "0 as ids", "1 as decoded")
    made = chunkbpe.encode(docs, FILE, decoded=True)
    again = chunkbpe.decode(chunkbpe.encode(docs, FILE), FILE)
    want = sorted((repr(d), whole(t), LIBRARY.decode(whole(t), skip_special_tokens=False)) for d, t in rows)
    for found in (made, again):
        assert sorted((repr(r.doc_id), ids_of(bytes(r.ids)), r.decoded) for r in found.collect()) == want
    assert chunkbpe.encode(docs_of(spark, []), FILE).count() == 0
    lost = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert chunkbpe.decode(lost, FILE).first().decoded is None


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    with open(FILE) as lines:
        stated = json.load(lines)
    stated["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(stated))
    with pytest.raises(ValueError):
        chunkbpe.Encoder(str(tmp_path / "other.json"))
