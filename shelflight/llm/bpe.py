"""Operator 6: byte-level BPE by the tiktoken library, and raw-byte decoding.

The library encodes each match of the pattern separately. Its regular-expression
engine keeps a stack that a very long run of white space overflows, and a long
text's id list takes memory, so a long text is cut first, only where the pattern
has a match boundary whatever stands around it:

* before white space that follows something else: no match reaches over it, and
  no alternative looks back;
* within a long run of white space that text follows, before its last character:
  the pattern takes the run without it as one match.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm.common import WHITE, id_and_text, list_array, map_arrow, text_slices

# Characters of text given to the library at once, about.
SEGMENT = 1 << 16
# Bytes of text encoded and decoded before they are handed on.
TOGETHER = 4 << 20
# From this length a run of white space is one piece by itself.
LONG_RUN = 1 << 12

_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")
_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder with the ranks of a local file (one per worker process)."""
    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT) -> Iterator[tuple[str, bool]]:
    """(part, whole): parts of a text between safe boundaries; ``whole`` parts
    are exactly one match of the pattern."""
    if len(text) <= size:
        yield text, False
        return
    at = 0
    for run in [*_RUN.finditer(text), None]:
        stop = run.start() if run else len(text)
        while stop - at > size:
            cut = _CUT.search(text, at + size, stop)
            if cut is None:
                break
            yield text[at:cut.start()], False
            at = cut.start()
        if stop > at:
            yield text[at:stop], False
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start():at], True


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a whole text, the same as in one call of the library."""
    parts = []
    for part, whole in segments(text):
        ids = enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
        parts.append(np.array(ids, np.int32))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])


def raw_bytes(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    parts = (ids[i:i + SEGMENT].tolist() for i in range(0, len(ids), SEGMENT))
    return b"".join(map(enc.decode_bytes, parts))


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every whole text: ``doc_id``, ``ids`` array<int>.

    ``rank_file`` is a path that every worker can open. A null or empty text has
    no ids. Rows are independent: repeats of a row or of an id stay, null ids
    stay, and an empty table gives an empty table. Bytes that are not UTF-8 read
    as U+FFFD.
    """
    given = id_and_text(docs, id_col, text_col)
    schema = T.StructType([given.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def start():
        enc = encoding(rank_file, pattern)

        def step(batch):
            texts = batch.column("text")
            ids = [encode_text(enc, t.as_py().decode("utf-8", "replace")) for t in texts]
            return [batch.column("doc_id"), list_array(ids, pa.int32())]

        return step

    return map_arrow(given, schema, start)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``; ids of null give null.

    Bytes, not text: an id list cut anywhere decodes to the bytes it stands for.
    An id outside the vocabulary fails the job. Rows are independent: repeats stay, no ids
    give no bytes, an empty table gives an empty table, and a long list is decoded in parts.
    """
    kept = encoded.select("doc_id", "ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def start():
        enc = encoding(rank_file, pattern)

        def raw(ids):
            return raw_bytes(enc, ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else None

        def step(batch):
            ids = batch.column("ids")
            return [batch.column("doc_id"), ids, [raw(row) for row in ids]]

        return step

    return map_arrow(kept, schema, start)


def round_trip(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids, decoded``: ``decode`` of ``encode`` in one task and with one encoder,
    a slice of TOGETHER bytes of text at a time. Rows are treated as ``encode`` does."""
    given = id_and_text(docs, id_col, text_col)
    schema = T.StructType([
        given.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in text_slices(batch, TOGETHER):
                ids = [encode_text(enc, t.as_py().decode("utf-8", "replace")) for t in part.column("text")]
                columns = [part.column("doc_id"), list_array(ids, pa.int32()), pa.array([raw_bytes(enc, x) for x in ids])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return given.mapInArrow(run, schema)


def round_trip_digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
