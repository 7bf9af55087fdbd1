"""Operator 12: byte-level BPE that encodes chunks shared by documents once.

1. A rolling hash over the last ``WINDOW`` characters cuts a text in chunks, so equal
   passages are cut alike wherever they stand.
2. Each worker encodes a chunk that it does not hold yet by the tokenizers library, new
   neighbours as one text and all those of a slice of texts in one call, and keeps its
   ids within ``CACHE_BYTES``. Chunks are compared as texts, not by their hash. A new
   text is itself made of spans (a word with the white space before it) that end at
   boundaries and so need no repair; each distinct span is encoded once.
3. A chunk's ids hold between its first and last boundary: places where the
   pre-tokenizer always splits, whatever stands around them, and where the chunk's ids
   have a token end. A join is repaired by encoding the text from the last boundary
   before it up to the first one after it; where a chunk has none, the text re-encoded
   grows over it, until ids agree at a boundary or the document ends.

The ids are those of one call of the library for the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm.common import WHITE, id_and_text, text_slices

# Characters that the rolling hash sees, and the mean, least and greatest chunk.
WINDOW = 32
MEAN, LEAST, MOST = 512, 128, 4096
# Bytes of cached chunks in a worker, about; half of them stay when it is full.
CACHE_BYTES = 64 << 20
# Bytes of cached spans in a worker, about; characters of the longest span kept; spans
# given to the library as one text.
SPAN_BYTES, LONGEST_SPAN, STRUNG = 96 << 20, 256, 512
# Bytes of text encoded at once.
TOGETHER = 1 << 20
# Ids decoded at once, about.
DECODED_IDS = 1 << 16

_FACTOR = 0x9E3779B1
# Characters that are letters in every version of Unicode, and signs that never are
# (fixed values). No match of the pre-tokenizer goes on from a letter to a sign, nor
# from anything else to white space.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡА-яぁ-ゖァ-ヺ一-龥"
_SIGNS = ".,;:!?()、。！，：；？"
_SPAN = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])[{WHITE}]|(?<=[{_LETTERS}])[{_SIGNS}]")


def chunks(text: str) -> list[str]:
    """The text cut where the hash of the last WINDOW characters says so, at least LEAST
    and at most MOST characters apart."""
    if len(text) <= LEAST:
        return [text] if text else []
    rolled = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(_FACTOR)
    rolled ^= rolled >> np.uint32(15)
    span = 1
    while span < WINDOW:
        power = np.uint32(pow(_FACTOR, span, 1 << 32))
        longer = rolled.copy()
        longer[span:] += rolled[:-span] * power
        rolled, span = longer, 2 * span
    ends = np.flatnonzero((rolled * np.uint32(_FACTOR)) < np.uint32((1 << 32) // MEAN)) + 1
    made, at = [], 0
    for end in [*ends.tolist(), len(text)]:
        while end - at > MOST:
            made.append(text[at:at + MOST])
            at += MOST
        if end - at >= LEAST or end == len(text) > at:
            made.append(text[at:end])
            at = end
    return made


class Chunk(NamedTuple):
    """Little-endian uint32 ids between the first and the last boundary of a text, and
    the characters before each; no boundaries, no ids."""

    ids: bytes
    first: int
    last: int


NO_BOUNDARY = Chunk(b"", -1, -1)


class Encoder:
    """The library's ids of whole texts, from chunks and repaired joins."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as lines:
            stated = json.load(lines)
        split = stated["pre_tokenizer"] or {}
        added = stated["added_tokens"]
        if (
            stated["normalizer"] or stated["model"].get("dropout") or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True)
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{WHITE}{_SIGNS}]", t["content"]) for t in added)
        ):
            raise ValueError("needs a byte-level tokenizer without normalizer, prefix space, dropout and stripping tokens")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=-1) + 1
        # a byte-level token's text has one character for each byte
        self.bytes = np.zeros(size, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        for token in added:
            self.bytes[token["id"]] = len(token["content"].encode())
        self.opens = np.zeros(size, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.cache_bytes = cache_bytes
        self.new: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.spans: dict[str, bytes] = {}
        self.held = self.span_bytes = self.asked = self.encoded = 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.frombuffer(array("I", e.ids), np.uint32).astype("<u4", copy=False) for e in made]

    def _learn_spans(self, spans: list[str]) -> None:
        """Encodes new spans. Those that begin with white space after a word and end with
        a word stand in one text as they do here, and are told apart by their bytes."""
        strung = [s for s in spans if s[0] in WHITE and s[-1] not in WHITE]
        alone = [s for s in spans if s[0] not in WHITE or s[-1] in WHITE]
        for span, ids in zip(alone, self._library(alone)):
            self.spans[span] = ids.tobytes()
        groups = [strung[i:i + STRUNG] for i in range(0, len(strung), STRUNG)]
        for group, ids in zip(groups, self._library(["".join(g) for g in groups])):
            ends = np.cumsum(self.bytes[ids])
            sizes = np.fromiter((len(s.encode()) for s in group), np.int64, len(group))
            cuts = (4 * (np.searchsorted(ends, np.cumsum(sizes)) + 1)).tolist()
            data = ids.tobytes()
            self.spans.update(zip(group, (data[a:b] for a, b in zip([0, *cuts], cuts))))
        self.span_bytes += sum(5 * len(s) + 160 for s in spans)

    def _spelled(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of texts, each distinct span encoded once."""
        if self.span_bytes > SPAN_BYTES:
            self.spans, self.span_bytes = {}, 0
        split = [_SPAN.findall(text) for text in texts]
        new = list(set().union(*split).difference(self.spans))
        self._learn_spans(new)
        made = [np.frombuffer(b"".join(map(self.spans.__getitem__, spans)), "<u4") for spans in split]
        for span in new:
            if len(span) > LONGEST_SPAN:
                del self.spans[span]
                self.span_bytes -= 5 * len(span) + 160
        return made

    def _between(self, text: str, ids: np.ndarray, ends: np.ndarray, start: int, size: int) -> Chunk:
        """The chunk of a text that stands at byte ``start``, ``size`` bytes long, of what
        ``ids`` were made of; ``ends`` are the bytes up to each id's end."""
        first = _BOUNDARY.search(text, 1)
        if first is None:
            return NO_BOUNDARY
        last, back = first, 64
        while back < 4 * len(text):
            found = list(_BOUNDARY.finditer(text, max(len(text) - back, 1)))
            if found:
                last = found[-1]
                break
            back *= 4
        places = first.start(), last.start()
        wanted = np.array([start + len(text[:places[0]].encode()), start + size - len(text[places[1]:].encode())])
        at = np.searchsorted(ends, wanted)
        if at[1] >= len(ends) or (ends[at] != wanted).any():
            return NO_BOUNDARY
        return Chunk(ids[at[0] + 1:at[1] + 1].tobytes(), *places)

    def _known(self, text: str) -> Chunk | None:
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is not None:
                self._keep(text, found)
        return found

    def _keep(self, text: str, chunk: Chunk) -> None:
        self.new[text] = chunk
        self.held += 2 * len(text) + len(chunk.ids) + 400

    def _age(self) -> None:
        if 2 * self.held > self.cache_bytes:
            self.old, self.new, self.held = self.new, {}, 0

    def _learn(self, run: list[str], ids: np.ndarray) -> None:
        """Keeps the chunks of a run of neighbours that were encoded as one text."""
        ends, at = np.cumsum(self.bytes[ids]), 0
        for part in run:
            size = len(part.encode())
            self._keep(part, self._between(part, ids, ends, at, size))
            at += size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text.

        New chunks that are neighbours are given to the library as one text, so only
        joins with chunks that are held already, or that come twice, need repair.
        """
        self._age()
        self.asked += sum(map(len, texts))
        claimed: set[str] = set()
        plans: list[list[str | list[str]]] = []
        for text in texts:
            plan: list[str | list[str]] = []
            for part in chunks(text):
                if part in claimed or self._known(part) is not None:
                    plan.append(part)
                    continue
                claimed.add(part)
                if plan and isinstance(plan[-1], list):
                    plan[-1].append(part)
                else:
                    plan.append([part])
            plans.append(plan)
        runs = [run for plan in plans for run in plan if isinstance(run, list)]
        whole = ["".join(run) for run in runs]
        made = iter(self._counted(whole))
        joined = []
        own = iter(whole)
        fresh: list[tuple[list[str], np.ndarray]] = []
        items_of = []
        for plan in plans:
            items = []
            for run in plan:
                if isinstance(run, list):
                    ids = next(made)
                    fresh.append((run, ids))
                    items.append((next(own), ids))
                else:
                    items.append((run, None))
            items_of.append(items)
        for run, ids in fresh:
            self._learn(run, ids)
        for items in items_of:
            joined.append(self._joined(items))
        repairs = list({p for parts in joined for p in parts if isinstance(p, str)})
        repaired = dict(zip(repairs, (x.tobytes() for x in self._counted(repairs))))
        result = [b"".join(repaired[p] if isinstance(p, str) else p for p in parts) for parts in joined]
        for text, ids in zip(texts, result):
            if int(self.bytes[np.frombuffer(ids, "<u4")].sum()) != len(text.encode()):
                raise AssertionError("ids do not stand for the text")
        return result

    def _counted(self, texts: list[str]) -> list[np.ndarray]:
        self.encoded += sum(map(len, texts))
        return self._spelled(texts)

    def _joined(self, items: list[tuple[str, np.ndarray | None]]) -> list[bytes | str]:
        """Ids that hold and texts to encode anew, in order, of a document's runs (with
        their ids) and held chunks."""
        if len(items) == 1 and items[0][1] is not None:
            return [items[0][1].tobytes()]
        made: list[bytes | str] = []
        waiting: list[str] = []
        for i, (text, ids) in enumerate(items):
            if ids is None:
                inner, first, last = self.new[text]
            else:
                ends = np.cumsum(self.bytes[ids])
                inner, first, last = self._between(text, ids, ends, 0, len(text.encode()))
            if first < 0:
                waiting.append(text)
                continue
            waiting.append(text[:first])
            made += ["".join(waiting), inner]
            waiting = [text[last:]]
        if waiting:
            made.append("".join(waiting))
        return made

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The library's text of each id list, special tokens included. Long lists are
        cut before tokens that open with a space, which is never within a character."""
        owner, parts = [], []
        for row, ids in enumerate(rows):
            at = 0
            while len(ids) - at > 2 * DECODED_IDS:
                opens = np.flatnonzero(self.opens[ids[at + DECODED_IDS:at + 2 * DECODED_IDS]])
                if not len(opens):
                    opens = np.flatnonzero(self.opens[ids[at + 2 * DECODED_IDS:]]) + DECODED_IDS
                if not len(opens):
                    break
                end = at + DECODED_IDS + int(opens[0])
                parts.append(ids[at:end].tolist())
                owner.append(row)
                at = end
            parts.append(ids[at:].tolist())
            owner.append(row)
        texts: list[list[str]] = [[] for _ in rows]
        for row, text in zip(owner, self.tokenizer.decode_batch(parts, skip_special_tokens=False)):
            texts[row].append(text)
        return ["".join(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def encode(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id, ids`` (little-endian uint32) of every whole text, as one call of the
    library with ``add_special_tokens=False`` gives them; strings of added tokens are
    those tokens. ``decoded=True`` adds ``decoded``, the text that the ids decode to.

    ``tokenizer_file`` is a path that every worker can open, of a byte-level tokenizer
    without normalizer. A null or empty text has no ids. Rows are independent: repeats of
    a row or an id stay, null ids stay, an empty table gives an empty table, other
    columns are left behind. Long texts are cut like others; a text without any boundary
    goes to the library whole. Bytes that are not UTF-8 read as U+FFFD.
    """
    given = id_and_text(docs, id_col, text_col)
    fields = [given.schema["doc_id"], T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())] if decoded else fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        library = encoder(tokenizer_file)
        for batch in batches:
            for part in text_slices(batch, TOGETHER):
                texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
                ids = library.encode(texts)
                columns = [part.column("doc_id"), pa.array(ids, arrow[1].type)]
                if decoded:
                    columns.append(pa.array(library.decode([np.frombuffer(x, "<u4") for x in ids]), arrow[2].type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; ids of null give null, no ids an empty text.

    An id outside of the vocabulary fails the job.
    """
    kept = encoded.select("doc_id", "ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        library = encoder(tokenizer_file)
        for batch in batches:
            for part in text_slices(batch, TOGETHER, "ids"):
                ids = part.column("ids").to_pylist()
                made = library.decode([np.frombuffer(x or b"", "<u4") for x in ids])
                columns = [part.column("doc_id"), part.column("ids"), pa.array(
                    [m if x is not None else None for m, x in zip(made, ids)], arrow[2].type
                )]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return kept.mapInArrow(run, schema)


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded rows."""
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
