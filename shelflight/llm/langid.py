"""Operator 10: the languages of a document as a mixture of n-gram models.

Each language has a distribution over hashed byte trigrams, learned from labelled
documents. A document's trigrams are draws from a mixture of languages; their
proportions are estimated by expectation maximisation. The set of languages grows
from the single best one as long as a further language raises the penalised
log-likelihood.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelflight.llm.common import PIECE, column, map_arrow

BUCKETS = 1 << 16
UNKNOWN = "und"
# Added to each bucket's count.
SMOOTHING = 0.5
# Share of a uniform distribution in the model that texts are rejected by: what a
# trigram without counts costs must not follow the size of the corpus.
BACKGROUND = 0.03
# Steps of expectation maximisation for a set of languages.
STEPS = 24
# What a further language must gain, in units of log(trigrams) (a free proportion
# costs half a unit by the Bayesian information criterion).
PENALTY = 2.0
# More label values than this are refused: the model would not stay small.
MAX_LANGUAGES = 256

_LETTER = re.compile(r"[^\W\d_]")
# Bytes of ASCII that are no letter become spaces (fixed values).
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text in lower case, where digits, signs and
    white space of ASCII are one space."""
    flat = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    data = np.frombuffer(b" %b " % b" ".join(flat.split()), np.uint8).astype(np.uint32)
    mixed = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return ((mixed * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _pieces(text: str):
    """Long texts in parts cut at a space, so each part's arrays stay small."""
    at = 0
    while len(text) - at > PIECE:
        end = text.find(" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def features(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """(buckets, weights); a long text's equal trigrams are one bucket with a weight."""
    if len(text) <= PIECE:
        return trigrams(text), None
    counts = np.zeros(BUCKETS, np.int64)
    for part in _pieces(text):
        counts += np.bincount(trigrams(part), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used].astype(np.float64)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of (``lang``, ``text`` bytes)."""
    schema = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("n", T.LongType()),
    ])

    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                texts.setdefault(lang, []).append(text.as_py().decode("utf-8", "replace"))
            for lang, found in texts.items():
                counts = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held, size = [], 0
                for text in found:  # each by itself: no trigram reaches over two texts
                    for part in _pieces(text):
                        held.append(trigrams(part))
                        size += len(held[-1])
                        if size > PIECE:
                            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                            held, size = [], 0
                if held:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
                names=["lang", "bucket", "n"],
            )

    partial = labelled.select("lang", "text").mapInArrow(run, schema)
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Trigram distributions, one column for each language.

    With a ``background`` they are the plain shares of the counts mixed with that much
    of a uniform distribution, so counts multiplied by a number give the same model.
    """

    def __init__(self, languages: list[str], counts: np.ndarray, background: float | None = None):
        self.languages = languages
        if background is None:
            share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0, keepdims=True)
        else:
            total = counts.sum(axis=0, keepdims=True)
            plain = np.where(total > 0, counts / np.maximum(total, 1), 1 / BUCKETS)
            share = (1 - background) * plain + background / BUCKETS
        self.likelihood = np.ascontiguousarray(share)
        self.log_likelihood = np.log(self.likelihood)

    def classify(self, text: str) -> tuple[str, float, dict[str, float], float]:
        """(language of the largest proportion, that proportion, all proportions, what
        the mixture gains over chance in log-likelihood per trigram)."""
        if not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, {}, 0.0
        buckets, counts = features(text)
        total = float(len(buckets) if counts is None else counts.sum())
        weights = np.full(len(buckets), 1 / total) if counts is None else counts / total
        p = self.likelihood[buckets]
        single = weights @ self.log_likelihood[buckets]
        chosen = [int(np.argmax(single))]
        share, best = np.ones(1), float(single[chosen[0]])
        toll = PENALTY * np.log(max(total, 2.0)) / total
        while len(chosen) < len(self.languages):
            # the slope of the mean log-likelihood towards each language
            slope = (weights / (p[:, chosen] @ share)) @ p
            slope[chosen] = 0
            further = int(np.argmax(slope))
            if slope[further] <= 1:
                break
            trial = [*chosen, further]
            part, value = _mix(p[:, trial], np.append(share * 0.8, 0.2), weights)
            if value - best <= toll:
                break
            chosen, share, best = trial, part, value
        order = sorted(zip(-share, chosen))
        found = {self.languages[k]: float(-s) for s, k in order}
        top = self.languages[order[0][1]]
        return top, min(1.0, found[top]), found, best + float(np.log(BUCKETS))


def _mix(p: np.ndarray, share: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after STEPS of expectation maximisation, and the mean
    log-likelihood. The expected share of a language is its proportion times the
    mean of its likelihood over the mixture's."""
    for _ in range(STEPS):
        share = share * ((weights / (p @ share)) @ p)
        share = share / share.sum()
    return share, float(weights @ np.log(p @ share))


def learn(labelled: DataFrame, background: float | None = None) -> LanguageModel:
    """The model of all rows of (``lang``, ``text`` bytes) whose ``lang`` is not null.

    Counts are summed over all rows by Spark; the driver gets one number for each
    used (language, bucket), at most MAX_LANGUAGES * BUCKETS.
    """
    known = labelled.where("lang is not null")
    counts = trigram_counts(known)
    languages = [r[0] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages.sort()
    rows = {lang: i for i, lang in enumerate(languages)}
    seen = np.zeros((BUCKETS, len(languages)))
    got = counts.toArrow()
    if got.num_rows:
        at = np.array([rows[x] for x in got["lang"].to_pylist()])
        seen[got["bucket"].to_numpy(), at] += got["n"].to_numpy()
    return LanguageModel(languages, seen, background)


def held_out(id_column: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text, mod 4, is 2."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.where(~held_out(column(id_col))).where(column(text_col).isNotNull())
    return rows.select(column(lang_col).alias("lang"), column(text_col).cast("binary").alias("text"))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    model: LanguageModel | None = None,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` of every row.

    Without a ``model``, one is learned from the rows that are not held out.
    ``languages`` maps each language of the mixture to its proportion, ``lang_pred``
    is the largest (ties: the first by name) and ``score`` its proportion. A text
    that is null or has no letter is ``und`` with score 0 and an empty map, and so
    is every text if nothing was labelled. A null id counts as the empty text for
    the fold. Repeated rows stay; an empty table gives no rows.
    """
    model = model or learn(_training(docs, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(
        column(id_col).alias("doc_id"), held_out(column(id_col)).alias("held_out"),
        F.coalesce(column(text_col), F.lit("")).cast("binary").alias("text"),
    )
    schema = T.StructType([
        given.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.MapType(T.StringType(), T.DoubleType())),
    ])

    def start():
        known = sent.value

        def step(batch):
            made = [known.classify(t.as_py().decode("utf-8", "replace")) for t in batch.column("text")]
            return [
                batch.column("doc_id"), batch.column("held_out"), [m[0] for m in made],
                [m[1] for m in made], [list(m[2].items()) for m in made],
            ]

        return step

    return map_arrow(given, schema, start)


def in_known_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least_score: float = 0.0,
) -> DataFrame:
    """The rows of ``docs``, all columns, that known languages explain better than
    chance, and whose main one takes ``least_score`` of the text or more. Texts
    without letters (null, empty and blank ones too) go; a text in several known languages
    stays, however long. Rows are judged one by one: repeated ones share their fate, ids
    play no part but for the fold. An empty table gives no rows; if no row is labelled, no
    language is known and none stays. The decision does not depend on how often the corpus
    repeats its trigrams."""
    model = learn(_training(docs, id_col, text_col, lang_col), BACKGROUND)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        known = sent.value
        for batch in batches:
            keep = []
            for text in batch.column(at).cast(pa.binary()):
                lang, score, _, gain = known.classify((text.as_py() or b"").decode("utf-8", "replace"))
                keep.append(lang != UNKNOWN and gain > 0 and score >= least_score)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
