"""Operator 11: phrases of two and three words that stand together more than by chance.

1. Each task reads its texts once, numbers the words it meets and writes segments: the
   words with their counts, and the texts as a stream of those numbers (0 ends a piece).
2. Word counts are summed over all segments. A phrase is counted ``least`` times only if
   its words are, so only such words get a number of the whole corpus; a segment's own
   numbers are joined to it, other words end a piece. No dictionary is broadcast.
3. Every segment counts its phrases in a counting quotient filter (``quotient``), cut by
   the first bits of the permuted keys. Filters of the same range are merged, up to
   2^FAN_BITS segments at a time, and cut finer, until each range holds all segments.
   Keys are spread evenly whatever phrases are frequent, and a phrase has one counter
   for each segment, so no phrase makes a large task.
4. Phrases of two words are counted first. A phrase of three words is counted only if
   both of its pairs may be frequent by a Bloom filter of fixed size, which never leaves
   out one that is; the more pairs there are, the less it spares.
5. Phrases of ``least`` occurrences are joined with the counts of their parts.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.llm import quotient
from shelflight.llm.common import column, giving_back, text_slices
from shelflight.llm.sharding import numbered_rows
from shelflight.sources.sinks import freeze

LEAST = 10
TOP = 2000
# A phrase goes if a longer one that holds it has this percentage of its occurrences.
SHARE = 50
# Words (and ends of pieces) and distinct words of a segment.
SEGMENT_WORDS = 1 << 20
SEGMENT_VOCABULARY = 1 << 19
# Segments whose filters are merged at once, and ranges cut from one range.
FAN_BITS = 8
# Words counted at once.
COUNTED_WORDS = 1 << 19
# Bits of the Bloom filter of frequent pairs (16 MB), its hashes, and bits of a block
# (a bitmap of Spark's has 4096 bytes).
BLOOM_BITS, BLOOM_HASHES, BLOCK_BITS = 1 << 27, 4, 1 << 15
# Keys that a last range holds, about.
RANGE_KEYS = 1 << 20
# Parts of a language that are ranked before the language is.
SALTS = 256
# Bytes of text split at once.
TOGETHER = 1 << 20

# A-Z lower case; signs and line ends that end a piece (fixed values) become a byte that
# no UTF-8 text holds.
_END = 0xFF
_READ = bytes(
    b + 32 if 0x41 <= b <= 0x5A else _END if b in b".,;:!?\n\v\f\r" else b for b in range(256)
)
_BREAK = bytes([_END])


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed uint32 numbers, all first bytes first, then all second ones."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * size), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _segments(docs: DataFrame) -> DataFrame:
    """Rows of words (``segment, local, lang, word, n``) and, one for each segment, of
    streams (``segment, stream``, compressed little-endian uint32 numbers)."""
    schema = T.StructType([
        T.StructField("segment", T.StringType()), T.StructField("local", T.LongType()),
        T.StructField("lang", T.StringType()), T.StructField("word", T.BinaryType()),
        T.StructField("n", T.LongType()), T.StructField("size", T.LongType()), T.StructField("stream", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def rows(length: int, **given) -> pa.RecordBatch:
        columns = [given.get(f.name) if f.name in given else pa.nulls(length, f.type) for f in arrow]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0

        def fresh():
            draw = count(1)
            return defaultdict(lambda: defaultdict(draw.__next__, {_BREAK: 0})), [], 0, draw

        known, stream, size, draw = fresh()

        def closed():
            name, numbers = f"{part}-{block}", np.concatenate(stream)
            seen = np.bincount(numbers)
            for lang, words in known.items():
                local = np.fromiter(words.values(), np.int64, len(words))
                kept = np.flatnonzero(local)
                texts = pa.array(list(words), pa.binary()).take(pa.array(kept))
                for at in range(0, len(kept), 1 << 16):
                    some = local[kept[at:at + (1 << 16)]]
                    n = len(some)
                    yield rows(
                        n, segment=pa.array([name] * n), local=pa.array(some), lang=pa.array([lang] * n),
                        word=texts.slice(at, n), n=pa.array(seen[some]),
                    )
            yield rows(1, segment=pa.array([name]), size=pa.array([len(numbers)]), stream=pa.array([_packed(numbers)]))

        for batch in batches:
            for some in text_slices(batch, TOGETHER):
                langs, texts = some.column("lang").to_pylist(), some.column("text").to_pylist()
                by_lang = defaultdict(list)
                for lang, text in zip(langs, texts):
                    by_lang[lang].append(text)
                for lang, own in by_lang.items():
                    split = b" \xff ".join(own).translate(_READ).replace(_BREAK, b" \xff ").split()
                    stream += [np.fromiter(map(known[lang].__getitem__, split), np.uint32, len(split)), np.zeros(1, np.uint32)]
                    size += len(split) + 1
                if size >= SEGMENT_WORDS or sum(map(len, known.values())) >= SEGMENT_VOCABULARY:
                    yield from closed()
                    known, stream, size, draw = fresh()
                    block += 1
        if stream:
            yield from closed()

    return docs.mapInArrow(giving_back(run), schema)


_FILTER = "range long, shard long, filter binary"
_PHRASE = "first long, second long, third long, a long"


def _renumbered(streams: DataFrame) -> DataFrame:
    """``shard, size, stream`` in corpus numbers, of ``segment, size, stream, pairs``."""
    schema = T.StructType.fromDDL("shard long, size long, stream binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                local = _unpacked(batch.column("stream")[i].as_py(), batch.column("size")[i].as_py())
                pairs = batch.column("pairs").slice(i, 1).flatten()
                table = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
                table[pairs.field("local").to_numpy()] = pairs.field("number").to_numpy()
                numbers = table[local]
                ends = numbers == 0  # of several ends of pieces one is enough
                numbers = numbers[~(ends & np.append(False, ends[:-1]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").slice(i, 1), pa.array([len(numbers)], pa.int64()), pa.array([_packed(numbers)])],
                    schema=arrow,
                )

    keyed = streams.withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(1 << 40)))
    return keyed.select("shard", "size", "stream", "pairs").mapInArrow(giving_back(run), schema)


def _places(high: np.ndarray, low: np.ndarray):
    """The Bloom filter's places of permuted keys, one array for each hash."""
    mixed = high * np.uint64(0x9E3779B97F4A7C15) + low
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    for i in range(BLOOM_HASHES):
        yield ((mixed + np.uint64(i) * step) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def _bloom(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit array of BLOOM_BITS of the pairs (``second, third``)."""
    schema = T.StructType.fromDDL("block long, bitmap binary")
    arrow, half = to_arrow_schema(schema), quotient.half_bits(bits)

    def run(batches):
        held = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            words = [batch.column(c).to_numpy().astype(np.uint64) for c in ("second", "third")]
            keys = quotient.permute(*quotient.pack((np.zeros_like(words[0]), *words), bits), half)
            for places in _places(*keys):
                np.bitwise_or.at(held, places >> 3, (128 >> (places & 7)).astype(np.uint8))
        blocks = held.reshape(-1, BLOCK_BITS // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at:at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([b.tobytes() for b in blocks[some]])], schema=arrow)

    made = pairs.select("second", "third").mapInArrow(giving_back(run), schema).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    rows = made.toArrow()
    whole = np.zeros((BLOOM_BITS // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for block, bitmap in zip(rows["block"].to_pylist(), rows["bitmap"].to_pylist()):
        whole[block] = np.frombuffer(bitmap, np.uint8)
    return whole.ravel()


def _pairs(numbers: np.ndarray, bits: int):
    """(high, low) keys of the neighbours and whether both are words."""
    first, second = numbers[:-1], numbers[1:]
    keys = quotient.permute(*quotient.pack((np.zeros_like(first), first, second), bits), quotient.half_bits(bits))
    return *keys, (first > 0) & (second > 0)


def _phrases(numbers: np.ndarray, bits: int, bloom: np.ndarray | None):
    """(high, low, counts) of all phrases of two words or, with a filter of pairs, of all
    phrases of three words whose pairs it holds."""
    half, made = quotient.half_bits(bits), []
    for at in range(0, max(len(numbers), 1), COUNTED_WORDS):
        some = numbers[at:at + COUNTED_WORDS + (1 if bloom is None else 2)].astype(np.uint64)
        high, low, whole = _pairs(some, bits)
        if bloom is None:
            high, low = high[whole], low[whole]
        else:
            held = np.ones(int(whole.sum()), bool)
            for places in _places(high[whole], low[whole]):
                held &= (bloom[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
            whole[whole] = held
            whole = whole[:-1] & whole[1:]
            words = tuple(some[i:len(some) - 2 + i][whole] for i in range(3))
            high, low = quotient.permute(*quotient.pack(words, bits), half)
        made.append(quotient.counted(high, low, None, half))
    return quotient.merge(made, half)


def _counted(streams: DataFrame, bits: int, prefix: int, bloom=None) -> DataFrame:
    """Filters of each segment (``shard, size, stream``), one for each ``range``: the
    first ``prefix`` bits of the keys."""
    schema = T.StructType.fromDDL(_FILTER)
    arrow, half = to_arrow_schema(schema), quotient.half_bits(bits)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                numbers = _unpacked(batch.column("stream")[i].as_py(), batch.column("size")[i].as_py())
                made = _phrases(numbers, bits, None if bloom is None else bloom.value)
                cut = [(r, quotient.write(*keys, half, prefix)) for r, *keys in quotient.cut(*made, half, prefix)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r for r, _ in cut], pa.int64()),
                    pa.array([batch.column("shard")[i].as_py()] * len(cut), pa.int64()),
                    pa.array([f for _, f in cut], pa.binary()),
                ], schema=arrow)

    return streams.mapInArrow(giving_back(run), schema)


def _merged(filters: DataFrame, shards: int, bits: int, prefix: int, least: int | None) -> DataFrame:
    """The filters of up to 2^FAN_BITS shards as one, cut by ``prefix`` bits; with
    ``least``, the phrases of at least so many occurrences instead."""
    schema = T.StructType.fromDDL(_FILTER if least is None else _PHRASE)
    arrow, half = to_arrow_schema(schema), quotient.half_bits(bits)
    parts = int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = filters.withColumn("shard", F.pmod(F.col("shard"), F.lit(shards)))
    dealt = grouped.repartition(parts, "range", "shard").sortWithinPartitions("range", "shard")

    def result(shard: int, keys):
        if least is None:
            cut = [(r, quotient.write(*part, half, prefix)) for r, *part in quotient.cut(*keys, half, prefix)]
            columns = [[r for r, _ in cut], [shard] * len(cut), [f for _, f in cut]]
        else:
            high, low, counts = keys
            often = counts >= least
            words = quotient.unpack(*quotient.restore(high[often], low[often], half), bits)
            columns = [*(w.astype(np.int64) for w in words), counts[often]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        group, held, waiting, size = None, None, [], 0

        def joined():
            return quotient.merge([*([held] if held else []), *waiting], half)

        for batch in batches:
            for where, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (where, shard):
                    if group is not None:
                        yield result(group[1], joined())
                    group, held, waiting, size = (where, shard), None, [], 0
                waiting.append(quotient.read(data))
                size += len(waiting[-1][0])
                if size > RANGE_KEYS and size > (len(held[0]) if held else 0):
                    held, waiting, size = joined(), [], 0
        if group is not None:
            yield result(group[1], joined())

    return dealt.mapInArrow(giving_back(run), schema)


def _bits(n: int) -> int:
    return max(n - 1, 0).bit_length()


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text"):
    """(vocabulary, phrases of two words, of three words, totals), written tables.

    ``vocabulary``: ``number, lang, word, f`` of the words of ``least`` occurrences.
    Phrases: ``first, second, third, a``, word numbers and occurrences of every phrase
    of ``least`` occurrences; ``first`` is 0 in phrases of two words.
    ``totals``: ``lang, n``, all word occurrences.
    """
    given = docs.select(
        F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(column(text_col), F.lit("")).cast("binary").alias("text"),
    )
    written = freeze(_segments(given), "segments")
    words = written.where("local is not null")
    streams = written.where("stream is not null").select("segment", "size", "stream")
    totals = freeze(words.groupBy("lang").agg(F.sum("n").alias("n")), "language-sizes")
    everywhere = Window.partitionBy("lang", "word")
    often = freeze(
        words.select("segment", "local", "lang", "word", F.sum("n").over(everywhere).alias("f")).where(F.col("f") >= least),
        "frequent-words",
    )
    numbered = numbered_rows(often.select("lang", "word", "f").distinct(), ["lang", "word"], "number")
    vocabulary = freeze(numbered.withColumn("number", F.col("number") + 1), "vocabulary")

    bits = max(vocabulary.count().bit_length(), 1)
    if bits > 32:
        raise ValueError("more than 2^32 frequent words")
    pairs = often.join(vocabulary.select("lang", "word", "number"), ["lang", "word"]).groupBy("segment").agg(
        F.collect_list(F.struct("local", "number")).alias("pairs")
    )
    streams = freeze(_renumbered(streams.join(pairs, "segment")), "streams")
    shape = streams.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    two = _frequent(streams, *shape, bits, least)
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(two, bits))
    three = _frequent(streams, *shape, bits, least, bloom)
    words = vocabulary.withColumn("word", F.col("word").cast("string"))
    return words, two, three, totals


def _frequent(streams: DataFrame, shards: int, keys: int, bits: int, least: int, bloom=None) -> DataFrame:
    """The phrases of ``least`` occurrences: filters merged and cut, round after round."""
    parts = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(max(_bits(keys // RANGE_KEYS + 1), _bits(4 * parts)), quotient.half_bits(bits), 30)
    prefix = min(FAN_BITS, wanted)
    filters = _counted(streams, bits, prefix, bloom)
    while shards > 1 << FAN_BITS or prefix < wanted:
        shards = -(-shards >> FAN_BITS)
        prefix = min(prefix + FAN_BITS, wanted)
        filters = freeze(_merged(filters, shards, bits, prefix, None), "filters")
    return freeze(_merged(filters, 1, bits, wanted, least), "phrases")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^15."""
    wide = lambda c: c.cast(T.DecimalType(19, 0))
    above = (F.lit(1_000_000).cast(T.DecimalType(7, 0)) * wide(a)).cast(T.DecimalType(26, 0)) * wide(a)
    return F.call_function("div", above.cast(T.DecimalType(38, 0)), (wide(left) * wide(right)).cast(T.DecimalType(38, 0)))


def _cut_scores(two: DataFrame, three: DataFrame, vocabulary: DataFrame, share: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of all phrases that stay."""
    word = lambda name, text, f: vocabulary.select(
        F.col("number").alias(name), F.col("word").alias(text), F.col("f").alias(f)
    )
    lang = vocabulary.select(F.col("number").alias("x"), "lang")
    two = two.select(F.col("second").alias("x"), F.col("third").alias("y"), "a")
    three = three.select(F.col("first").alias("x"), F.col("second").alias("y"), F.col("third").alias("z"), "a")
    two = freeze(
        two.join(word("x", "wx", "fx"), "x").join(word("y", "wy", "fy"), "y").join(lang, "x"), "pairs-of-words"
    )

    held = three.select("x", "y", "a").unionByName(three.select(F.col("y").alias("x"), F.col("z").alias("y"), "a"))
    held = held.groupBy("x", "y").agg(F.max("a").alias("longer"))
    free = two.join(held, ["x", "y"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    short = free.select(
        "lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"),
        score(F.col("a"), F.col("fx"), F.col("fy")).alias("score"),
    )

    head = two.select("x", "y", "lang", "wx", "fx", F.col("a").alias("axy"))
    tail = two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("wx").alias("wy"), F.col("wy").alias("wz"),
                      F.col("fy").alias("fz"), F.col("a").alias("ayz"))
    parts = three.join(head, ["x", "y"]).join(tail, ["y", "z"])
    cuts = [
        F.struct(score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"),
                 F.col(left).alias("l"), F.col(right).alias("r"))
        for k, (left, right) in enumerate((("fx", "ayz"), ("axy", "fz")), 1)
    ]
    long = parts.withColumn("cut", F.least(*cuts)).select(
        "lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
    )
    return short.unionByName(long)


def collocations(
    docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of
    two or three words by score, then occurrences, then bytes.

    A-Z become lower case; pieces end at ``. , ; : ! ?`` and line ends, words at spaces
    and tabs. ``a`` counts a phrase within pieces, overlaps included, ``l`` and ``r`` its
    parts at the cut with the least score (ties: the shorter first part), ``n`` all words
    of the language. A phrase goes if a phrase of three words that holds it has ``share``
    percent of its occurrences or more, whether or not that one is returned.

    A null language is ``und``, a null or empty text has no words. Rows that repeat count
    each time. An empty table, or one without frequent phrases, gives no rows. Other
    columns are left behind. Texts of any length pass; a text is never cut.
    """
    if least < 1:
        raise ValueError("phrases occur once at least")
    vocabulary, two, three, totals = phrase_counts(docs, least, lang_col, text_col)
    ranked = _cut_scores(two, three, vocabulary, share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    final = best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return final.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
