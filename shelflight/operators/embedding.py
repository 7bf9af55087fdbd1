"""Text -> vector as a Spark job."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class HashedNGrams:
    """Built-in embedder: hashed character n-grams, scaled to unit length.

    Runs in the JVM on the row's own partition. Texts shorter than ``n``
    characters have no n-gram and get the zero vector.
    """

    dim: int = 64
    n: int = 3
    name: str = "hashed-ngrams"
    distinct_texts: bool = False

    def __call__(self, df: DataFrame, text: str, output: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        stages = Pipeline(
            stages=[
                RegexTokenizer(inputCol=text, outputCol="_chars", pattern="", minTokenLength=1),
                NGram(n=self.n, inputCol="_chars", outputCol="_grams"),
                HashingTF(numFeatures=self.dim, inputCol="_grams", outputCol="_counts"),
                Normalizer(inputCol="_counts", outputCol="_unit"),
            ]
        )
        return (
            stages.fit(df)
            .transform(df)
            .withColumn(output, vector_to_array("_unit", dtype="float32"))
            .drop("_chars", "_grams", "_counts", "_unit")
        )


@dataclass(frozen=True)
class ModelEmbedder:
    """An external model: ``load()`` runs once per task and returns a function
    from a list of texts to a list of vectors. Worth calling once per text.

    ``concurrency`` calls of up to ``texts_per_call`` texts (None: an Arrow batch) are in
    flight in each task, so a remote model is waited for in parallel; the function must
    then bear several threads. Results keep their order, a task holds no more than the
    window's texts, and after the first error no further call is made.
    """

    load: Callable[[], Callable[[list[str]], list]]
    name: str = "external"
    distinct_texts: bool = True
    concurrency: int = 1
    texts_per_call: int | None = None

    def __call__(self, df: DataFrame, text: str, output: str) -> DataFrame:
        load, concurrency, size = self.load, self.concurrency, self.texts_per_call
        if concurrency < 1 or (size is not None and size < 1):
            raise ValueError("concurrency and texts_per_call must be at least 1")

        def embed(frames):
            model = load()
            dim = None
            parts = _parts(frames, size)
            calls = ((part, part[text].tolist()) for part in parts)
            for frame, made in _in_window(model, calls, concurrency):
                vectors = [list(map(float, v)) for v in made]
                if len(vectors) != len(frame):
                    raise ValueError("the model returned another number of vectors than texts")
                for vector in vectors:
                    dim = dim or len(vector)
                    if not vector or len(vector) != dim:
                        raise ValueError(f"vector of length {len(vector)}, expected {dim}")
                yield frame.assign(**{output: vectors})

        schema = T.StructType(list(df.schema.fields)).add(output, T.ArrayType(T.FloatType()))
        return df.mapInPandas(embed, schema)


def _parts(frames: Iterator, size: int | None) -> Iterator:
    """Frames cut to ``size`` rows."""
    for frame in frames:
        for at in range(0, len(frame), size or max(len(frame), 1)):
            yield frame.iloc[at:at + (size or len(frame))]


def _in_window(model: Callable, calls: Iterator, width: int) -> Iterator:
    """(item, ``model(argument)``) of (item, argument), in order, ``width`` calls at once."""
    if width == 1:
        for item, argument in calls:
            yield item, model(argument)
        return
    window: deque = deque()
    pool = ThreadPoolExecutor(width)
    try:
        for item, argument in calls:
            if len(window) == width:
                done, future = window.popleft()
                yield done, future.result()
            for _, future in window:
                if future.done() and future.exception() is not None:
                    future.result()
            window.append((item, pool.submit(model, argument)))
        while window:
            done, future = window.popleft()
            yield done, future.result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


def embed_table(df: DataFrame, text: str, embedder, output: str = "embedding") -> DataFrame:
    """Add a vector per row; an empty or missing text is an error.

    An embedder that asks for ``distinct_texts`` sees each text once; the
    vectors are joined back by text, so identity never depends on row order.
    """
    present = F.coalesce(F.col(text) != "", F.lit(False))
    checked = df.withColumn(
        text,
        F.when(present, F.col(text)).otherwise(
            F.raise_error(F.lit("text must be a non-empty string")).cast("string")
        ),
    )
    if not embedder.distinct_texts:
        return embedder(checked, text, output)
    vectors = embedder(checked.select(text).distinct(), text, output)
    return checked.join(vectors, text).select(*df.columns, output)
