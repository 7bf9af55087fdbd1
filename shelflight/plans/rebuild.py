"""Index builds that embed only new texts, and readers that never see half a build.

Every build is a folder of its own with index, lookup and metadata. A small record that
names the folder is put in place last, by one rename; readers follow the newest record,
so a build that ends halfway leaves the last one as it was. Vectors are known by the hash
of their text: a rebuild takes those of the last build (of the same model) and calls the
model for the other texts only.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflight.functions.phonetic import METAPHONE, PhoneticEncoder
from shelflight.operators.checks import meta_record, require_consistent_vectors
from shelflight.operators.embedding import HashedNGrams, embed_table
from shelflight.plans.index_build import lookup_columns, lookup_export, prepare_catalog
from shelflight.sources.catalog import catalog_head, dealt_out
from shelflight.sources.sinks import freeze, read_index, write_index, write_lookup, write_meta

_RECORDS = "records"


@dataclass(frozen=True)
class Build:
    """One finished build: its folder, and the model that its vectors come from."""

    folder: str
    model: str

    @property
    def index(self) -> str:
        return f"{self.folder}/index"

    @property
    def lookup(self) -> str:
        return f"{self.folder}/lookup"

    @property
    def meta(self) -> str:
        return f"{self.folder}/meta"


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's, whatever the scheme."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _records(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, path) of the records, oldest first."""
    files, place = _files(spark, f"{path}/{_RECORDS}")
    if not files.exists(place):
        return []
    found = [status.getPath() for status in files.listStatus(place)]
    return sorted((f.getName(), f.toString()) for f in found if f.getName().endswith(".json"))


def builds(spark: SparkSession, path: str) -> list[Build]:
    """All finished builds below ``path``, oldest first."""
    made = []
    for name, place in _records(spark, path):
        record = json.loads("".join(r.value for r in spark.read.text(place).collect()))
        made.append(Build(f"{path}/{record['folder']}", record["model"]))
    return made


def current_build(spark: SparkSession, path: str) -> Build | None:
    """The newest finished build, or None."""
    found = builds(spark, path)
    return found[-1] if found else None


def read_catalog_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the newest finished build below ``path``."""
    build = current_build(spark, path)
    if build is None:
        raise ValueError(f"no finished build below {path}")
    return read_index(spark, build.index)


def _publish(spark: SparkSession, path: str, folder: str, model: str) -> None:
    """Put the record of a build in place, complete and at once."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    files, parent = _files(spark, f"{path}/{_RECORDS}")
    files.mkdirs(parent)
    _, hidden = _files(spark, f"{path}/{_RECORDS}/_{name}")
    out = files.create(hidden, False)
    out.write(bytearray(json.dumps({"folder": folder, "model": model}).encode()))
    out.close()
    _, final = _files(spark, f"{path}/{_RECORDS}/{name}.json")
    if not files.rename(hidden, final):
        raise OSError(f"cannot put the record {final} in place")


def _vectors(prepared: DataFrame, embedder, last: Build | None) -> DataFrame:
    """``text_key, embedding`` of every distinct text, new ones from the model."""
    texts = prepared.select("text_key", "search_text").dropDuplicates(["text_key"])
    if last is None or last.model != embedder.name:
        return embed_table(texts, "search_text", embedder).select("text_key", "embedding")
    kept = read_index(prepared.sparkSession, last.index).select("text_key", "embedding")
    known = freeze(
        kept.join(texts, "text_key", "left_semi").groupBy("text_key").agg(F.first("embedding").alias("embedding")),
        "known-vectors",
    )
    new = texts.join(known, "text_key", "left_anti")
    return known.unionByName(embed_table(new, "search_text", embedder).select("text_key", "embedding"))


def rebuild_catalog_index(
    raw: DataFrame, path: str, embedder=None, max_rows: int | None = None, null_text: str = "nan",
    phonetic: PhoneticEncoder = METAPHONE,
) -> DataFrame:
    """Build index, lookup and metadata as ``build_catalog_index`` does, as a new build
    below ``path``, and return its index.

    Texts of the last build keep their vectors if the embedder has the same ``name``. The
    index has one more column, ``text_key``, the hash of the embedded text. The vectors are
    checked before anything is published.
    """
    spark = raw.sparkSession
    embedder = embedder or HashedNGrams()
    prepared = freeze(
        prepare_catalog(dealt_out(catalog_head(raw, max_rows)), null_text, phonetic).withColumn(
            "text_key", F.sha2("search_text", 256)
        ), "prepared-catalog",
    )
    vectors = freeze(_vectors(prepared, embedder, current_build(spark, path)), "text-vectors")
    staged = freeze(lookup_columns(prepared.join(vectors, "text_key"), "text_key", "embedding"), "staged-index")
    found = require_consistent_vectors(staged)
    folder = f"build-{uuid.uuid4().hex}"
    build = Build(f"{path}/{folder}", embedder.name)
    write_index(staged, build.index)
    index = read_index(spark, build.index)
    write_lookup(lookup_export(index), build.lookup)
    write_meta(meta_record(spark, found, embedder.name), build.meta)
    _publish(spark, path, folder, embedder.name)
    return index


def drop_old_builds(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` builds: the record first, then the folder, so no
    reader that starts later can meet a folder that is going. Readers of older builds
    must have ended."""
    if keep < 1:
        raise ValueError("the newest build stays")
    old = list(zip(_records(spark, path), builds(spark, path)))[:-keep]
    for (_, record), build in old:
        for place in (record, build.folder):
            files, where = _files(spark, place)
            files.delete(where, True)
