"""Concurrent embedding, and rebuilds that embed only what is new."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

import shelflight as sl
from shelflight.operators.embedding import _in_window
from shelflight.plans import rebuild
from tests.conftest import rows_of

RAW = "row_id long, brand_sku_id string, product_name string, brand_name string, category_name string"


class Slow:
    """Counts calls in flight; the first ones take longest."""

    def __init__(self, fails=()):
        self.lock, self.now, self.most, self.calls, self.fails = threading.Lock(), 0, 0, [], fails

    def __call__(self, number):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.calls.append(number)
        time.sleep(0.05 if number % 4 == 0 else 0.01)
        with self.lock:
            self.now -= 1
        if number in self.fails:
            raise RuntimeError(f"call {number}")
        return number * 10


@pytest.mark.parametrize("width", [1, 2, 4])
def test_window_of_calls(width):
    model, taken = Slow(), []

    def calls():
        for i in range(40):
            taken.append(i)
            yield f"item {i}", i

    for i, (item, made) in enumerate(_in_window(model, calls(), width)):
        assert (item, made) == (f"item {i}", 10 * i)  # in order
        assert len(taken) <= i + 1 + width  # no more than the window is held
    assert model.most == width and sorted(model.calls) == list(range(40))


@pytest.mark.parametrize("width", [1, 3])
def test_no_call_after_an_error(width):
    model = Slow(fails={6})
    with pytest.raises(RuntimeError, match="call 6"):
        list(_in_window(model, ((i, i) for i in range(100)), width))
    assert max(model.calls) <= 6 + 2 * width and model.now == 0


def logged_model(folder, dim=3):
    """A model that leaves a file for each text it embeds."""
    def load():
        def embed(texts):
            time.sleep(0.01)
            for text in texts:
                with open(os.path.join(folder, f"{time.time_ns()}-{threading.get_ident()}"), "w") as out:
                    out.write(text)
            return [[float(len(t)), float(sum(map(ord, t)) % 97), 1.0][:dim] for t in texts]
        return embed
    return load


def texts_of(folder):
    made = sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    for f in os.listdir(folder):
        os.truncate(os.path.join(folder, f), 0)
    return [t for t in made if t]


def catalog(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", p, b, "food") for i, (p, b) in enumerate(rows)], RAW)


ROWS = [("sauce", "acme"), ("rice", "bolt"), ("sauce", "acme"), ("tea", None), ("oil", "3m")]


def test_concurrent_embedder_equals_single_calls(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(120)], "id long, t string")
    load = logged_model(str(tmp_path))
    one, many = (
        rows_of(sl.embed_table(df, "t", sl.ModelEmbedder(load, concurrency=n, texts_per_call=s)))
        for n, s in ((1, None), (4, 3))
    )
    assert one == many and len(one) == 120
    with pytest.raises(ValueError):
        sl.embed_table(df, "t", sl.ModelEmbedder(load, concurrency=0))


def test_unchanged_catalog_is_not_embedded_again(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    path = f"{tmp_path}/catalog"
    embedder = sl.ModelEmbedder(logged_model(str(log)), "model-1", concurrency=2, texts_per_call=1)
    first = rows_of(sl.rebuild_catalog_index(catalog(spark, ROWS), path, embedder))
    assert texts_of(log) == ["3m oil food", "acme sauce food", "bolt rice food", "nan tea food"]
    again = sl.rebuild_catalog_index(catalog(spark, ROWS), path, embedder)
    assert texts_of(log) == [] and rows_of(again) == first
    plain = sl.build_catalog_index(catalog(spark, ROWS), f"{tmp_path}/plain", embedder)
    texts_of(log)
    assert rows_of(again.drop("text_key")) == rows_of(plain)

    changed = [*ROWS[:1], ("rice", "new"), *ROWS[2:4]]
    third = rows_of(sl.rebuild_catalog_index(catalog(spark, changed), path, embedder).drop("text_key"))
    assert texts_of(log) == ["new rice food"]
    assert third == rows_of(sl.build_catalog_index(catalog(spark, changed), f"{tmp_path}/changed", embedder))
    texts_of(log)
    other = sl.ModelEmbedder(logged_model(str(log), dim=2), "model-2")
    sl.rebuild_catalog_index(catalog(spark, changed), path, other)
    assert len(texts_of(log)) == 3  # another model embeds all texts
    assert [b.model for b in rebuild.builds(spark, path)] == ["model-1"] * 3 + ["model-2"]


def test_a_build_that_ends_halfway_leaves_the_last_one(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/catalog"
    with pytest.raises(ValueError):
        sl.read_catalog_index(spark, path)
    sl.rebuild_catalog_index(catalog(spark, ROWS), path)
    before = rebuild.current_build(spark, path)
    for step in ("write_lookup", "write_meta", "_publish"):
        with monkeypatch.context() as broken:
            broken.setattr(rebuild, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                sl.rebuild_catalog_index(catalog(spark, ROWS[:2]), path)
        assert rebuild.current_build(spark, path) == before
        assert sl.read_catalog_index(spark, path).count() == len(ROWS)
    sl.rebuild_catalog_index(catalog(spark, ROWS[:2]), path)
    now = rebuild.current_build(spark, path)
    assert now != before and sl.read_catalog_index(spark, path).count() == 2
    assert spark.read.json(now.lookup).count() == 2 and spark.read.json(now.meta).first().num_items == 2
    sl.rebuild_catalog_index(catalog(spark, ROWS), path)
    rebuild.drop_old_builds(spark, path, keep=1)
    assert len(rebuild.builds(spark, path)) == 1 and sl.read_catalog_index(spark, path).count() == len(ROWS)
    assert not os.path.exists(now.folder)


def test_empty_texts_and_empty_catalogs(spark, tmp_path):
    blank = catalog(spark, [("", "")]).withColumn("category_name", F.lit(""))
    with pytest.raises(Exception, match="non-empty"):
        sl.rebuild_catalog_index(blank, f"{tmp_path}/blank", null_text="")
    assert rebuild.current_build(spark, f"{tmp_path}/blank") is None
