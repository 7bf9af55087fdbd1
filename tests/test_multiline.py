"""CSV with line breaks in cells: the rows of a plain reader, whatever the splits are."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

import shelflight as sl
from shelflight.sources.multiline import multi_line_records

HEADER = ["brand_sku_id", "product_name", "brand_name", "category_name"]
CELLS = ["a", "x,y", 'say "hi"', "one\ntwo", "\n\n", 'a "\n" b', ",", "é漢", "  padded ", '"', "\nlast", "1\n2\n3\n4", "0"]


def written(path, rows, line_end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerow(HEADER)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def random_rows(draw, n):
    return [[draw.choice(CELLS) + str(i), *(draw.choice(CELLS) for _ in range(3))] for i in range(n)]


@pytest.fixture
def splits(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def found(spark, path):
    rows = sl.scan_csv(spark, str(path), multi_line=True).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(rows)))
    return [[r[c] for c in HEADER] for r in rows]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [7, 40, 1000, 1 << 27])
def test_rows_for_every_split_size(spark, tmp_path, splits, seed, size):
    draw = random.Random(seed)
    tables = [random_rows(draw, draw.randrange(1, 12)) for _ in range(2)]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(tables):
        written(folder / f"part-{i}.csv", rows, draw.choice(["\n", "\r\n"]))
    splits(size)
    assert found(spark, folder) == [row for rows in tables for row in rows]


def test_one_file_is_several_tasks(spark, tmp_path, splits):
    rows = random_rows(random.Random(9), 400)
    written(tmp_path / "one.csv", rows)
    splits(1500)
    records = multi_line_records(spark, str(tmp_path / "one.csv"))
    assert records.select("_block").distinct().count() > 5
    assert found(spark, tmp_path / "one.csv") == rows


def test_a_cell_longer_than_many_splits(spark, tmp_path, splits):
    rows = [["1", "\n".join(f'line "{i}"' for i in range(300)), "b", "c"], ["2", "x", "y", "z"]]
    written(tmp_path / "long.csv", rows)
    splits(64)
    assert found(spark, tmp_path / "long.csv") == rows


@pytest.mark.parametrize("size", [30, 1 << 27])
def test_an_open_quote_fails(spark, tmp_path, splits, size):
    written(tmp_path / "open.csv", random_rows(random.Random(1), 8))
    with open(tmp_path / "open.csv", "a") as out:
        out.write('9,"never closed,b,c\n10,a,b,c\n')
    splits(size)
    with pytest.raises(Exception, match="a quote is open at the end of"):
        sl.scan_csv(spark, str(tmp_path / "open.csv"), multi_line=True).collect()


def test_blank_lines_and_files_without_rows(spark, tmp_path, splits):
    (tmp_path / "blank.csv").write_text(",".join(HEADER) + '\n\n1,"\n",b,c\n  \n2,a,b,c\n\n')
    splits(9)
    assert found(spark, tmp_path / "blank.csv") == [["1", "\n", "b", "c"], ["2", "a", "b", "c"]]
    (tmp_path / "none.csv").write_text(",".join(HEADER) + "\n")
    assert found(spark, tmp_path / "none.csv") == []
    assert sl.scan_csv(spark, str(tmp_path / "blank.csv"), 1, True).select(F.max("row_id")).first()[0] == 0
