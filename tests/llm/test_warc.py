"""WARC records in ZIP archives: round trips, and ZIP files of other writers."""

import base64
import hashlib
import io
import struct
import zipfile

import pytest

from shelflight.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def ranges(data):
    return lambda offset, length: data[offset:offset + length]


def read_back(spark, tmp_path, rows, name="w", **options):
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as payload")
    return warc.read_archives(warc.write_archives(pages, str(tmp_path / name), **options)).collect()


def test_given_table(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, f"file:{tmp_path}/a")).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    first = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    for r in rows:
        got, origin = found[r.page_id], first[r.html or ""]
        assert (got.url, got.payload_bytes, got.payload_digest) == (r.url, len(r.html.encode()), digest(r.html))
        same = r.page_id == origin
        assert (got.record_type, got.refers_to) == (("response", None) if same else ("revisit", origin))
        assert (bytes(got.payload) == r.html.encode()) if same else got.payload is None


def test_edge_cases(spark, tmp_path):
    rows = [
        (3, "http://a", "same"), (1, None, "same"), (2, "x\r\ny: z", "same"), (1, "http://b", "same"),
        (None, "n", "same"), (4, "u", None), (5, "u", ""), (None, "u", "lone"), (6, "u", "\r\n\r\n" * 3),
        (7, "u", "é" * 400_000), (None, "v", "pair"), (None, "v", "pair"),
    ]
    found = read_back(spark, tmp_path, rows)
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)
    kind = {(3, "same"): 1, (2, "same"): 1, (None, "same"): 1, (5, ""): 4}
    expected = [
        (p, digest(h), *(("revisit", kind[p, h]) if (p, h) in kind else ("response", None))) for p, _, h in rows
    ]
    assert got == sorted(expected, key=repr)
    assert {r.payload_bytes for r in found if r.page_id == 7} == {800_000}
    assert [r.url for r in found if r.page_id == 2] == ["x y: z"]
    assert read_back(spark, tmp_path, [], "none") == []


def test_least_bytes_and_rolled_archives(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "tiny" if i % 2 else "large enough") for i in range(20)]
    found = read_back(spark, tmp_path, rows, least_bytes=5)
    kinds = {r.page_id: r.record_type for r in found}
    assert [p for p, k in kinds.items() if k == "response"].sort() == [0, *range(1, 20, 2)].sort()
    assert sum(k == "revisit" for k in kinds.values()) == 9


@pytest.mark.parametrize("comment", [b"", b"a comment", b"PK\x05\x06" + b"x" * 40])
def test_members_of_a_plain_zip(comment):
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("a", b"first")
        z.writestr("dir/b", b"second" * 100)
        z.writestr(zipfile.ZipInfo("packed"), b"no" * 50, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    data = file.getvalue()
    members = warc.stored_members(ranges(data), len(data))
    assert {n: data[o:o + s] for n, (o, s) in members.items()} == {"a": b"first", "dir/b": b"second" * 100}


def test_zip64_directory(monkeypatch):
    """Small files whose fields claim to overflow, as the writer does past 4 GB."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", allowZip64=True) as z:
        z.writestr("a", b"x" * 50)
        z.writestr("b", b"y" * 70)
    data = file.getvalue()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    members = warc.stored_members(ranges(data), len(data))
    assert {n: data[o:o + s] for n, (o, s) in members.items()} == {"a": b"x" * 50, "b": b"y" * 70}


def test_damage_is_reported():
    with pytest.raises(ValueError):
        warc.stored_members(ranges(b"no zip at all"), 13)
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("a", b"first")
    data = bytearray(file.getvalue())
    data[struct.unpack_from("<I", data, len(data) - 6)[0]] = 0
    with pytest.raises(ValueError):
        warc.stored_members(ranges(bytes(data)), len(data))
    record = warc.warc_record(1, "u", b"body", digest("body"), False, None)
    assert warc.parse_record(record)[3] == 4
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"body", b"bodx"))


def test_archive_is_a_readable_zip(spark, sf, tmp_path):
    made = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), str(tmp_path / "z")).collect()
    for row in made:
        with zipfile.ZipFile(row.path) as z:
            assert z.testzip() is None
            assert {warc.DATA, warc.INDEX, "datapackage.json"} == set(z.namelist())
