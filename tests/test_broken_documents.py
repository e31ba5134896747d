"""Broken files are error rows, a bad page leaves its neighbours, and files go through edits to new bytes."""

import zlib

import pytest

from foliant.functions import fonts
from foliant.sources import codecs, documents
from foliant.sources.objects import Document, FormatError
from tests.documents import FONT, classic, one_page, stream, xref_stream

FILES = "file_id string, content binary"


def two_pages(first: bytes, second: bytes, info: bytes = b"") -> bytes:
    page = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>"
    return classic({
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /Resources << /Font << /F1 5 0 R >> >> /MediaBox [0 0 612 792] >>",
        3: page % 4, 4: stream(first), 5: FONT, 6: page % 7, 7: stream(second, info), 8: b"<< /Title (A \\(b\\)) /Author <feff00e9> /CreationDate (D:20240102030405Z) /N 3 >>",
    }, extra=b"/Info 8 0 R")


SHOW = b"BT /F1 12 Tf 10 700 Td (%s) Tj ET"


def test_one_bad_page(spark):
    df = spark.createDataFrame([("a", two_pages(SHOW % b"one", SHOW % b"two", b"/Filter /Nothing")), ("b", b"no file"), ("c", None)], FILES)
    got = documents.glyphs(df).collect()
    assert "".join(r.char for r in got if r.file_id == "a" and r.error is None) == "one"
    assert [(r.page_idx, "Nothing" in r.error) for r in got if r.file_id == "a" and r.error] == [(1, True)]
    assert [r.error is not None for r in got if r.file_id != "a"] == [True, True]
    assert [r.text for r in documents.text_blocks(df).collect()] == ["one"]
    assert documents.glyphs(df.limit(0)).collect() == []


def test_streams_end():
    whole = zlib.compress(b"some words " * 50)
    assert codecs.flate(whole) == b"some words " * 50 and codecs.flate(whole + b"tail") == b"some words " * 50
    for broken in (whole[: len(whole) // 2], b"x" + whole):
        with pytest.raises(codecs.CodecError):
            codecs.flate(broken)


def test_too_much(monkeypatch):
    monkeypatch.setattr(codecs, "LARGEST", 100)
    with pytest.raises(codecs.CodecError):
        codecs.flate(zlib.compress(bytes(101)))
    assert codecs.flate(zlib.compress(bytes(100))) == bytes(100)


def test_tables_end():
    good = xref_stream(SHOW % b"x")
    assert len(Document.of(good).xref()) == 8
    with pytest.raises(FormatError):
        Document.of(good.replace(b"/Size 8 /W", b"/Size 9999999 /W"))
    with pytest.raises(ValueError):
        fonts.cid_widths([0, 2_000_000_000, 500])
    assert fonts.cid_widths([0, 0x10FFFF, 500])[0x10FFFF] == 500


def test_operands_next_to_the_operator(spark):
    df = spark.createDataFrame([("a", one_page(b"BT /F1 12 Tf 10 700 Td true (a) Tj ET"))], FILES)
    assert [r.char for r in documents.glyphs(df).collect()] == ["a"]


def test_metadata(spark):
    df = spark.createDataFrame([("a", two_pages(b"", b"")), ("b", one_page(b"")), ("c", b"?")], FILES)
    got = {(r.file_id, r.field): (r.value, r.date) for r in documents.metadata(df).where("error is null").collect()}
    assert got == {("a", "Title"): ("A (b)", None), ("a", "Author"): ("é", None), ("a", "CreationDate"): ("D:20240102030405Z", "2024/01/02 03:04:05")}
    assert documents.metadata(df).where("error is not null").select("file_id").collect()[0][0] == "c"


def test_revised(spark):
    """Edits of a block over two operators, of two pages, of none, and of what is not there."""
    two = b"BT /F1 12 Tf 10 700 Td (Hello) Tj 0 -14 Td (World) Tj ET"
    files = [("a", two_pages(two, SHOW % b"page")), ("b", one_page(SHOW % b"kept")), ("c", one_page(SHOW % b"x")), ("d", b"no file")]
    edits = [("a", 0, 0, [3, 5], "Old"), ("a", 0, 1, [5, 3], "Hi Earth"), ("a", 1, 0, [3], "Leaf"), ("c", 4, 0, [3], "y"), ("d", 0, 0, [1], "z")]
    df = spark.createDataFrame(files, FILES)
    new = documents.revised(df, spark.createDataFrame(edits, "file_id string, page_idx int, edit_ord int, op_indices array<int>, new_text string"))
    got, old = {r.file_id: r for r in new.collect()}, dict(files)
    assert {k: r.n_edits for k, r in got.items()} == {"a": 3, "b": 0, "c": 1, "d": 1}
    assert bytes(got["a"].content).startswith(old["a"]) and all(bytes(got[k].content) == old[k] for k in "bcd")
    assert got["a"].error is None and got["b"].error is None and got["c"].error and got["d"].error
    ops = documents.page_operators(new.where("file_id = 'a'").select("file_id", "content")).where("name = 'Tj'").orderBy("page_idx", "op_idx").collect()
    assert [bytes(r.raw) for r in ops] == [b"(Hi Earth) Tj", b"() Tj", b"(Leaf) Tj"]
