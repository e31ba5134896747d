import pytest

from foliant.operators import blocks, layout
from foliant.sources import documents, sinks
from foliant.sources.objects import Document, FormatError, Name, Ref, array, name, number, reference
from tests.documents import one_page, stream, classic, FONT

CHARS = "file_id string, page_idx int, block_idx int, seq long, char string, x double, y double, width double, font_size double, font_name string, fill_color array<double>, op_idx int"
BLOCKS = "file_id string, page_idx int, block_idx int, id string, op_idx int, text string, x0 double, x1 double, y0 double, y1 double, font_name string, font_size double, color array<double>, n_chars long, extra string"
SELECTED = "file_id string, page_idx int, merge_id int, block_idx int, place int"


def _page(spark, texts, page=0):
    """Blocks of (text, x, y, size), chars 5 wide; op_idx is ten times the place."""
    chars, boxes = [], []
    for i, (text, x, y, size) in enumerate(texts):
        chars += [("f", page, i, k, c, x + 5.0 * k, y, 5.0, size, f"F{i}", [0.0, 0.0, float(i)], 10 * i) for k, c in enumerate(text)]
        boxes.append(("f", page, i, f"tb_{i}", 10 * i, text, x, x + 5.0 * len(text), y - 0.85 * size, y + 0.15 * size, f"F{i}", size, [0.0, 0.0, float(i)], len(text), "z"))
    return spark.createDataFrame(boxes, BLOCKS), spark.createDataFrame(chars, CHARS)


def _brute(texts, places):
    """The merge by hand: an insertion sort under the tolerance, spaces behind the last char."""
    order = []
    for i in places:
        k = len(order)
        while k and _less(texts[i], texts[order[k - 1]]):
            k -= 1
        order.insert(k, i)
    out = []
    for n, i in enumerate(order):
        if n and out:
            c, x, w, size, op = out[-1]
            out.append((" ", x + w, size * 0.3, size, op))
        out += [(c, texts[i][1] + 5.0 * k, 5.0, texts[i][3], 10 * i) for k, c in enumerate(texts[i][0])]
    return out


def _less(a, b):
    down = (a[2] - 0.85 * a[3]) - (b[2] - 0.85 * b[3])
    return down < 0 if abs(down) > 2 else a[1] < b[1]


TEXTS = [("World", 60.0, 101.0, 10.0), ("Hello", 10.0, 100.0, 10.0), ("", 5.0, 140.0, 10.0), ("low", 0.0, 150.0, 20.0), ("top", 0.0, 20.0, 10.0), ("right", 200.0, 100.0, 10.0)]


@pytest.mark.parametrize("places", [[0, 1], [1, 0], [3, 2, 1, 0], [2, 3], [0, 1, 2, 3, 4, 5]])
def test_merged_chars(spark, places):
    boxes, chars = _page(spark, TEXTS)
    selected = spark.createDataFrame([("f", 0, 7, b, i) for i, b in enumerate(places)] + [("f", 0, 7, places[0], 99), ("f", 0, 7, 55, 5), ("f", 0, 8, 4, 0)], SELECTED)
    found = blocks.merged_chars(boxes, chars, selected).orderBy("seq").collect()
    assert {r.merge_id for r in found} == {7}
    expected = _brute(TEXTS, places)
    assert [(r.char, r.width, r.font_size, r.op_idx) for r in found] == [(c, w, s, o) for c, _, w, s, o in expected]
    assert [r.x for r in found] == pytest.approx([x for _, x, _, _, _ in expected])
    block = blocks.merged_blocks(boxes, chars, selected).collect()[0]
    real = [r for r in found if not r.synthetic]
    assert block.text == "".join(r.char for r in found) and block.font_name == real[0].font_name and block.color == real[0].fill_color
    assert block.op_indices == sorted({r.op_idx for r in real}) and block.x1 == pytest.approx(max(r.x + r.width for r in found))


def test_merge_in_place(spark):
    boxes, chars = _page(spark, TEXTS)

    def after(*merges):
        selected = spark.createDataFrame([("f", 0, m, b, i) for m, bs in enumerate(merges) for i, b in enumerate(bs)], SELECTED)
        return [(r.id, r.text) for r in blocks.with_merges(boxes, chars, selected).orderBy("block_idx").collect()]

    # the first that lies lower, or in the row further right, is the empty block
    assert after([0, 1]) == [("tb_6", "Hello World"), ("tb_2", ""), ("tb_3", "low"), ("tb_4", "top"), ("tb_5", "right")]
    assert after([4, 3]) == [("tb_6", "top low"), ("tb_0", "World"), ("tb_1", "Hello"), ("tb_2", ""), ("tb_5", "right")]
    # the empty block's top is within the tolerance of the low one's, which is further left; nothing lies lower
    assert after([2, 3])[-1] == ("tb_6", "low ")
    assert after([0]) == [(f"tb_{i}", t[0]) for i, t in enumerate(TEXTS)]
    assert after([0, 1], [4, 3]) == [("tb_6", "Hello World"), ("tb_7", "top low"), ("tb_2", ""), ("tb_5", "right")]
    none = spark.createDataFrame([], SELECTED)
    assert blocks.with_merges(boxes, chars, none).count() == 6 and blocks.merged_blocks(boxes, chars, none).count() == 0
    assert blocks.with_merges(boxes.limit(0), chars.limit(0), none).count() == 0


def test_blocks_without_chars(spark):
    boxes, chars = _page(spark, [("", 1.0, 10.0, 10.0), ("", 2.0, 50.0, 10.0)])
    row = blocks.merged_blocks(boxes, chars, spark.createDataFrame([("f", 0, 0, 0, 0), ("f", 0, 0, 1, 1)], SELECTED)).collect()[0]
    assert (row.text, row.x0, row.x1, row.y0, row.y1, row.font_name, row.color, row.op_indices, row.n_chars) == ("", 0, 0, 0, 0, "", [0, 0, 0], [], 0)
    clicks = spark.createDataFrame([("f", 0, 100.0, 200.0, 20.0, "F1"), ("f", 0, None, None, None, None)], "file_id string, page_idx int, x double, y double, font_size double, font_name string")
    new = blocks.empty_blocks(clicks).collect()
    assert (new[0].x0, new[0].x1, new[0].y0, new[0].y1, new[0].is_new, new[0].text) == (100, 300, 183, 207, True, "") and new[1].x0 is None


def test_cursors(spark):
    _, chars = _page(spark, [("abc", 0.0, 10.0, 10.0)])  # centres at 2.5, 7.5, 12.5, all at height 15
    at = [(0, -9.0, 15.0, 0), (1, 2.5, 15.0, 0), (2, 2.6, 15.0, 1), (3, 5.0, 15.0, 1), (4, 99.0, 0.0, 3), (5, 7.0, 900.0, 1), (6, None, 1.0, 0)]
    points = spark.createDataFrame([(k, "f", 0, 0, x, y) for k, x, y, _ in at] + [(7, "f", 0, 5, 1.0, 1.0), (8, None, None, None, 1.0, 1.0)], "k int, file_id string, page_idx int, block_idx int, x double, y double")
    found = {r.k: r.cursor for r in blocks.cursors(points, chars, "k", ["file_id", "page_idx", "block_idx"]).collect()}
    assert found == {k: c for k, _, _, c in at} | {7: 0, 8: 0}


def test_from_files_to_merged_revision(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(one_page(b"BT /F1 10 Tf 50 700 Td (Hello) Tj 100 0 Td (World) Tj 0 -200 Td (Far) Tj ET"))
    df = documents.files(spark, str(tmp_path))
    rows = layout.grouped(layout.placed(documents.glyphs(df).where("error is null"), documents.pages(df)))
    boxes, chars = layout.text_blocks(rows), layout.block_chars(rows)
    assert chars.count() == 13 and [r.text for r in boxes.orderBy("block_idx").collect()] == ["Hello", "World", "Far"]
    selected = boxes.where("block_idx < 2").selectExpr("file_id", "page_idx", "0 AS merge_id", "block_idx", "-block_idx AS place")
    made = blocks.merged_blocks(boxes, chars, selected)
    assert made.select("text").collect()[0].text == "Hello World"
    edits = made.selectExpr("file_id", "page_idx", "0 AS edit_ord", "op_indices", "'Hi all' AS new_text")
    out = str(tmp_path / "out" / "deep")
    saved = sinks.write_files(documents.revised(df, edits), out).collect()
    assert len(saved) == 1 and saved[0].error is None
    again = documents.text_blocks(documents.files(spark, out)).orderBy("block_idx").collect()
    assert [r.text for r in again] == ["Hi all", "Far"]


def test_write_files(spark, tmp_path):
    rows = [("a", b"one"), ("b", b""), (None, b"x"), ("c", None), ("../d", b"y"), ("", b"z")]
    df = spark.createDataFrame(rows, "n string, b binary")
    for _ in range(2):
        found = sinks.write_files(df, str(tmp_path / "out"), "n", "b", ".bin").collect()
        assert sorted(r.file for r in found if r.error is None) == ["a.bin", "b.bin"] and len(found) == 6
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a.bin": b"one", "b.bin": b""}
    assert sinks.write_files(df.limit(0), str(tmp_path / "none"), "n", "b").count() == 0


def test_images(spark, tmp_path):
    content = b"q 200 0 0 100 50 600 cm /Im1 Do Q q 0 50 -20 0 300 300 cm /Im1 Do /Fm Do /No Do Q /Odd gs Do"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 2 /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /Im1 5 0 R /Fm 6 0 R >> >> >>", 4: stream(content),
        5: stream(b"\0" * 12, b"/Type /XObject /Subtype /Image /Width 2 /Height 7 0 R"), 6: stream(b"", b"/Subtype /Form"), 7: b"4", 8: b"<< /Type /Page /Parent 2 0 R /Contents 1 0 R >>",
    }
    (tmp_path / "a.pdf").write_bytes(classic(objects))
    found = documents.images(documents.files(spark, str(tmp_path)), 2.0).orderBy("page_idx", "image_idx").collect()
    assert [(r.id, r.name, r.pixel_width, r.pixel_height, r.x0, r.x1, r.y0, r.y1) for r in found[:2]] == [("ib_0", "Im1", 2, 4, 100, 500, 184, 384), ("ib_1", "Im1", 2, 4, 560, 600, 884, 984)]
    assert len(found) == 3 and found[2].page_idx == 1 and found[2].error


def test_typed_values():
    values = {"N": 3, "F": 1.5, "R": Ref(1), "A": [1], "S": Name("x"), "B": True, "Z": None}
    assert (number(values, "N"), number(values, "F"), reference(values, "R"), array(values, "A"), name(values, "S")) == (3, 1.5, Ref(1), [1], "x")
    for get, wrong in ((number, "R"), (number, "B"), (number, "Z"), (reference, "N"), (array, "S"), (name, "A")):
        assert get(values, "None") is None
        with pytest.raises(FormatError):
            get(values, wrong)
    assert Document.of(one_page(b"", FONT)).resolved({"a": Ref(99), "b": 1}) == {"a": None, "b": 1}
