import base64
import zlib

import pytest

from foliant.functions import crypto, fonts
from foliant.operators import layout, rewrite
from foliant.operators.content import Font, Interpreter, Operator, category, tokenize
from foliant.sources import codecs, documents
from foliant.sources.objects import Document, FormatError, Lexer, Name, Ref, Text, Word
from tests.documents import FONT, classic, one_page, stream, xref_stream


# codecs


def test_filters():
    data = bytes(range(256)) * 3
    assert codecs.decode(zlib.compress(data), "FlateDecode") == data
    assert codecs.decode(base64.a85encode(b"hello\0\0\0\0!") + b"~>", "A85") == b"hello\0\0\0\0!"
    assert codecs.ascii_hex(b"48 65 6C6c 7>zz") == b"Hell\x70"
    assert codecs.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD"
    assert codecs.decode(zlib.compress(data).hex().encode() + b">", ["AHx", "Fl"]) == data
    assert codecs.decode(b"x", ["DCTDecode"]) == b"x" and codecs.decode(b"", "Odd") == b""
    for bad in (lambda: codecs.decode(b"x", "Odd"), lambda: codecs.flate(b"xx"), lambda: codecs.ascii_hex(b"4g"), lambda: codecs.ascii_85(b"ab\x7f"), lambda: codecs.ascii_85(b"abz")):
        with pytest.raises(codecs.CodecError):
            bad()


def _lzw(data: bytes, early: int) -> bytes:
    table, out, width, bits, n = {bytes([i]): i for i in range(256)}, [], 9, 0, 258
    out.append((256, 9))
    w = b""
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        out.append((table[w], width))
        if n < 4096:
            table[w + bytes([b])] = n
            n += 1
        width = min(12, max(9, (n - 1 + early).bit_length()))
        w = bytes([b])
    if w:
        out.append((table[w], width))
        n += 1
        width = min(12, max(9, (n - 1 + early).bit_length()))
    out.append((257, width))
    for code, size in out:
        bits = bits << size | code
    total = sum(size for _, size in out)
    pad = -total % 8
    return (bits << pad).to_bytes((total + pad) // 8, "big")


@pytest.mark.parametrize("early", [0, 1])
def test_lzw(early):
    data = b"abracadabra " * 200 + bytes(range(256)) * 2
    assert codecs.lzw(_lzw(data, early), early) == data


# objects


def test_lexer():
    def read(x):
        return Lexer(x).token()

    assert read(b"/A#42c") == Name("ABc") and read(b"(a(b)\\)\\101\\n\\x)").raw == b"a(b))A\nx" and read(b"(a\\\nb") == Text(b"ab")
    assert read(b"<4 8 6>") == Text(b"H`", True) and read(b"12 0 R ") == Ref(12) and read(b"12 0 Rx") == 12 and read(b"-.5 ") == -0.5
    assert read(b"<< /A 1 /A [1 2 (x) null true] /B << /C /D >> >>") == {"A": [1, 2, Text(b"x"), None, True], "B": {"C": Name("D")}}
    assert read(b"% note\n 7") == 7 and read(b"obj") == Word("obj")
    for bad in (b"[1 2", b"<< /A 1", b"<< 1 2 >>"):
        with pytest.raises(FormatError):
            read(bad)


def _text(data: bytes) -> list[str]:
    doc = Document.of(data)
    return ["".join(chr(g["char_code"]) for g in Interpreter({}).run(tokenize(doc.content(page)))) for _, page, _ in doc.pages()]


def test_classic_and_stream_tables():
    assert _text(one_page(b"BT /F1 12 Tf (Hello) Tj ET")) == ["Hello"]
    data = xref_stream(b"BT (Packed) Tj ET")
    assert _text(data) == ["Packed"]
    assert Document.of(data).box(Document.of(data).pages()[0][2]) == (200.0, 100.0)


def test_broken_documents():
    for bad in (b"", b"%PDF", b"startxref\n0\n%%EOF", one_page(b"x")[:-30]):
        with pytest.raises(FormatError):
            Document.of(bad)
    circle = classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R 1 0 R] >>", 3: b"<< /Type /Page >>"})
    assert len(Document.of(circle).pages()) == 1
    assert Document.of(circle).resolve(Ref(99)) is None


def test_split_contents_and_indirect_length():
    data = classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents [4 0 R 5 0 R] >>", 4: b"<< /Length 6 0 R >>\nstream\nBT (endstream a\nendstream", 5: stream(b"b) Tj ET"), 6: b"15"})
    assert Document.of(data).content(Document.of(data).pages()[0][1]) == b"BT (endstream a b) Tj ET"


# content


def test_tokenize():
    ops = tokenize(b"BT /F1 12 Tf [(A) -20 <42>] TJ ] 5 q % note\n/x BMC true EI")
    assert [o.name for o in ops] == ["BT", "Tf", "TJ", "q", "BMC", "EI"]
    assert ops[1].operands == [Name("F1"), 12] and ops[2].operands == [[Text(b"A"), -20, Text(b"B", True)]]
    image = tokenize(b"q BI /W 2 /H 1 ID \x01EI\x02 EIx\n EI Q")
    assert [o.name for o in image] == ["q", "BI", "Q"] and image[1].inline_data == b"\x01EI\x02 EIx\n"
    assert category("Tj") == "text" and category("Do") == "xobject" and category("zz") == "other"


def _run(content: bytes, **font):
    return Interpreter({"F1": Font(**({"default_width": 500.0} | font))}).run(tokenize(content))


def test_positions():
    g = _run(b"BT /F1 10 Tf 1 Tc 2 Tw 100 700 Td (a b) Tj ET")
    assert [(x["x"], x["y"], x["width"]) for x in g] == [(100, 700, 6), (106, 700, 8), (114, 700, 6)]
    g = _run(b"BT /F1 10 Tf 50 Tz [(a) -200 (b)] TJ ET")
    assert [x["x"] for x in g] == [0, 3.5]
    g = _run(b"q 2 0 0 2 10 10 cm BT /F1 1 Tf 1 0 0 1 5 5 Tm 12 TL (a) Tj T* (b) ' 1 2 (c) \" ET Q BT (d) Tj ET")
    assert [(x["x"], x["y"]) for x in g] == [(20, 20), (20, -28), (20, -52), (0, 0)] and g[0]["font_size"] == 1
    g = _run(b"BT 0 1 0 0 k (a) Tj 0.5 g (b) Tj 1 0 0 rg (c) Tj Q (d) Tj ET")
    assert [x["fill_color"] for x in g] == [[1, 0, 1], [0.5] * 3, [1, 0, 0], [1, 0, 0]]
    assert [x["char_code"] for x in _run(b"BT /F1 1 Tf <00410042 43> Tj ET", bytes_per_char=2)] == [0x41, 0x42, 0x43]


# fonts


def test_font_tables():
    assert fonts.base_encoding("WinAnsiEncoding")[0x80] == "€" and fonts.base_encoding("MacRomanEncoding")[0x8E] == "é" and fonts.base_encoding("?") == fonts.base_encoding("WinAnsiEncoding")
    assert fonts.with_differences({}, [65, Name("eacute"), Name("odd.name"), Name("Zcaron"), 70, Name("uni00e9".upper().replace("UNI", "uni"))]) == {65: "é", 67: "Ž", 70: "é"}
    assert fonts.cid_widths([1, [500, 600], 10, 12, 700]) == {1: 500, 2: 600, 10: 700, 11: 700, 12: 700}
    assert fonts.simple_widths(32, [250, None, 300]) == {32: 250, 33: 0, 34: 300}
    cmap = fonts.parse_cmap(b"1 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar 2 beginbfrange <05> <07> <0061> <08> <09> [<0078> <0079007A>] endbfrange")
    assert cmap == {1: "A", 2: "😀", 5: "a", 6: "b", 7: "c", 8: "x", 9: "yz"}
    assert fonts.reverse_map({3: "a", 1: "a", 2: "bc"}) == {"a": 3}


# edits: the operators BT, Tj(Hello), Td, Tj(World), ET


def _ops(*texts):
    out = [Operator("BT", [], b"BT", 0)]
    for t in texts:
        out += [Operator("Tj", [Text(t)], b"(" + t + b") Tj", 0), Operator("Td", [0, 1], b"0 1 Td", 0)]
    return [*out[:-1], Operator("ET", [], b"ET", 0)]


@pytest.mark.parametrize(
    ("texts", "edits", "changed"),
    [
        ([b"Hello"], [([1], "Hallo")], {1: b"Hallo"}),
        ([b"Hello"], [([1], "Hi")], {1: b"Hi"}),
        ([b"Hi"], [([1], "Hello")], {1: b"Hello"}),
        ([b"Hello"], [([1], "XY")], {1: b"XY"}),
        ([b"Hello"], [([1], "")], {1: b""}),
        ([b"Hello", b"World"], [([1], "Hallo")], {1: b"Hallo"}),
        ([b"Hello", b"World"], [([1], "Hi"), ([3], "Earth")], {1: b"Hi", 3: b"Earth"}),
        ([b"Hello", b"World"], [([3, 1, 3], "Hi Earth")], {1: b"Hi Earth", 3: b""}),
        ([b"Hello"], [], {}),
    ],
)
def test_edits(texts, edits, changed):
    before = _ops(*texts)
    after = rewrite.apply_edits(before, [(i, t, None) for i, t in edits])
    for i, op in enumerate(after):
        assert op.modified == (i in changed)
        if i in changed:
            assert op.name == "Tj" and op.operands == [Text(changed[i])]
        else:
            assert op is before[i]
    if not changed:
        assert rewrite.serialize_operators(after) == b"BT\n(Hello) Tj\nET\n"


def test_serialize_round_trip():
    content = b"BT /F1 12.5 Tf [(a\\(b) -3 <41>] TJ true gs ET"
    ops = tokenize(content)
    again = tokenize(rewrite.serialize_operators([Operator(o.name, o.operands, b"", 0, True) for o in ops]))
    assert [(o.name, o.operands) for o in again] == [(o.name, o.operands) for o in ops]


def test_encode_text():
    font = fonts.PageFont("F1", is_cid=True, to_unicode={5: "a", 0x102: "b"})
    assert rewrite.encode_text("ab c", font) == Text(bytes([0, 5, 1, 2, 0, 32]), True)
    assert rewrite.encode_text("é€", fonts.PageFont("F1", encoding=fonts.base_encoding(""))) == Text(b"\xe9\x80")


def test_revisions_keep_all_edits():
    data = one_page(b"BT (one) Tj ET", extra={7: b"(seven)"})
    first = rewrite.save_page(data, 0, rewrite.apply_edits(tokenize(b"BT (one) Tj ET"), [([1], "two", None)]))
    second = rewrite.incremental_update(first, {7: b"(changed)", 9: rewrite.info_dictionary({"Title": "é", "Author": "(x)", "Subject": ""})}, Ref(9))
    doc = Document.of(second)
    assert second.startswith(data) and len(doc.sections) == 3 and _text(second) == ["two"]
    assert doc.resolve(Ref(7)) == Text(b"changed") and doc.resolve(doc.trailer["Info"]) == {"Title": Text(b"\xfe\xff\0\xe9", True), "Author": Text(b"(x)")}
    assert doc.trailer["Size"] == 10
    drawn = rewrite.new_block("Hi", 10, 20, 10)
    g = Interpreter({}).run(tokenize(rewrite.serialize_operators(drawn)))
    assert (g[0]["x"], round(g[0]["y"], 6), g[0]["font_size"]) == (10, 763.5, 10)


# passwords


def test_password_dictionary():
    found, file_id = crypto.password_dictionary("test", "", b"\xab" * 16)
    for part in (b"/Type /Encrypt", b"/Filter /Standard", b"/V 2", b"/R 3", b"/Length 128", b"/O <", b"/U <", b"/P "):
        assert part in found
    assert len(crypto.password_dictionary("hello")[1]) == 16 and file_id == b"\xab" * 16

    def field(name, *args):
        return crypto.password_dictionary(*args)[0].split(b"/" + name + b" <")[1].split(b">")[0]

    assert field(b"O", "password1", "", b"\1" * 16) != field(b"O", "password2", "", b"\1" * 16)
    assert field(b"U", "password1", "", b"\1" * 16) != field(b"U", "password2", "", b"\1" * 16)
    assert len(field(b"O", "test", "owner")) == 64 and len(field(b"U", "test", "owner")) == 64
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


# the corpus


def test_corpus(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(one_page(b"BT /F1 10 Tf 50 700 Td (Top line) Tj 0 -11 Td (next) Tj 0 -100 Td (Far) Tj 200 0 Td (  ) Tj ET"))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(xref_stream(b"BT /F1 10 Tf 5 5 Td (Z) Tj ET"))
    (tmp_path / "d.txt").write_bytes(b"no")
    df = documents.files(spark, str(tmp_path))
    assert df.count() == 3
    assert documents.pages(df).where("error is not null").count() == 1
    blocks = documents.text_blocks(df).orderBy("file_id", "block_idx").collect()
    texts = {}
    for b in blocks:
        texts.setdefault(b.file_id, []).append(b.text)
    assert sorted(texts.values()) == [["Top line", "next", "Far"], ["Z"]]
    top = next(b for b in blocks if b.text == "Top line")
    assert (top.x0, top.x1, top.y0, top.y1) == (50, 90, 92 - 8.5, 92 + 1.5) and top.id == "tb_0"
    assert documents.objects(df).where("obj_type = 'Stream' and stream_decoded is not null").count() >= 3
    assert documents.xref_sections(df).where("compressed").count() == 4
    assert documents.fonts(df).where("error is null").count() == 2
    assert documents.page_operators(df).where("category = 'text'").count() > 5
    rows = layout.grouped(layout.placed(documents.glyphs(df).where("error is null"), documents.pages(df)))
    assert {r.text.strip() for r in layout.words(rows).collect()} >= {"Top line", "next", "Z"}


def test_streamed_files(spark, tmp_path):
    from foliant.streaming import revisions

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(one_page(b"BT /F1 10 Tf 50 700 Td (A) Tj ET"))
    q = revisions.process(revisions.arriving(spark, str(source)), documents.text_blocks, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["A"]


def test_font_object():
    doc = Document.of(one_page(b"", FONT))
    found = fonts.page_fonts(doc, doc.pages()[0][2]["Resources"])["F1"]
    assert found.widths[32] == 500 and found.decode(0x41) == "A" and found.string_width("AB", 10) == 10 and found.encode("é") == 0xE9
