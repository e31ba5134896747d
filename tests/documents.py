"""Writes small documents from scratch, with known glyph positions."""

import zlib


def classic(objects: dict[int, bytes], root: int = 1, extra: bytes = b"") -> bytes:
    """A file with a classic cross-reference table."""
    out, offsets = bytearray(b"%PDF-1.7\n"), {}
    for number, body in objects.items():
        offsets[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    at, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 %s \n" % (offsets.get(n, 0), b"n" if n in offsets else b"f")
    out += b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, extra, at)
    return bytes(out)


def stream(data: bytes, info: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(data), info) + data + b"\nendstream"


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>"


def one_page(content: bytes, font: bytes = FONT, info: bytes = b"", extra: dict[int, bytes] | None = None) -> bytes:
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        4: stream(content, info),
        5: font,
    }
    return classic(objects | (extra or {}))


def xref_stream(content: bytes) -> bytes:
    """A file whose objects 1, 2, 3 and 5 lie in an object stream, with a predicted cross-reference stream."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /MediaBox [0 0 200 100] /Resources << /Font << /F1 5 0 R >> >> >>", 5: FONT}
    body, heads = b"", b""
    for n, x in inner.items():
        heads += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(heads + body)
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, x in ((4, stream(zlib.compress(content), b"/Filter /FlateDecode")), (6, stream(packed, b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(heads)))):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    place = len(out)
    rows = [(0, 0, 0), (2, 6, 0), (2, 6, 1), (2, 6, 2), (1, at[4], 0), (2, 6, 3), (1, at[6], 0), (1, place, 0)]
    raw = [bytes([k]) + a.to_bytes(3, "big") + bytes([b]) for k, a, b in rows]
    predicted, above = b"", bytes(5)
    for r in raw:
        predicted += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True))
        above = r
    out += b"7 0 obj\n" + stream(zlib.compress(predicted), b"/Type /XRef /Size 8 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >>") + b"\nendobj\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % place
