"""Edits to page content, and new revisions of a document's bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.fonts import PageFont, reverse_map
from foliant.operators.content import Operator
from foliant.sources.objects import Document, Name, Ref, Text, last_xref


# serialising


def escape_literal(raw: bytes) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", raw)


def serialize_operand(value: Any) -> bytes:
    """Operand bytes; dictionaries, streams and references have none in content."""
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if value is None:
        return b"null"
    if isinstance(value, Text):
        return b"<" + value.raw.hex().encode() + b">" if value.hexadecimal else b"(" + escape_literal(value.raw) + b")"
    if isinstance(value, Name):
        return b"/" + value.encode("latin-1")
    if isinstance(value, (int, float)):
        return (str(int(value)) if float(value).is_integer() else repr(float(value))).encode()
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialize_operand, value)) + b"]"
    return b""


def serialize_object(value: Any) -> bytes:
    """An object of a file: operands, and also dictionaries and references."""
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    if isinstance(value, dict):
        return b"<< " + b" ".join(b"/" + k.encode("latin-1") + b" " + serialize_object(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialize_object, value)) + b"]"
    return serialize_operand(value)


def serialize_operators(operators: Iterable[Operator]) -> bytes:
    """Untouched operators keep their bytes; each ends its line."""
    return b"".join((b" ".join([*map(serialize_operand, op.operands), op.name.encode()]) if op.modified else op.raw) + b"\n" for op in operators)


# edits


def encode_text(text: str, font: PageFont | None) -> Text:
    """Text as a string of the font; characters it has no code for are dropped, a space always has one."""
    if font is None:
        return Text(bytes(ord(c) & 0xFF for c in text))
    known = reverse_map(font.to_unicode if font.to_unicode is not None else font.encoding)
    plain = not font.to_unicode and not font.encoding and not font.is_cid
    out = bytearray()
    for c in text:
        code = known.get(c, 32 if c == " " else ord(c) if plain and ord(c) < 256 else None)
        if code is not None:
            out += code.to_bytes(2, "big") if font.is_cid else bytes([code & 0xFF])
    return Text(bytes(out), font.is_cid)


def apply_edits(operators: list[Operator], edits: Iterable[tuple[Iterable[int], str, PageFont | None]]) -> list[Operator]:
    """Each edit gives its first operator all the text and empties its others; a later edit of an operator counts."""
    new: dict[int, Text] = {}
    for indices, text, font in edits:
        for place, index in enumerate(sorted(set(indices))):
            new[index] = encode_text("" if place else text, font)
    out = []
    for i, op in enumerate(operators):
        out.append(Operator("Tj", [new[i]], op.raw, op.byte_offset, True) if i in new else op)
    return out


def new_block(text: str, x: float, y: float, size: float = 16.0, font_name: str = "F1", font: PageFont | None = None, page_height: float = 792.0) -> list[Operator]:
    """Operators that draw one line of text whose box begins at (x, y) from the top; the size is set once."""
    baseline = page_height - (y + 0.85 * size)
    parts: list[tuple[str, list[Any]]] = [("BT", []), ("Tf", [Name(font_name), size]), ("Tm", [1, 0, 0, 1, x, baseline]), ("Tj", [encode_text(text, font)]), ("ET", [])]
    return [Operator(name, operands, b"", 0, True) for name, operands in parts]


def overlay_operators(page_ops: DataFrame, edits: DataFrame) -> DataFrame:
    """The same over a corpus: ``page_ops`` (file_id, page_idx, op_idx, text, ...) with the texts of ``edits``
    (file_id, page_idx, edit_ord, op_indices, new_text). Adds modified."""
    key = ["file_id", "page_idx"]
    places = edits.select(*key, "edit_ord", "new_text", F.posexplode(F.array_sort(F.array_distinct("op_indices"))).alias("place", "op_idx"))
    texts = places.select(*key, "op_idx", "edit_ord", F.when(F.col("place") == 0, F.col("new_text")).otherwise("").alias("new"))
    latest = texts.groupBy(*key, "op_idx").agg(F.max_by("new", "edit_ord").alias("new"))
    joined = page_ops.join(latest, [*key, "op_idx"], "left")
    return joined.withColumn("modified", F.col("new").isNotNull()).withColumn("text", F.coalesce("new", "text")).drop("new")


# revisions


def incremental_update(data: bytes, changed: dict[int, bytes], info: Ref | None = None) -> bytes:
    """The bytes with a new revision: changed objects, their cross-references and a trailer that points at the last ones."""
    doc = Document.of(data)
    out, offsets = bytearray(data), {}
    if not data.endswith(b"\n"):
        out += b"\n"
    for number in sorted(changed):
        offsets[number] = len(out)
        out += b"%d 0 obj\n" % number + changed[number] + b"\nendobj\n"
    at = len(out)
    out += b"xref\n"
    numbers = sorted(offsets)
    runs = _runs(numbers)
    for run in runs:
        out += b"%d %d\n" % (run[0], len(run))
        out += b"".join(b"%010d %05d n \n" % (offsets[n], 0) for n in run)
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "Encrypt", "ID")}
    trailer["Size"] = max(int(doc.trailer.get("Size", 0)), max(changed, default=-1) + 1)
    trailer["Prev"] = last_xref(data)
    if info is not None:
        trailer["Info"] = info
    out += b"trailer\n" + serialize_object(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def _runs(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][-1] == n - 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def stream_object(data: bytes, info: dict[str, Any] | None = None) -> bytes:
    return serialize_object((info or {}) | {"Length": len(data)}) + b"\nstream\n" + data + b"\nendstream"


def save_page(data: bytes, page_idx: int, operators: list[Operator]) -> bytes:
    """A revision in which the page has these operators. The first content stream takes them all, others become empty."""
    doc = Document.of(data)
    _, page, _ = doc.pages()[page_idx]
    contents = page.get("Contents")
    refs = [contents] if isinstance(contents, Ref) and not isinstance(doc.resolve(contents), list) else doc.resolve(contents)
    if not refs or not all(isinstance(r, Ref) for r in refs):
        raise ValueError("the page has no content stream of its own")
    changed = {r.num: stream_object(b"") for r in refs}
    changed[refs[0].num] = stream_object(serialize_operators(operators))
    return incremental_update(data, changed)


def info_dictionary(fields: dict[str, str]) -> bytes:
    """Document properties; empty ones are left out."""

    def text(value: str) -> bytes:
        return b"(" + escape_literal(value.encode()) + b")" if value.isascii() else b"<feff" + value.encode("utf-16-be").hex().encode() + b">"

    return b"<< " + b" ".join(b"/" + k.encode() + b" " + text(v) for k, v in fields.items() if v) + b" >>"


def revision_history(revisions: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` revisions of each file, numbered from the newest."""
    w = Window.partitionBy("file_id").orderBy(F.col("rev").desc())
    return revisions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
