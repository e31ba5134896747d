"""A corpus of documents as DataFrames: one per step from bytes to glyphs. A bad document is a row with an error."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.functions.fonts import page_fonts
from foliant.functions.text import readable_date
from foliant.operators.content import Font, Interpreter, category, tokenize
from foliant.operators.spatial import flipped, unit_square_box
from foliant.sources.objects import Document, FormatError, Ref, Stream, Text, as_json, number

_BAD = (FormatError, ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError, OverflowError, MemoryError)


def files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """file_id, path, length, modified, content; filters on path, length and time reach the listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return found.select(F.sha2("path", 256).alias("file_id"), "path", "length", F.col("modificationTime").alias("modified"), "content")


#: Rows of one batch that leaves a worker.
ROWS = 4096


def _each(df: DataFrame, read, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows of ``read`` by file, as they come; an error on the way is the file's last row, what came before stays."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows(file_id: str, content: bytes | None) -> Iterator[dict]:
        try:
            for row in read(content or b""):
                yield {"file_id": file_id} | row
        except _BAD as error:
            yield {"file_id": file_id, "error": f"{type(error).__name__}: {error}"}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):  # one file at a time: whole files travel
                found = rows(part.column(0)[k].as_py(), part.column(1)[k].as_py())
                while some := list(islice(found, ROWS)):
                    yield from pa.Table.from_pylist(some, arrow).to_batches()

    return df.select("file_id", "content").mapInArrow(batches, schema)


def xref_sections(df: DataFrame) -> DataFrame:
    """All cross-reference entries, sections oldest first."""

    def read(data: bytes) -> list[dict]:
        doc = Document.of(data)
        return [
            {"section_ord": i, "section_offset": s.offset, "obj_num": e.obj_num, "offset": e.offset, "generation": e.generation, "in_use": e.in_use, "compressed": e.stream_obj_num is not None, "stream_obj_num": e.stream_obj_num, "index_in_stream": e.index_in_stream}
            for i, s in enumerate(doc.sections) for e in s.entries
        ]

    return _each(df, read, "file_id string, section_ord int, section_offset long, obj_num long, offset long, generation int, in_use boolean, compressed boolean, stream_obj_num long, index_in_stream int, error string")


def objects(df: DataFrame) -> DataFrame:
    """Every object in use, its value as VARIANT; streams also raw and decoded."""

    def read(data: bytes) -> list[dict]:
        doc, out = Document.of(data), []
        for n, e in doc.xref().items():
            if not e.in_use:
                continue
            row = {"obj_num": n, "gen_num": e.generation}
            try:
                value = doc.resolve(Ref(n, e.generation))
                row |= {"obj_type": type(value).__name__, "value": json.dumps(as_json(value))}
                if isinstance(value, Stream):
                    row |= {"stream_raw": value.raw, "stream_decoded": doc.decoded(value)}
            except _BAD as error:
                row["error"] = f"{type(error).__name__}: {error}"
            out.append(row)
        return out

    found = _each(df, read, "file_id string, obj_num long, gen_num int, obj_type string, value string, stream_raw binary, stream_decoded binary, error string")
    return found.withColumn("value", F.try_parse_json("value"))


def pages(df: DataFrame) -> DataFrame:
    """Pages in document order with size and content."""

    def read(data: bytes) -> list[dict]:
        doc, out = Document.of(data), []
        for i, (number, page, held) in enumerate(doc.pages()):
            width, height = doc.box(held)
            row = {"page_idx": i, "obj_num": number, "width": width, "height": height}
            try:
                row["content"] = doc.content(page)
            except _BAD as error:
                row["error"] = f"{type(error).__name__}: {error}"
            out.append(row)
        return out

    return _each(df, read, "file_id string, page_idx int, obj_num long, width double, height double, content binary, error string")


def _by_page(doc: Document, rows) -> Iterator[dict]:  # noqa: ANN001
    """The rows of each page, with page_idx; a page that cannot be read is one row with an error, and its neighbours stay."""
    for i, (_, page, held) in enumerate(doc.pages()):
        try:
            found = list(rows(page, held))
        except _BAD as error:
            found = [{"error": f"{type(error).__name__}: {error}"}]
        yield from ({"page_idx": i} | r for r in found)


def fonts(df: DataFrame) -> DataFrame:
    """Fonts by page and resource name."""

    def read(data: bytes) -> Iterator[dict]:
        doc = Document.of(data)

        def rows(page: dict, held: dict) -> Iterator[dict]:
            for f in page_fonts(doc, held.get("Resources")).values():
                yield {"font_name": f.name, "base_font": f.base_font, "subtype": f.subtype, "encoding": f.encoding_name, "is_embedded": f.is_embedded, "is_cid": f.is_cid, "has_tounicode": f.to_unicode is not None, "default_width": f.default_width}

        return _by_page(doc, rows)

    return _each(df, read, "file_id string, page_idx int, font_name string, base_font string, subtype string, encoding string, is_embedded boolean, is_cid boolean, has_tounicode boolean, default_width double, error string")


def page_operators(df: DataFrame) -> DataFrame:
    """Content operators in order, with the bytes they came from."""

    def read(data: bytes) -> Iterator[dict]:
        doc = Document.of(data)

        def rows(page: dict, held: dict) -> Iterator[dict]:
            for k, op in enumerate(tokenize(doc.content(page))):
                yield {"op_idx": k, "name": op.name, "category": category(op.name), "operands": json.dumps(as_json(op.operands)), "raw": op.raw, "byte_offset": op.byte_offset, "inline_data": op.inline_data}

        return _by_page(doc, rows)

    found = _each(df, read, "file_id string, page_idx int, op_idx int, name string, category string, operands string, raw binary, byte_offset long, inline_data binary, error string")
    return found.withColumn("operands", F.try_parse_json("operands"))


def glyphs(df: DataFrame) -> DataFrame:
    """Positioned glyphs with their characters: content folded with the page's fonts."""

    def read(data: bytes) -> Iterator[dict]:
        doc = Document.of(data)

        def rows(page: dict, held: dict) -> Iterator[dict]:
            known = page_fonts(doc, held.get("Resources"))
            fold = Interpreter({n: Font(f.widths, f.default_width, f.bytes_per_char) for n, f in known.items()})
            for g in fold.run(tokenize(doc.content(page))):
                font = known.get(g["font_name"])
                yield g | {"char": font.decode(g["char_code"]) if font else chr(g["char_code"])}

        return _by_page(doc, rows)

    return _each(df, read, "file_id string, page_idx int, char_seq int, char_code int, char string, x double, y double, width double, font_size double, font_name string, fill_color array<double>, matrix array<double>, op_idx int, error string")


def images(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Images that pages place by name: file_id, page_idx, image_idx, id, name, op_idx, matrix, pixel_width, pixel_height, x0, x1, y0, y1, error.

    The box is that of the unit square under the matrix, from the top left, at a scale. Names that
    are no image of the page's resources (forms, unknown ones) and images inside the content are left
    out; an image placed twice is two rows. A page that cannot be read is a row with an error.
    """

    def read(data: bytes) -> Iterator[dict]:
        doc = Document.of(data)

        def rows(page: dict, held: dict) -> Iterator[dict]:
            resources = doc.resolve(held.get("Resources"))
            known = doc.resolve(resources.get("XObject")) if isinstance(resources, dict) else None
            fold, place = Interpreter({}), 0
            fold.run(tokenize(doc.content(page)))
            for at in fold.placed:
                found = doc.resolve(known.get(at["name"])) if isinstance(known, dict) else None
                if isinstance(found, Stream) and doc.resolve(found.info.get("Subtype")) == "Image":
                    pixels = (number(doc.resolved(found.info), side) for side in ("Width", "Height"))
                    yield at | {"image_idx": place, "page_height": doc.box(held)[1]} | dict(zip(("pixel_width", "pixel_height"), pixels, strict=True))
                    place += 1

        return _by_page(doc, rows)

    found = _each(df, read, "file_id string, page_idx int, image_idx int, name string, op_idx int, matrix array<double>, pixel_width double, pixel_height double, page_height double, error string")
    left, low, right, high = unit_square_box([F.col("matrix")[i] for i in range(6)])
    (x0, y1), (x1, y0) = (flipped(x, y, F.col("page_height"), F.lit(scale)) for x, y in ((left, low), (right, high)))
    box = [c.alias(n) for n, c in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1))]
    return found.select("file_id", "page_idx", "image_idx", F.concat(F.lit("ib_"), F.col("image_idx").cast("string")).alias("id"), "name", "op_idx", "matrix", "pixel_width", "pixel_height", *box, "error")


def metadata(df: DataFrame) -> DataFrame:
    """Document properties: one row per file, field and value of the Info dictionary, dates also in readable form.

    A field that is no text is left out; a file without the dictionary has no rows.
    """

    def read(data: bytes) -> Iterator[dict]:
        doc = Document.of(data)
        info = doc.resolve(doc.trailer.get("Info"))
        for field, value in (info if isinstance(info, dict) else {}).items():
            value = doc.resolve(value)
            if isinstance(value, Text):
                raw = value.raw
                yield {"field": str(field), "value": raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")}

    found = _each(df, read, "file_id string, field string, value string, error string")
    return found.withColumn("date", F.when(F.col("value").rlike(r"^D:[0-9]{14}"), readable_date(F.col("value"))))


def revised(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Files with their edits applied, each one row: file_id, content (the bytes with a new revision), n_edits, error.

    ``edits``: file_id, page_idx, edit_ord, op_indices (array of ints), new_text. As in
    :func:`foliant.operators.rewrite.apply_edits`, an edit's text goes to its first operator and its others
    become empty; of edits of one operator the last by edit_ord counts. A file without edits keeps
    its bytes. A file that cannot be read or has no such page is a row with an error and its old bytes.
    """
    from foliant.operators import rewrite

    own = edits.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "edit_ord", "op_indices", "new_text"))).alias("edits"))
    schema = "file_id string, content binary, n_edits int, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def save(data: bytes, found: list[dict]) -> bytes:
        for page_idx in sorted({e["page_idx"] for e in found}):
            doc = Document.of(data)
            _, page, held = doc.pages()[page_idx]
            operators, known, font, in_force = list(tokenize(doc.content(page))), page_fonts(doc, held.get("Resources")), None, []
            for op in operators:
                if op.name == "Tf" and op.operands:
                    font = known.get(str(op.operands[0]))
                in_force.append(font)
            some = [e for e in found if e["page_idx"] == page_idx]
            if any(not 0 <= k < len(operators) for e in some for k in e["op_indices"]):
                raise IndexError("an edit of an operator that the page does not have")
            data = rewrite.save_page(data, page_idx, rewrite.apply_edits(operators, [(e["op_indices"], e["new_text"] or "", in_force[min(e["op_indices"])]) for e in some if e["op_indices"]]))
        return data

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                file_id, content, found = (c[k].as_py() for c in part.columns)
                row = {"file_id": file_id, "content": content, "n_edits": len(found or [])}
                try:
                    if found:
                        row["content"] = save(content or b"", found)
                except _BAD as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                yield from pa.Table.from_pylist([row], arrow).to_batches()

    return df.select("file_id", "content").join(own, "file_id", "left").select("file_id", "content", "edits").mapInArrow(batches, schema)


def text_blocks(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """From files to text blocks in reading order."""
    from foliant.operators import layout

    chars = glyphs(df).where("error is null")
    return layout.text_blocks(layout.grouped(layout.placed(chars, pages(df).where("error is null"), scale)))
