"""Secret scans through layers of encoding.

Base patterns are looked for in the text, and then in whatever its encoded parts decode to:
a worklist unwraps URL escapes, Unicode escapes, character references, base64 and
compressed bytes until nothing new appears. Each layer knows where its characters came from,
so a finding deep inside is reported as a span of the original text.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import in_parts

#: Kinds in order, their patterns and least lengths (of group 2 for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run shorter than 16 fails, and so does whatever starts later in it
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of these characters is one match; shorter ones fail

#: Bytes of a compressed layer that are held at once, and those that a part shares with the part before. A layer
#: that unfolds to more is read in parts, to its end; only an encoded block of more than ``SHARED`` inside of it may be cut.
UNFOLDED, SHARED = 1 << 26, 1 << 20

_VISIBLE = re.compile(r"[!-~]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that go on over line ends, as base64 is wrapped; or one run.
_BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+(?:(?:[ \t]*\r?\n[ \t]*)?=){0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"[ \t\r\n=]+")
#: How gzip and zlib headers look in base64.
_PACKED = re.compile(r"(?=H4sI|[CGKOSWae][A-P])")
#: Text among other bytes; the shortest secret has 14 characters.
_PIECE = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);")

#: What a text must hold for any of the above to find something; runs in the Arrow library.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&[#A-Za-z][0-9A-Za-z]*;|(?:[A-Za-z0-9+/_-](?:[ \t]*\r?\n[ \t]*)?){16}"""


@dataclass(frozen=True)
class Span:
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass(frozen=True)
class Same:
    """One number for every character, however many there are."""

    value: int

    def __getitem__(self, at: int) -> int:
        return self.value


@dataclass
class Layer:
    """Decoded text; ``begin`` and ``end`` give each character's span in the original."""

    text: str
    begin: list[int] | range | Same
    end: list[int] | range | Same


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text) else None


def _is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def _members(data: bytes) -> Iterator[bytes]:
    """Zlib or gzip contents of all members, in parts of at most ``UNFOLDED`` bytes; a broken member ends them with what it had."""
    while _is_packed(data):
        unpack, some = zlib.decompressobj(47), False
        while not unpack.eof:
            try:
                part = unpack.decompress(data, UNFOLDED)
            except zlib.error:
                return
            data = unpack.unconsumed_tail
            if not part and not data:
                break
            some = True
            yield part
        if not some and not unpack.eof:
            return
        data = unpack.unused_data


def _unfold(data: bytes) -> Iterator[bytes]:
    """The contents of compressed bytes, in parts of about ``UNFOLDED`` bytes that share ``SHARED`` bytes, so that what lies across a cut is whole in one of them."""
    held = bytearray()
    for part in _members(data):
        held += part
        if len(held) >= UNFOLDED:
            yield bytes(held)
            del held[:-SHARED]
    if held:
        yield bytes(held)


def _unfolded(data: bytes) -> Iterator[bytes]:
    """What compressed bytes hold at last: contents that are compressed in turn are unfolded too. One that holds itself ends there."""
    seen, work = set(), [data]
    while work:
        for part in _unfold(work.pop()):
            name = hashlib.blake2b(part, digest_size=16).digest()
            if name not in seen:
                seen.add(name)
                if _is_packed(part) and next(_members(part), None):
                    work.append(part)
                else:
                    yield part


def _begins_packed(data: bytes) -> bool:
    """Whether compressed bytes seem to begin here: most places that look so do not unfold at all."""
    if not _is_packed(data):
        return False
    try:
        zlib.decompressobj(47).decompress(data[:64], 1 << 12)
    except zlib.error:
        return False
    return True


def _escapes(layer: Layer, pattern: re.Pattern, a: int, b: int, decode) -> Layer | None:
    """The part a..b with each escape replaced; other characters keep their place."""
    text, begin, end, at = [], [], [], a
    mapped = not isinstance(layer.begin, Same)

    def plain(upto: int) -> None:
        text.append(layer.text[at:upto])
        if mapped:
            begin.extend(layer.begin[at:upto])
            end.extend(layer.end[at:upto])

    for m in pattern.finditer(layer.text, a, b):
        plain(m.start())
        new = decode(m)
        text.append(new)
        if mapped:
            begin += [layer.begin[m.start()]] * len(new)
            end += [layer.end[m.end() - 1]] * len(new)
        at = m.end()
    if at == a:
        return None
    plain(b)
    return Layer("".join(text), begin, end) if mapped else Layer("".join(text), layer.begin, layer.end)


_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode(errors="replace")


def _escape(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16))


def _entity(m: re.Match) -> str:
    return html.unescape(m[0])


def _bytes(core: str) -> bytes:
    """What base64 without breaks stands for; a character that is left over is ignored."""
    n = len(core) - (len(core) % 4 == 1)
    return base64.b64decode(core[:n].replace("-", "+").replace("_", "/") + "=" * (-n % 4))


def _pieces(data: bytes) -> Iterator[tuple[int, int, str]]:
    """The whole if it is readable, else each readable stretch of it: (start, end, text)."""
    if (whole := _readable(data)) is not None:
        yield 0, len(data), whole
        return
    for m in _PIECE.finditer(data):
        if (text := _readable(m[0])) is not None:
            yield m.start(), m.end(), text


def _block_layers(layer: Layer, m: re.Match, whole_read: bool) -> Iterator[Layer]:
    """What a block holds, wherever in it an encoding starts.

    Each of the four alignments is decoded over all lines and its readable stretches are
    layers; compressed bytes are unfolded from every place that looks like their header.
    ``whole_read``: the block is one run and a layer already, so its own start is left out.
    """
    core = _BREAK.sub("", m[0])
    if len(core) < 16:
        return
    places: list[int] = []

    def made(text: str, a: int, b: int) -> Layer:
        if not places:
            places.extend(i for i in range(m.start(), m.end()) if layer.text[i] not in " \t\r\n=")
        last = m.end() if b >= len(core) else places[b - 1] + 1
        return Layer(text, Same(layer.begin[places[a]]), Same(layer.end[last - 1]))

    for k in range(1 if whole_read else 0, 4):
        for a, b, text in _pieces(_bytes(core[k:])):
            yield made(text, k + a // 3 * 4, k + -(-b // 3) * 4)
    for found in _PACKED.finditer(core, 1 if whole_read else 0):
        k = found.start()
        if _begins_packed(_bytes(core[k : k + 64])):
            for data in _unfolded(_bytes(core[k:])):
                for _, _, text in _pieces(data):
                    yield made(text, k, len(core))


_BYTE_RUN = re.compile(r"(?=(%[89A-Fa-f][0-9A-Fa-f]|\\x[89A-Fa-f][0-9A-Fa-f]|\\u00[89A-Fa-f][0-9A-Fa-f]))")
_ONE_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|([\x00-\x7f])")
_HEADER = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78]")


def _packed_escapes(layer: Layer, a: int, b: int) -> Iterator[Layer]:
    """Compressed bytes written with escapes, within a run of visible characters."""
    found = list(_ONE_BYTE.finditer(layer.text, a, b))
    data = bytes(int(m[1] or m[2] or m[3], 16) if m[4] is None else ord(m[4]) for m in found)
    for head in _HEADER.finditer(data):
        k = head.start()
        if _begins_packed(data[k : k + 64]):
            for part in _unfolded(data[k:]):
                for _, _, text in _pieces(part):
                    yield Layer(text, Same(layer.begin[found[k].start()]), Same(layer.end[b - 1]))


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """For each kind of escapes the whole text without them, and each run of visible characters alone; one layer for each other encoded part.

    The whole text finds secrets of which only some characters are escaped. A run alone finds
    what another match, that begins before the run, would take in.
    """
    text = layer.text
    for pattern, decode, sign in ((_RUN, _percent, "%"), (_ESCAPE, _escape, "\\"), (_ENTITY, _entity, "&")):
        if sign in text:
            for a, b in ((0, len(text)), *(m.span() for m in _VISIBLE.finditer(text) if sign in m[0])):
                new = _escapes(layer, pattern, a, b, decode)
                if new is not None and new.text and new.text != text[a:b]:
                    yield new
    if _BYTE_RUN.search(text):
        for m in _VISIBLE.finditer(text):
            if _BYTE_RUN.search(m[0]):
                yield from _packed_escapes(layer, *m.span())
    read = set()
    for m in _BASE64.finditer(text):
        core = m[0].rstrip("=")
        if len(core) % 4 == 1:
            continue
        data = _bytes(core)
        texts = [x for x in [_readable(data)] if x is not None]
        if not texts and _begins_packed(data):
            texts = (x for part in _unfolded(data) for _, _, x in _pieces(part))
        for new in texts:
            read.add(m.span())
            yield Layer(new, Same(layer.begin[m.start()]), Same(layer.end[m.end() - 1]))
    for m in _BLOCK.finditer(text):
        yield from _block_layers(layer, m, m.span() in read)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the spans of decoded layers; each in order, without repeats."""
    base = base_spans(text)
    found = set(base)
    seen = set()
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    while work:
        layer = work.pop()
        for new in inner_layers(layer):
            key = hashlib.blake2b(f"{new.begin[0]}:{new.end[-1]}:{new.text}".encode(errors="surrogatepass"), digest_size=16).digest()
            if key in seen:  # the same text from the same place: a cycle, or another way to it
                continue
            seen.add(key)
            found.update((new.begin[a], kind, new.end[b - 1]) for a, kind, b in base_spans(new.text))
            work.append(new)
    return base, sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Columns: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans (all, kind:start:end
    joined by commas), found (the same as an array of structs). Offsets count code points.

    Layers are read to their ends, whatever their size: compressed ones in parts that overlap.
    Null text counts as empty and has no spans; a null id stays null; repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in in_parts(batches):
            maybe = pc.match_substring_regex(pa.array(batch["text"], pa.large_string()), _ANY).to_numpy(zero_copy_only=False)
            n = len(batch)
            out = {id_col: batch["id"], "n_assign": [0] * n, "n_access": [0] * n, "n_hex": [0] * n, "base_sha256": [none] * n, "spans": [""] * n, "found": [[]] * n}
            texts = batch["text"].tolist()
            for i in maybe.nonzero()[0].tolist():
                base, spans = all_spans(texts[i])
                if spans:
                    for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                        out[name][i] = sum(x[1] == k for x in base)
                    out["base_sha256"][i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    out["spans"][i] = _joined(spans)
                    out["found"][i] = [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]
            yield pd.DataFrame(out)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<start: long, kind: string, end: long>>"
    return rows.mapInPandas(each, schema).withColumn(id_col, F.col(id_col).cast(kind))


def mask(text: str, sign: str = "*") -> str:
    """The text with every secret's characters replaced; lengths and line ends stay."""
    if not (spans := all_spans(text)[1]):
        return text
    chars = list(text)
    for a, _, b in spans:
        for i in range(a, b):
            if chars[i] not in "\r\n":
                chars[i] = sign
    return "".join(chars)


def mask_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with secrets masked in ``text_col``; null stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            maybe = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
            if pc.any(maybe).as_py():
                new = [mask(t) if m else t for t, m in zip(texts.to_pylist(), maybe.to_pylist(), strict=True)]
                batch = pa.RecordBatch.from_arrays([pa.array(new, texts.type) if i == at else c for i, c in enumerate(batch.columns)], names=names)
            yield batch

    return docs.mapInArrow(each, docs.schema)
