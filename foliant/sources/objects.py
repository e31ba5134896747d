"""The object grammar, cross-references and reference resolution of one document's bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from foliant.sources.codecs import decode


class FormatError(ValueError):
    """Bytes that are not a readable document."""


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Text:
    """A string object; ``raw`` holds its bytes, ``hexadecimal`` how it was written."""

    raw: bytes
    hexadecimal: bool = False


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    info: dict[str, Any]
    raw: bytes


@dataclass(frozen=True)
class Word:
    """A keyword: an operator in content, or a structural word in a file."""

    text: str


END = Word("")
_DELIMITERS = b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)")
_NAME_END = re.compile(rb"[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z")
_ESCAPED = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class Lexer:
    """Reads objects from bytes. ``spaces``: what counts as white space; content knows no form feed."""

    def __init__(self, data: bytes, at: int = 0, spaces: bytes = b"\x00\t\n\x0c\r ", references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references
        self._skip = re.compile(rb"(?:[" + re.escape(spaces) + rb"]+|%[^\r\n]*)*")

    def skip(self) -> None:
        self.at = self._skip.match(self.data, self.at).end()

    def token(self) -> Any:
        """The next object, a :class:`Word`, or ``END``. Closing brackets come as words."""
        self.skip()
        if self.at >= len(self.data):
            return END
        data, c = self.data, self.data[self.at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            if data[self.at : self.at + 2] == b"<<":
                self.at += 2
                return self._dictionary()
            return self._hexadecimal()
        if c == 0x5B:
            self.at += 1
            return self._array()
        if data[self.at : self.at + 2] == b">>":
            self.at += 2
            return Word(">>")
        if c in _DELIMITERS:
            self.at += 1
            return Word(chr(c))
        if m := _NUMBER.match(data, self.at):
            self.at = m.end()
            return self._number_or_reference(m[0])
        end = _NAME_END.search(data, self.at).start()
        text = data[self.at : max(end, self.at + 1)].decode("latin-1")
        self.at += len(text)
        return {"true": True, "false": False, "null": None}.get(text, Word(text))

    def _number_or_reference(self, raw: bytes) -> Any:
        value = float(raw) if b"." in raw else int(raw)
        if self.references and isinstance(value, int) and value >= 0 and (m := re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)").match(self.data, self.at)):
            self.at = m.end()
            return Ref(value, int(m[1]))
        return value

    def _name(self) -> Name:
        end = _NAME_END.search(self.data, self.at + 1).start()
        raw = self.data[self.at + 1 : end]
        self.at = end
        digit = lambda c: int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else 0
        return Name(re.sub(rb"#(..)", lambda m: bytes([digit(m[1][0]) << 4 | digit(m[1][1])]), raw, flags=re.DOTALL).decode("latin-1"))

    def _literal(self) -> Text:
        out, depth, data, at = bytearray(), 1, self.data, self.at + 1
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                e = data[at]
                at += 1
                if e in _ESCAPED:
                    out += _ESCAPED[e]
                elif 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e == 0x0D:
                    at += data[at : at + 1] == b"\n"
                elif e != 0x0A:
                    out.append(e)
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            out.append(c)
        self.at = at
        return Text(bytes(out))

    def _hexadecimal(self) -> Text:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
        self.at = end + 1
        return Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), True)

    def _array(self) -> list:
        out = []
        while (x := self.token()) != Word("]"):
            if x is END:
                raise FormatError("array without end")
            if not isinstance(x, Word):
                out.append(x)
            elif self.references:
                raise FormatError(f"{x.text} in an array")
        return out

    def _dictionary(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while (key := self.token()) != Word(">>"):
            if key is END:
                raise FormatError("dictionary without end")
            if not isinstance(key, Name):
                if self.references:
                    raise FormatError("a dictionary's key is not a name")
                continue
            value = self.token()
            if value == Word(">>"):
                break
            out[str(key)] = value
        return out


@dataclass
class Entry:
    """Where an object lies: at a file offset, or in an object stream."""

    obj_num: int
    offset: int = 0
    generation: int = 0
    in_use: bool = True
    stream_obj_num: int | None = None
    index_in_stream: int | None = None


@dataclass
class Section:
    offset: int
    entries: list[Entry]
    trailer: dict[str, Any]


def last_xref(data: bytes) -> int:
    """The offset that the last startxref before the last end-of-file mark gives."""
    end = data.rfind(b"%%EOF")
    if end < 0:
        raise FormatError("no end-of-file mark")
    at = data.rfind(b"startxref", 0, end)
    if at < 0 or not (m := re.compile(rb"startxref\s*(\d+)").match(data, at)):
        raise FormatError("no startxref")
    return int(m[1])


@dataclass
class Document:
    data: bytes
    sections: list[Section] = field(default_factory=list)  # oldest first
    _objects: dict[int, Any] = field(default_factory=dict)
    _members: dict[int, dict[int, Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, data: bytes) -> Document:
        doc = cls(data)
        at, seen = last_xref(data), set()
        while at is not None and at not in seen:
            seen.add(at)
            section = doc._section(at)
            doc.sections.insert(0, section)
            previous = section.trailer.get("Prev")
            at = int(previous) if isinstance(previous, (int, float)) else None
        return doc

    # cross-references

    def _section(self, at: int) -> Section:
        lexer = Lexer(self.data, at)
        first = lexer.token()
        if first == Word("xref"):
            return self._table(at, lexer)
        if isinstance(first, int) and isinstance(lexer.token(), int) and lexer.token() == Word("obj"):
            return self._stream_table(at, self._body(lexer))
        raise FormatError(f"no cross-reference at {at}")

    def _table(self, at: int, lexer: Lexer) -> Section:
        entries: list[Entry] = []
        lexer.references = False
        while isinstance(start := lexer.token(), int):
            count = lexer.token()
            for i in range(count):
                offset, generation, kind = lexer.token(), lexer.token(), lexer.token()
                if kind not in (Word("n"), Word("f")):
                    raise FormatError("a cross-reference entry is neither n nor f")
                entries.append(Entry(start + i, offset, generation, kind == Word("n")))
        if start != Word("trailer"):
            raise FormatError("cross-reference table without trailer")
        lexer.references = True
        trailer = lexer.token()
        if not isinstance(trailer, dict):
            raise FormatError("the trailer is no dictionary")
        return Section(at, entries, trailer)

    def _stream_table(self, at: int, stream: Any) -> Section:
        if not isinstance(stream, Stream):
            raise FormatError("the cross-reference object is no stream")
        data, info = self.decoded(stream), stream.info
        widths, size = info.get("W"), info.get("Size")
        if not isinstance(widths, list) or not isinstance(size, int) or len(widths) < 3 or not all(isinstance(w, int) and w >= 0 for w in widths) or not sum(widths):
            raise FormatError("a cross-reference stream needs W and Size")
        index, entries, place = info.get("Index") or [0, size], [], 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for number in range(first, first + count):
                if place + sum(widths) > len(data):
                    raise FormatError("the cross-reference stream ends before its entries")
                fields = []
                for i, w in enumerate(widths):
                    raw = data[place : place + w]
                    place += w
                    fields.append((int.from_bytes(raw, "big") & 0xFFFFFFFF) if w else int(i == 0))
                kind, a, b = fields[:3]
                if kind == 0:
                    entries.append(Entry(number, a, b, False))
                elif kind == 1:
                    entries.append(Entry(number, a, b))
                elif kind == 2:
                    entries.append(Entry(number, 0, 0, True, a, b))
        return Section(at, entries, info)

    @property
    def trailer(self) -> dict[str, Any]:
        """The newest trailer; what it lacks comes from older ones, so nothing a revision left out is lost."""
        merged: dict[str, Any] = {}
        for s in self.sections:
            merged |= {k: v for k, v in s.trailer.items() if k not in ("Prev", "W", "Index", "Filter", "Length", "Type", "DecodeParms")}
        return merged

    def xref(self) -> dict[int, Entry]:
        """The newest entry of each object."""
        return {e.obj_num: e for s in self.sections for e in s.entries}

    # objects

    def _body(self, lexer: Lexer) -> Any:
        """An object after ``N G obj``, with its stream if it has one."""
        value = lexer.token()
        if isinstance(value, Word):
            raise FormatError(f"unexpected {value.text!r}")
        place = lexer.at
        if isinstance(value, dict) and lexer.token() == Word("stream"):
            at = lexer.at + (2 if self.data[lexer.at : lexer.at + 2] == b"\r\n" else 1)
            length = value.get("Length")
            if isinstance(length, Ref):
                length = self.resolve(length)
            if isinstance(length, int) and re.compile(rb"\s*endstream").match(self.data, at + length):
                return Stream(value, self.data[at : at + length])
            end = self.data.find(b"endstream", at)
            if end < 0:
                raise FormatError("stream without end")
            raw = self.data[at:end]
            raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw
            return Stream(value, raw)
        lexer.at = place
        return value

    def decoded(self, stream: Stream) -> bytes:
        filters, parms = self.resolve(stream.info.get("Filter")), self.resolve(stream.info.get("DecodeParms"))
        return decode(stream.raw, filters, parms)

    def resolve(self, value: Any, depth: int = 0) -> Any:
        """What a reference leads to; unknown or free objects are null."""
        if not isinstance(value, Ref):
            return value
        if depth > 64:
            raise FormatError(f"reference {value.num} leads in a circle")
        if value.num not in self._objects:
            entry = self._entries.get(value.num)
            self._objects[value.num] = None  # a circle through itself ends here
            if entry is not None and entry.in_use:
                self._objects[value.num] = self._member(entry) if entry.stream_obj_num is not None else self._at(entry)
        return self.resolve(self._objects[value.num], depth + 1)

    def resolved(self, values: dict[str, Any]) -> dict[str, Any]:
        """A dictionary with what its values lead to."""
        return {k: self.resolve(v) for k, v in values.items()}

    @property
    def _entries(self) -> dict[int, Entry]:
        known = self.__dict__.get("_xref_cache")
        if known is None or known[0] != len(self.sections):
            known = self.__dict__["_xref_cache"] = (len(self.sections), self.xref())
        return known[1]

    def _at(self, entry: Entry) -> Any:
        lexer = Lexer(self.data, entry.offset)
        lexer.references = False
        head = lexer.token(), lexer.token(), lexer.token()
        lexer.references = True
        if not isinstance(head[0], int) or head[2] != Word("obj"):
            raise FormatError(f"no object {entry.obj_num} at {entry.offset}")
        return self._body(lexer)

    def _member(self, entry: Entry) -> Any:
        """An object of an object stream, whose header is read once."""
        if entry.stream_obj_num not in self._members:
            holder = self.resolve(Ref(entry.stream_obj_num))
            if not isinstance(holder, Stream):
                raise FormatError(f"object stream {entry.stream_obj_num} is missing")
            data, first = self.decoded(holder), int(self.resolve(holder.info["First"]))
            head = Lexer(data[:first], references=False)
            pairs = [(head.token(), head.token()) for _ in range(int(self.resolve(holder.info["N"])))]
            self._members[entry.stream_obj_num] = {i: Lexer(data, first + at).token() for i, (_, at) in enumerate(pairs)}
        return self._members[entry.stream_obj_num].get(entry.index_in_stream)

    # pages

    def catalog(self) -> dict[str, Any]:
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise FormatError("the catalog is no dictionary")
        return root

    def pages(self) -> list[tuple[int, dict[str, Any], dict[str, Any]]]:
        """(object number, dictionary, inherited attributes) of the pages in document order; circles are cut."""
        out, seen = [], set()

        def walk(ref: Any, held: dict[str, Any]) -> None:
            number = ref.num if isinstance(ref, Ref) else 0
            node = self.resolve(ref)
            if not isinstance(node, dict) or (number and number in seen):
                return
            seen.add(number)
            held = held | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if node.get("Type") == "Page":
                out.append((number, node, held))
            elif node.get("Type") == "Pages":
                for kid in self.resolve(node.get("Kids")) or []:
                    walk(kid, held)

        walk(self.catalog().get("Pages"), {})
        return out

    def content(self, page: dict[str, Any]) -> bytes:
        """The page's content; several streams are joined by one space."""
        value = self.resolve(page.get("Contents"))
        parts = [self.resolve(x) for x in value] if isinstance(value, list) else [] if value is None else [value]
        if not all(isinstance(p, Stream) for p in parts):
            raise FormatError("a page's content is no stream")
        return b" ".join(self.decoded(p) for p in parts)

    def box(self, held: dict[str, Any]) -> tuple[float, float]:
        """Width and height of the crop box, else the media box, else 612 by 792."""
        for name in ("CropBox", "MediaBox"):
            box = self.resolve(held.get(name))
            if isinstance(box, list) and len(box) == 4 and all(isinstance(v := self.resolve(x), (int, float)) and not isinstance(v, bool) for x in box):
                a, b, c, d = (float(self.resolve(x)) for x in box)
                if c - a > 0 and d - b > 0:
                    return c - a, d - b
        return 612.0, 792.0


def _typed(values: dict[str, Any], key: str, kinds: tuple[type, ...], what: str) -> Any:
    if key not in values:
        return None
    value = values[key]
    if not isinstance(value, kinds) or isinstance(value, bool):
        raise FormatError(f"/{key} is no {what}")
    return value


# a dictionary's value by type: None if the key is absent, an error if the value (null too) is of another type


def number(values: dict[str, Any], key: str) -> int | float | None:
    return _typed(values, key, (int, float), "number")


def reference(values: dict[str, Any], key: str) -> Ref | None:
    return _typed(values, key, (Ref,), "reference")


def array(values: dict[str, Any], key: str) -> list[Any] | None:
    return _typed(values, key, (list,), "array")


def name(values: dict[str, Any], key: str) -> Name | None:
    return _typed(values, key, (Name,), "name")


def as_json(value: Any) -> Any:
    """The value in JSON types; references, names and strings are told apart by a key."""
    if isinstance(value, Ref):
        return {"$ref": [value.num, value.gen]}
    if isinstance(value, Name):
        return {"$name": str(value)}
    if isinstance(value, Text):
        return {"$hex": value.raw.hex()} if value.hexadecimal else {"$str": value.raw.decode("latin-1")}
    if isinstance(value, dict):
        return {k: as_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [as_json(v) for v in value]
    if isinstance(value, Stream):
        return {"$stream": as_json(value.info)}
    return value
