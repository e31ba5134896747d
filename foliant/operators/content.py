"""Page content: operators from bytes, and the graphics-state fold that places glyphs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.objects import END, Lexer, Name, Text, Word

#: Operators by category, looked up in this order; any other is ``other``.
CATEGORIES = {
    "text": ("BT", "ET", "Tf", "Td", "TD", "Tm", "T*", "Tj", "TJ", "'", '"', "Tc", "Tw", "TL", "Tr", "Ts", "Tz"),
    "graphics_state": ("q", "Q", "cm", "w", "J", "j", "M", "d", "ri", "i", "gs"),
    "path": ("m", "l", "c", "v", "y", "h", "re", "S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n", "W", "W*"),
    "color": ("CS", "cs", "SC", "SCN", "sc", "scn", "G", "g", "RG", "rg", "K", "k"),
    "xobject": ("Do",),
    "marked_content": ("BMC", "BDC", "EMC", "MP", "DP"),
    "inline_image": ("BI", "ID", "EI"),
}


def category(name: str) -> str:
    return next((c for c, names in CATEGORIES.items() if name in names), "other")


@dataclass
class Operator:
    name: str
    operands: list[Any]
    raw: bytes
    byte_offset: int
    modified: bool = False
    inline_data: bytes | None = None


_CONTENT_SPACE = b"\x00\t\n\r "
_IMAGE_END = re.compile(rb"[\x00\t\n\r ]EI(?=[\x00\t\n\r %]|\Z)")


def tokenize(data: bytes) -> list[Operator]:
    """Operators in order, each with its operands and the bytes it came from.

    Stray closing brackets and words that begin like a number are skipped; any other unknown
    word is an operator. Operands without an operator at the end are dropped.
    """
    lexer, out, operands, start = Lexer(data, spaces=_CONTENT_SPACE, references=False), [], [], None
    while True:
        lexer.skip()
        begin = lexer.at
        token = lexer.token()
        if token is END:
            return out
        if start is None:
            start = begin
        if not isinstance(token, Word):
            operands.append(token)
            continue
        word = token.text
        if word in ("]", ">>", ")", "{", "}", ">") or word[0] in "+-.0123456789":
            start = start if operands else None
            continue
        image = None
        if word == "BI":
            info: dict[str, Any] = {}
            while (key := lexer.token()) is not END and key != Word("ID"):
                if isinstance(key, Name):
                    info[str(key)] = lexer.token()
            body = lexer.at + 1
            end = _IMAGE_END.search(data, max(lexer.at, body - 1))
            image = data[body : end.start()] if end else data[body:]
            lexer.at = end.end() if end else len(data)
            operands = [info]
        out.append(Operator(word, operands, data[start : lexer.at], start, inline_data=image))
        operands, start = [], None


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: tuple, n: tuple) -> tuple:
    """m applied before n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


@dataclass(frozen=True)
class State:
    ctm: tuple = IDENTITY
    text: tuple = IDENTITY
    line: tuple = IDENTITY
    font: str = ""
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    line_width: float = 1.0
    fill: tuple = (0.0, 0.0, 0.0)
    stroke: tuple = (0.0, 0.0, 0.0)
    fill_space: str = ""
    stroke_space: str = ""


@dataclass
class Font:
    """What the fold needs of a font; the defaults are those of an unknown one."""

    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 600.0
    bytes_per_char: int = 1


def codes(raw: bytes, width: int) -> list[int]:
    """Character codes of one or two bytes; an odd byte at the end is a code."""
    if width != 2:
        return list(raw)
    return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]


def _numbers(operands: list[Any], n: int) -> tuple:
    got = [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0 for x in operands]
    return tuple((got + [0.0] * n)[:n])


def _gray(v: tuple) -> tuple:
    return (v[0],) * 3


def _cmyk(v: tuple) -> tuple:
    return tuple((1 - x) * (1 - v[3]) for x in v[:3])


class Interpreter:
    """Folds operators into glyphs. One handler an operator; all others leave the state as it is."""

    def __init__(self, fonts: dict[str, Font]) -> None:
        self.fonts, self.state, self.stack, self.glyphs, self.placed = fonts, State(), [], [], []

    def run(self, operators: Iterable[Operator]) -> list[dict[str, Any]]:
        for i, op in enumerate(operators):
            if handler := _HANDLERS.get(op.name):
                handler(self, op.operands, i)
        return self.glyphs

    def put(self, **changes: Any) -> None:
        self.state = replace(self.state, **changes)

    def move(self, tx: float, ty: float) -> None:
        line = times((1, 0, 0, 1, tx, ty), self.state.line)
        self.put(line=line, text=line)

    def shift(self, dx: float) -> None:
        a, b, c, d, e, f = self.state.text
        self.put(text=(a, b, c, d, e + dx * a, f + dx * b))

    def show(self, value: Any, op_idx: int) -> None:
        if not isinstance(value, Text):
            return
        s, font = self.state, self.fonts.get(self.state.font) or Font()
        for code in codes(value.raw, font.bytes_per_char):
            at = times(times((s.size * s.scale, 0, 0, s.size, 0, s.rise), self.state.text), s.ctm)
            width = font.widths.get(code, font.default_width)
            advance = (width / 1000 * s.size + s.char_space + (s.word_space if code == 32 else 0.0)) * s.scale
            self.glyphs.append({"char_seq": len(self.glyphs), "char_code": code, "x": at[4], "y": at[5], "width": advance, "font_size": s.size, "font_name": s.font, "fill_color": list(s.fill), "matrix": list(at), "op_idx": op_idx})
            self.shift(advance)

    def show_all(self, items: Any, op_idx: int) -> None:
        for item in items if isinstance(items, list) else []:
            if isinstance(item, (int, float)):
                self.shift(-(item / 1000) * self.state.size * self.state.scale)
            else:
                self.show(item, op_idx)

    def next_line(self) -> None:
        self.move(0.0, -self.state.leading)


def _last(operands: list[Any]) -> Any:
    """Operators take the operands next to them; more before these do not count."""
    return operands[-1] if operands else None


def _font(t: Interpreter, v: list, i: int) -> None:
    name = v[0] if v and isinstance(v[0], Name) else ""
    t.put(font=str(name), size=_numbers(v[1:], 1)[0])


def _leading_move(t: Interpreter, v: list, i: int) -> None:
    x, y = _numbers(v, 2)
    t.put(leading=-y)
    t.move(x, y)


def _quote(t: Interpreter, v: list, i: int) -> None:
    t.next_line()
    t.show(_last(v), i)


def _double_quote(t: Interpreter, v: list, i: int) -> None:
    word, char = _numbers(v, 2)
    t.put(word_space=word, char_space=char)
    t.next_line()
    t.show(_last(v) if len(v) > 2 else None, i)


def _place(t: Interpreter, v: list, i: int) -> None:
    if isinstance(_last(v), Name):
        t.placed.append({"op_idx": i, "name": str(_last(v)), "matrix": list(t.state.ctm)})


def _restore(t: Interpreter, v: list, i: int) -> None:
    if t.stack:
        t.state = t.stack.pop()


def _set(name: str, share: float = 1.0) -> Callable:
    return lambda t, v, i: t.put(**{name: _numbers(v, 1)[0] * share})


def _color(name: str, n: int, to_rgb: Callable[[tuple], tuple]) -> Callable:
    return lambda t, v, i: t.put(**{name: to_rgb(_numbers(v, n))})


_HANDLERS: dict[str, Callable[[Interpreter, list, int], None]] = {
    "BT": lambda t, v, i: t.put(text=IDENTITY, line=IDENTITY),
    "Tf": _font,
    "Tc": _set("char_space"),
    "Tw": _set("word_space"),
    "TL": _set("leading"),
    "Ts": _set("rise"),
    "Tr": lambda t, v, i: t.put(mode=int(_numbers(v, 1)[0])),
    "Tz": _set("scale", 0.01),
    "Td": lambda t, v, i: t.move(*_numbers(v, 2)),
    "TD": _leading_move,
    "Tm": lambda t, v, i: t.put(text=_numbers(v, 6), line=_numbers(v, 6)),
    "T*": lambda t, v, i: t.next_line(),
    "Tj": lambda t, v, i: t.show(_last(v), i),
    "TJ": lambda t, v, i: t.show_all(_last(v), i),
    "'": _quote,
    '"': _double_quote,
    "q": lambda t, v, i: t.stack.append(t.state),
    "Q": _restore,
    "Do": _place,
    "cm": lambda t, v, i: t.put(ctm=times(_numbers(v, 6), t.state.ctm)),
    "w": _set("line_width"),
    "rg": _color("fill", 3, tuple),
    "RG": _color("stroke", 3, tuple),
    "g": _color("fill", 1, _gray),
    "G": _color("stroke", 1, _gray),
    "k": _color("fill", 4, _cmyk),
    "K": _color("stroke", 4, _cmyk),
    "cs": lambda t, v, i: t.put(fill_space=str(_last(v) or "")),
    "CS": lambda t, v, i: t.put(stroke_space=str(_last(v) or "")),
}


def running_total(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The fold's simplest case, a running sum by key; as a window it streams through any size of key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(value).over(w))
