"""Fonts: encodings, code maps and widths of one page's resources."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from foliant.sources.objects import Document, FormatError, Name, Stream

#: Accents as they end a glyph's name, and names that no rule gives.
_ACCENTS = {
    "GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring",
    "CEDILLA": "cedilla", "CARON": "caron", "STROKE": "slash", "OGONEK": "ogonek", "BREVE": "breve", "MACRON": "macron", "DOT ABOVE": "dotaccent",
}
_NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^",
    "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£",
    "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´",
    "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»",
    "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "germandbls": "ß", "AE": "Æ", "ae": "æ",
    "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "OE": "Œ", "oe": "œ", "florin": "ƒ", "circumflex": "ˆ", "tilde": "˜", "endash": "–", "emdash": "—",
    "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†",
    "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€",
    "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "dotlessi": "ı", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛",
    "hungarumlaut": "˝", "nbspace": "\xa0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
}


@lru_cache
def glyph_names() -> dict[str, str]:
    """Glyph names to characters: the table above, the letters, and accented letters by rule (letter, then accent)."""
    out = dict(_NAMED)
    for code in [*range(0x41, 0x5B), *range(0x61, 0x7B)]:
        out[chr(code)] = chr(code)
    for code in range(0xC0, 0x180):
        m = re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z]) WITH ([A-Z ]+)", unicodedata.name(chr(code), ""))
        if m and m[3] in _ACCENTS:
            out.setdefault((m[2] if m[1] == "CAPITAL" else m[2].lower()) + _ACCENTS[m[3]], chr(code))
    return out


def glyph_character(name: str) -> str | None:
    """A glyph name's character; uniXXXX and uXXXXX names are read as numbers."""
    if name in glyph_names():
        return glyph_names()[name]
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    return None


@lru_cache
def base_encoding(name: str) -> dict[int, str]:
    """Codes to characters; any unknown name means the Windows table."""
    codec = "mac_roman" if name == "MacRomanEncoding" else "cp1252"
    out = {}
    for code in range(0x20, 0x100):
        try:
            out[code] = bytes([code]).decode(codec)
        except UnicodeDecodeError:
            continue
    return out


def with_differences(base: dict[int, str], differences: list[Any]) -> dict[int, str]:
    """Numbers set a counter; each name takes it and moves on, known or not."""
    out, code = dict(base), 0
    for item in differences:
        if isinstance(item, Name):
            if (char := glyph_character(item)) is not None:
                out[code] = char
            code += 1
        elif isinstance(item, (int, float)):
            code = int(item)
    return out


_HEX = r"<\s*([0-9A-Fa-f\s]+?)\s*>"


def _utf16(digits: str) -> str:
    digits = re.sub(r"\s", "", digits)
    return bytes.fromhex(digits.zfill(len(digits) + -len(digits) % 4)).decode("utf-16-be", errors="replace")


def parse_cmap(data: bytes) -> dict[int, str]:
    """Codes to text: all single mappings, then all ranges; what is written later counts."""
    text, out = data.decode("latin-1"), {}
    for body in re.findall(r"beginbfchar(.*?)endbfchar", text, re.DOTALL):
        for src, dst in re.findall(_HEX + r"\s*" + _HEX, body):
            out[int(re.sub(r"\s", "", src), 16)] = _utf16(dst)
    for body in re.findall(r"beginbfrange(.*?)endbfrange", text, re.DOTALL):
        for low, high, dst, items in re.findall(_HEX + r"\s*" + _HEX + r"\s*(?:" + _HEX + r"|\[(.*?)\])", body, re.DOTALL):
            a, b = int(re.sub(r"\s", "", low), 16), int(re.sub(r"\s", "", high), 16)
            if dst:
                first = _utf16(dst)
                if b - a >= CODES:
                    raise ValueError("a code range is longer than codes of four bytes in use can be")
                for i in range(b - a + 1):
                    last = ord(first[-1]) + i if first else 0
                    out[a + i] = first[:-1] + chr(last) if first and last < 0x110000 else ""
            else:
                for i, item in enumerate(re.findall(_HEX, items)):
                    if a + i <= b:
                        out[a + i] = _utf16(item)
    return out


#: Codes of one range at most; a longer one is an error of the file, not cut.
CODES = 0x110000


def reverse_map(codes: dict[int, str]) -> dict[str, int]:
    """Characters to the code that was mapped first; only mappings to one character count."""
    out: dict[str, int] = {}
    for code, text in codes.items():
        if len(text) == 1:
            out.setdefault(text, code)
    return out


def simple_widths(first: Any, widths: list[Any]) -> dict[int, float]:
    base = int(first) if isinstance(first, (int, float)) else 0
    return {base + i: float(w) if isinstance(w, (int, float)) else 0.0 for i, w in enumerate(widths)}


def cid_widths(runs: list[Any]) -> dict[int, float]:
    """Runs of ``first [w w ...]`` and ``first last w``."""
    out, i = {}, 0
    while i + 1 < len(runs):
        if isinstance(runs[i + 1], list):
            out |= {int(runs[i]) + k: float(w) for k, w in enumerate(runs[i + 1]) if isinstance(w, (int, float))}
            i += 2
        elif i + 2 < len(runs):
            low, high = int(runs[i]), int(runs[i + 1])
            if high - low >= CODES:
                raise ValueError("a run of widths is longer than a font has characters")
            out |= dict.fromkeys(range(low, high + 1), float(runs[i + 2]))
            i += 3
        else:
            break
    return out


@dataclass
class PageFont:
    name: str
    base_font: str = ""
    subtype: str = ""
    encoding_name: str = ""
    is_cid: bool = False
    is_embedded: bool = False
    to_unicode: dict[int, str] | None = None
    encoding: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 1000.0

    @property
    def bytes_per_char(self) -> int:
        return 2 if self.is_cid else 1

    def decode(self, code: int) -> str:
        fallback = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        if self.to_unicode is not None:
            return self.to_unicode.get(code, fallback)
        return self.encoding.get(code, fallback)

    def encode(self, char: str) -> int | None:
        """The char's code; with a code map no other table is tried."""
        if self.to_unicode is not None:
            return reverse_map(self.to_unicode).get(char)
        known = reverse_map(self.encoding).get(char)
        return known if known is not None else ord(char) if ord(char) < 256 and not self.encoding else None

    def string_width(self, text: str, size: float) -> float:
        return sum(self.widths.get(ord(c), self.default_width) for c in text) / 1000 * size


def _read(doc: Document, name: str, info: dict[str, Any]) -> PageFont:
    r = doc.resolve
    font = PageFont(name, str(r(info.get("BaseFont")) or ""), str(r(info.get("Subtype")) or ""))
    holder = info
    if font.subtype == "Type0":
        holder = r((r(info.get("DescendantFonts")) or [None])[0]) or {}
        encoding = r(info.get("Encoding"))
        font.is_cid, font.encoding_name = True, str(encoding) if isinstance(encoding, Name) else "Identity-H"
        default = r(holder.get("DW"))
        font.default_width = float(default) if isinstance(default, (int, float)) else 1000.0
        font.widths = cid_widths([[r(x) for x in r(w)] if isinstance(r(w), list) else r(w) for w in r(holder.get("W")) or []])
    else:
        encoding = r(info.get("Encoding"))
        if isinstance(encoding, dict):
            font.encoding_name = str(r(encoding.get("BaseEncoding")) or "WinAnsiEncoding")
            font.encoding = with_differences(base_encoding(font.encoding_name), r(encoding.get("Differences")) or [])
        elif isinstance(encoding, Name):
            font.encoding_name, font.encoding = str(encoding), base_encoding(str(encoding))
        if isinstance(widths := r(info.get("Widths")), list):
            font.widths = simple_widths(r(info.get("FirstChar")), [r(w) for w in widths])
    described = r(holder.get("FontDescriptor"))
    font.is_embedded = isinstance(described, dict) and any(k in described for k in ("FontFile", "FontFile2", "FontFile3"))
    if isinstance(cmap := r(info.get("ToUnicode")), Stream):
        font.to_unicode = parse_cmap(doc.decoded(cmap))
    return font


def page_fonts(doc: Document, resources: Any) -> dict[str, PageFont]:
    """Fonts by resource name; one that cannot be read is left out."""
    held = doc.resolve(resources)
    table = doc.resolve(held.get("Font")) if isinstance(held, dict) else None
    out = {}
    for name, ref in (table or {}).items():
        try:
            info = doc.resolve(ref)
            if isinstance(info, dict):
                out[name] = _read(doc, name, info)
        except (FormatError, ValueError, KeyError, TypeError):
            continue
    return out
