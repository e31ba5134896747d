"""Stream filters: decoding codecs over whole buffers. Empty input stays empty."""

from __future__ import annotations

import re
import zlib

_SPACE = b"\x00\t\n\x0c\r "


#: Bytes of one decoded stream at most: more is an error, not a cut.
LARGEST = 1 << 30


class CodecError(ValueError):
    """A buffer that a filter cannot decode."""


def flate(data: bytes) -> bytes:
    """Zlib inflate; corrupt input is an error, a missing end is too, and so is more than ``LARGEST`` bytes."""
    if not data:
        return b""
    unpack = zlib.decompressobj()
    try:
        out = unpack.decompress(data, LARGEST)
    except zlib.error as error:
        raise CodecError(str(error)) from error
    if not unpack.eof:
        raise CodecError("more than a stream may hold" if unpack.unconsumed_tail else "the stream has no end")
    return out


def ascii_hex(data: bytes) -> bytes:
    digits = data.translate(None, _SPACE).split(b">", 1)[0]
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise CodecError("not a hexadecimal digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    out, group = bytearray(), []

    def emit(n: int) -> None:
        value = 0
        for digit in group + [84] * (5 - len(group)):
            value = value * 85 + digit
        out.extend((value & 0xFFFFFFFF).to_bytes(4, "big")[:n])
        group.clear()

    for byte in data:
        if byte in _SPACE:
            continue
        if byte == 0x7E:
            break
        if byte == 0x7A:
            if group:
                raise CodecError("z inside a group")
            out.extend(bytes(4))
        elif 0x21 <= byte <= 0x75:
            group.append(byte - 0x21)
            if len(group) == 5:
                emit(4)
        else:
            raise CodecError(f"byte {byte} in base 85")
    if group:
        emit(len(group) - 1)
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; ``early`` 1 widens them one code sooner, as files do unless they say otherwise."""
    out, table, width, previous = bytearray(), [], 9, b""
    held = bits = 0

    def fresh() -> list[bytes]:
        return [bytes([i]) for i in range(256)] + [b"", b""]

    table = fresh()
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits & (1 << width) - 1
            held &= (1 << bits) - 1
            if code == 256:
                table, width, previous = fresh(), 9, b""
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and previous:
                entry = previous + previous[:1]
            else:
                raise CodecError(f"code {code} before its entry")
            out += entry
            if previous and len(table) < 4096:
                table.append(previous + entry[:1])
            previous = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undoes PNG row prediction (predictors 10 and up); other data pass."""
    if int(parms.get("Predictor", 1)) < 10:
        return data
    unit = max(1, int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) // 8)
    row = (int(parms.get("Columns", 1)) * int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) + 7) // 8
    out, above = bytearray(), bytes(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            a, b, c = (line[i - unit], above[i], above[i - unit]) if i >= unit else (0, above[i], 0)
            if kind == 1:
                add = a
            elif kind == 2:
                add = b
            elif kind == 3:
                add = (a + b) // 2
            elif kind == 4:
                p = a + b - c
                add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                add = 0
            line[i] = line[i] + add & 255
        out += line
        above = bytes(line).ljust(row, b"\0")
    return bytes(out)


#: Abbreviations of filter names, and image filters whose data pass as they are.
SHORT = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode"}
PASSED = ("DCTDecode", "JPXDecode")


def decode(data: bytes, filters: str | list[str] | None, parms: dict | list | None = None) -> bytes:
    """Applies filters from left to right; an unknown one is an error."""
    names = [filters] if isinstance(filters, str) else list(filters or [])
    given = parms if isinstance(parms, list) else [parms] * len(names)
    for i, name in enumerate(names):
        name, p = SHORT.get(name, name), (given[i] if i < len(given) else None) or {}
        if name in PASSED or not data:
            continue
        if name == "FlateDecode":
            data = unpredict(flate(data), p)
        elif name == "LZWDecode":
            data = unpredict(lzw(data, int(p.get("EarlyChange", 1))), p)
        elif name in (plain := {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii_85, "RunLengthDecode": run_length}):
            data = plain[name](data)
        else:
            raise CodecError(f"unknown filter {name}")
    return data
