"""The standard password dictionary (V 2, R 3, 128 bits). Only the dictionary: no content is encrypted,
so the writer of revisions never adds it to a file, which would then claim what is not so."""

from __future__ import annotations

import hashlib
import os

#: The padding of passwords, and permissions that allow all but extraction for accessibility.
PADDING = bytes(
    [0x28, 0xBF, 0x4E, 0x5E, 0x4E, 0x75, 0x8A, 0x41, 0x64, 0x00, 0x4B, 0x49, 0x43, 0x4B, 0x53, 0x2E, 0x41, 0x52, 0x4E, 0x45, 0x2F, 0x54, 0x68, 0x69, 0x73, 0x20, 0x69, 0x73, 0x20, 0x73, 0x45, 0x43]
)
ALLOWED = 0xFFFFF0C0 | 0x3C


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(byte ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


def _hashed(data: bytes) -> bytes:
    """MD5, and 50 times more."""
    for _ in range(51):
        data = hashlib.md5(data).digest()
    return data


def _rounds(key: bytes, data: bytes) -> bytes:
    for n in range(20):
        data = rc4(bytes(k ^ n for k in key), data)
    return data


def _padded(password: str) -> bytes:
    return (password.encode() + PADDING)[:32]


def password_dictionary(user: str, owner: str = "", file_id: bytes | None = None, permissions: int = ALLOWED) -> tuple[bytes, bytes]:
    """The serialised dictionary and the file id (16 random bytes if none is given); the owner's password defaults to the user's."""
    file_id = os.urandom(16) if file_id is None else file_id
    o = _rounds(_hashed(_padded(owner or user)), _padded(user))
    key = _hashed(_padded(user) + o + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
    u = _rounds(key, hashlib.md5(PADDING + file_id).digest()).ljust(32, b"\0")
    signed = permissions - (1 << 32) if permissions & 1 << 31 else permissions
    return f"<< /Type /Encrypt /Filter /Standard /V 2 /R 3 /Length 128 /O <{o.hex()}> /U <{u.hex()}> /P {signed} >>".encode(), file_id


def id_array(file_id: bytes) -> bytes:
    return b"[<%s> <%s>]" % ((file_id.hex().encode(),) * 2)
