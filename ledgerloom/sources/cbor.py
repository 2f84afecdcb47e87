"""The part of CBOR (RFC 8949) that graph files use."""

from __future__ import annotations

import struct


def _head(major: int, n: int) -> bytes:
    for limit, mark, form in ((24, None, ""), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I")):
        if n < limit:
            return bytes([major << 5 | n]) if mark is None else bytes([major << 5 | mark]) + struct.pack(form, n)
    return bytes([major << 5 | 27]) + struct.pack(">Q", n)


def encode(x) -> bytes:
    if x is None:
        return b"\xf6"
    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, bytes):
        return _head(2, len(x)) + x
    if isinstance(x, str):
        return _head(3, len(x.encode())) + x.encode()
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return _head(4, len(x)) + b"".join(map(encode, x))
    raise TypeError(f"no CBOR for {type(x)}")


def decode(data: bytes, at: int = 0):
    """(value, position behind it)."""
    major, n = data[at] >> 5, data[at] & 31
    at += 1
    if n == 31 and major in (4, 5):  # of open length
        out: list = []
        while data[at] != 0xFF:
            value, at = decode(data, at)
            out.append(value)
        return (out if major == 4 else dict(zip(out[::2], out[1::2], strict=True))), at + 1
    if major < 6 and n >= 24:
        size = 1 << (n - 24)
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        raw = data[at : at + n]
        if len(raw) < n:
            raise ValueError("the value is cut off")
        return (raw if major == 2 else raw.decode()), at + n
    if major in (4, 5):
        out = []
        for _ in range(n * (major - 3)):
            value, at = decode(data, at)
            out.append(value)
        return (out if major == 4 else dict(zip(out[::2], out[1::2], strict=True))), at
    if data[at - 1] in (0xF4, 0xF5, 0xF6):
        return {0xF4: False, 0xF5: True, 0xF6: None}[data[at - 1]], at
    raise ValueError(f"CBOR item {data[at - 1]:#x} is not supported")
