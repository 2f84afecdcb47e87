"""Readers of containers: zip, tar, ar, cpio, RPM and ISO-9660, plain or compressed.

``members`` gives the regular files of a container held in memory, or None if
the bytes are no container.  One container is read by one task, and its members
leave that task one by one, so memory holds one container and one member.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import time
import zipfile
from collections.abc import Iterator

Member = tuple[str, bytes, int | None]  # path, content, modification time in milliseconds


def decompressed(data: bytes) -> bytes | None:
    """The content of a compressed stream, None if the bytes are not one."""
    try:
        if data[:2] == b"\x1f\x8b":
            return gzip.decompress(data)
        if data[:3] == b"BZh":
            return bz2.decompress(data)
        if data[:6] == b"\xfd7zXZ\x00" or data[:3] == b"\x5d\x00\x00":
            return lzma.decompress(data)
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except (OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    return None


def zip_members(data: bytes) -> Iterator[Member]:
    """S06."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                stamp = time.struct_time((*info.date_time, 0, 0, 0))
                import calendar

                yield info.filename, archive.read(info), calendar.timegm(stamp) * 1000


def tar_members(data: bytes) -> Iterator[Member]:
    """S10."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as archive:
        for info in archive:
            if info.isreg():
                yield info.name, archive.extractfile(info).read(), int(info.mtime * 1000)


def ar_members(data: bytes) -> Iterator[Member]:
    """Ar archives, such as Debian packages."""
    at = 8
    while at + 60 <= len(data):
        head = data[at : at + 60]
        size = int(head[48:58])
        yield head[:16].decode("latin-1").strip().rstrip("/"), data[at + 60 : at + 60 + size], int(head[16:28].strip() or 0) * 1000
        at += 60 + size + size % 2


def cpio_members(data: bytes) -> Iterator[Member]:
    """Cpio archives of the "new" format."""
    at, pad = 0, lambda n: -n % 4
    while data[at : at + 5] == b"07070" and at + 110 <= len(data):
        fields = [int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in range(13)]
        mode, mtime, size, length = fields[1], fields[5], fields[6], fields[11]
        name = data[at + 110 : at + 109 + length].decode("utf-8", "replace")
        at += 110 + length
        at += pad(at)
        if name == "TRAILER!!!":
            break
        if mode & 0o170000 == 0o100000:
            yield name, data[at : at + size], mtime * 1000
        at += size + pad(size)


def rpm_members(data: bytes) -> Iterator[Member]:
    """Lead, two headers, and a compressed cpio payload."""
    at = 96
    for aligned in (True, False):
        if data[at : at + 3] != b"\x8e\xad\xe8":
            return
        entries, size = struct.unpack(">II", data[at + 8 : at + 16])
        at += 16 + 16 * entries + size
        at += -at % 8 if aligned else 0
    payload = decompressed(data[at:])
    yield from cpio_members(payload if payload is not None else data[at:])


def iso_members(data: bytes) -> Iterator[Member]:
    """Names in lower case, without version numbers."""
    def walk(sector: int, size: int, folder: str, depth: int) -> Iterator[Member]:
        at, end = sector * 2048, sector * 2048 + size
        while at < end and depth < 32:
            length = data[at] if at < len(data) else 0
            if not length:  # records do not cross sectors
                at = (at // 2048 + 1) * 2048
                continue
            where, bytes_, flags, n = *struct.unpack("<I4xI", data[at + 2 : at + 14]), data[at + 25], data[at + 32]
            raw = data[at + 33 : at + 33 + n]
            if raw not in (b"\x00", b"\x01"):
                name = raw.decode("latin-1").partition(";")[0].rstrip(".").lower()
                if flags & 2:
                    yield from walk(where, bytes_, f"{folder}{name}/", depth + 1)
                else:
                    yield folder + name, data[where * 2048 : where * 2048 + bytes_], None
            at += length

    where, size = struct.unpack("<I4xI", data[16 * 2048 + 158 : 16 * 2048 + 170])
    yield from walk(where, size, "", 0)


def reader_of(data: bytes):
    """The reader for the bytes' format."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return zip_members
    if data[:4] == b"\xed\xab\xee\xdb":
        return rpm_members
    if data[32769:32774] == b"CD001":
        return iso_members
    if data[:8] == b"!<arch>\n":
        return ar_members
    if data[257:262] == b"ustar":
        return tar_members
    if data[:6] in (b"070701", b"070702"):
        return cpio_members
    return None


def members(data: bytes) -> Iterator[Member] | None:
    """The regular files of a container, None if the bytes are none or broken from the start."""
    reader = reader_of(data)
    if reader is None:
        inner = decompressed(data)
        if inner is None:
            return None
        data, reader = inner, reader_of(inner)
        if reader is None:
            return iter([("", data, None)])  # a compressed file that is no archive

    def safe() -> Iterator[Member]:
        try:
            yield from reader(data)
        except (zipfile.BadZipFile, tarfile.TarError, ValueError, struct.error, OSError, EOFError, RuntimeError, NotImplementedError, IndexError):
            return  # what was readable has been given

    return safe()
