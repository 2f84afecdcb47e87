"""Binary formats as rows of tag and value: DER, OpenSSH certificates, OpenPGP packets, Java key stores and class files.

``records`` turns a column of contents into one row for each element, with its place in the tree; what the
elements mean is told by DataFrame expressions over these rows (``operators.keymaterial``).  Only
the walk itself, a few lines for each format, runs in Python; rows leave it in batches.

Defined results: a content that is not of its format, or null, gives no rows; one that is cut off gives the rows before the cut,
and one of tag BROKEN; what a secret key holds beside its public part is never given away.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: path: places from the root; tags: tags from the root; start and size: the whole element; value: its content, null if it has parts.
RECORD = "id string, path array<int>, tags array<int>, start int, size int, value binary"
BROKEN, BATCH = -1, 4096
#: Tags of the other formats: an OpenPGP signature's part is its type and this; parts of key stores.
SUBPACKET, KEY, CERTIFICATE, CHAIN = 1000, 1, 2, 3
Record = tuple[tuple[int, ...], tuple[int, ...], int, int, bytes | None]


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the content of one DER element; an error if it does not fit."""
    tag, first, at = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F or first in (0x80, 0xFF):
        raise ValueError("not in this subset of DER")
    if first & 0x80:
        size = first & 0x7F
        first, at = int.from_bytes(data[at : at + size], "big"), at + size
    if at + first > end:
        raise ValueError("the element is cut off")
    return tag, at, at + first


def der(data: bytes) -> Iterator[Record]:
    """The first element and all below it.  An octet string beside an object identifier is opened if one element fills it."""
    todo = [(0, None, (), (), 0, False)]  # place, end, path and tags of the parent, number, beside an identifier
    while todo:
        at, end, path, tags, n, named = todo.pop()
        if end is None:
            end = _element(data, 0, len(data))[2]
        elif at >= end:
            continue
        tag, start, stop = _element(data, at, end)
        if n or path:
            todo.append((stop, end, path, tags, n + 1, named or (tag == 6 and n == 0)))
        inside = bool(tag & 0x20)
        if tag == 4 and named and stop - start >= 2:
            try:
                inside = _element(data, start, stop)[2] == stop
            except (ValueError, IndexError):
                inside = False
        yield (*path, n), (*tags, tag), at, stop - at, None if inside else data[start:stop]
        if inside:
            todo.append((start, stop, (*path, n), (*tags, tag), 0, False))


def _strings(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Place and content of each length-prefixed string; an error if the last is cut off."""
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            raise ValueError("the string is cut off")
        yield at, data[at + 4 : at + 4 + n]
        at += 4 + n


# How many strings a certified key has, by the start of its type.
KEY_FIELDS = {"ssh-rsa": 2, "ssh-dss": 4, "ssh-ed25519": 1, "ssh-ed448": 1, "ecdsa-sha2-": 2}
CERTIFIED = "-cert-v01@openssh.com"


def ssh_certificate(data: bytes) -> Iterator[Record]:
    """Fields by number: 0 type, 1 nonce, 2 key, 3 serial, 4 kind, 5 key id, 6 principals, 7 and 8 validity, 9 options, 10 extensions, 11 reserved, 12 authority, 13 signature."""
    at = 0

    def string() -> bytes:
        nonlocal at
        where, value = next(_strings(data, at), (at, None))
        if value is None:
            raise ValueError("a field is missing")
        at = where + 4 + len(value)
        return value

    kind = string()
    key = kind.decode("latin-1").removesuffix(CERTIFIED)
    fields = next((n for k, n in KEY_FIELDS.items() if key.startswith(k)), None)
    if fields is None or key == kind.decode("latin-1"):
        return
    row = lambda path, value: (path, (0,) * len(path), at - len(value), len(value), value)
    yield row((0,), kind)
    yield row((1,), string())
    for j in range(fields):
        yield row((2, j), string())
    for n in range(3, 14):
        if n in (3, 4, 7, 8):
            size = 4 if n == 4 else 8
            if at + size > len(data):
                raise ValueError("a number is cut off")
            at += size
            yield row((n,), data[at - size : at])
        elif n in (6, 9, 10, 13):
            value = string()
            yield row((n,), value)
            for j, (_, part) in enumerate(_strings(value)):
                yield row((n, j), part)
        else:
            yield row((n,), string())


ARMOR = re.compile(rb"-----BEGIN PGP [A-Z ]+-----\r?\n(.*?)-----END PGP", re.DOTALL)


def _unarmored(data: bytes) -> bytes:
    """The packets of all armored blocks; of other contents the bytes themselves."""
    if b"-----BEGIN PGP " not in data:
        return data
    out = b""
    for block in ARMOR.findall(data):
        lines = block.replace(b"\r", b"").split(b"\n")
        body = lines[lines.index(b"") + 1 :] if b"" in lines else lines
        out += base64.b64decode(b"".join(x for x in body if x and not x.startswith(b"=")))
    return out


def _packets(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Tag, place, whole size and body of each OpenPGP packet."""
    at = 0
    while at < len(data):
        began, head = at, data[at]
        if not head & 0x80:
            raise ValueError("not a packet")
        at += 1
        body = b""
        if head & 0x40:
            tag, more = head & 0x3F, True
            while more:
                more, first = False, data[at]
                at += 1
                if first < 192:
                    n = first
                elif first < 224:
                    n, at = ((first - 192) << 8) + data[at] + 192, at + 1
                elif first == 255:
                    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
                else:
                    n, more = 1 << (first & 0x1F), True
                if at + n > len(data):
                    raise ValueError("the packet is cut off")
                body, at = body + data[at : at + n], at + n
        else:
            tag, kind = head >> 2 & 0xF, head & 3
            size = (1, 2, 4, 0)[kind]
            n = int.from_bytes(data[at : at + size], "big") if size else len(data) - at
            at += size
            if at + n > len(data):
                raise ValueError("the packet is cut off")
            body, at = data[at : at + n], at + n
        yield tag, began, at - began, body


def _public(body: bytes) -> bytes:
    """The public part of a key packet's body."""
    if body[0] == 6:
        return body[: 10 + int.from_bytes(body[6:10], "big")]
    at, algorithm = (6, body[5]) if body[0] == 4 else (8, body[7])
    number = lambda at: at + 2 + (int.from_bytes(body[at : at + 2], "big") + 7) // 8
    if algorithm in (18, 19, 22):
        at = number(at + 1 + body[at])
        return body[: at + 1 + body[at] if algorithm == 18 else at]
    if algorithm in (25, 26, 27, 28):
        return body[: at + {25: 32, 26: 56, 27: 32, 28: 57}[algorithm]]
    for _ in range({1: 2, 2: 2, 3: 2, 16: 3, 20: 3, 17: 4}.get(algorithm, 0)):
        at = number(at)
    return body[:at]


def pgp(data: bytes) -> Iterator[Record]:
    """Packets; below a signature its kind, tag 0, and its hashed parts; of keys the public part alone."""
    for n, (tag, at, size, body) in enumerate(_packets(_unarmored(data))):
        if tag in (5, 6, 7, 14):
            body = _public(body)
        yield (n,), (tag,), at, size, body if tag in (5, 6, 7, 13, 14) else None
        if tag == 2 and body[:1] in (b"\x04", b"\x06"):
            yield (n, 0), (tag, 0), at, size, body[1:2]
            wide = 4 if body[0] == 6 else 2
            where, end = 4 + wide, 4 + wide + int.from_bytes(body[4 : 4 + wide], "big")
            part = 1
            while where < end:
                first = body[where]
                if first < 192:
                    size_, where = first, where + 1
                elif first < 255:
                    size_, where = ((first - 192) << 8) + body[where + 1] + 192, where + 2
                else:
                    size_, where = int.from_bytes(body[where + 1 : where + 5], "big"), where + 5
                yield (n, part), (tag, SUBPACKET + (body[where] & 0x7F)), at, size, body[where + 1 : where + size_]
                where, part = where + size_, part + 1


def key_store(data: bytes) -> Iterator[Record]:
    """Entries of a Java key store by number, tag KEY or CERTIFICATE and alias; below each its certificates, tag CHAIN."""
    magic, version, count = struct.unpack_from(">III", data)
    if magic not in (0xFEEDFEED, 0xCECECECE) or version not in (1, 2):
        return
    at = 12

    def read(size: int) -> bytes:
        nonlocal at
        if at + size > len(data):
            raise ValueError("the store is cut off")
        at += size
        return data[at - size : at]

    number = lambda size: int.from_bytes(read(size), "big")
    for n in range(count):
        tag = number(4)
        alias, began = read(number(2)), at
        read(8)
        if tag not in (KEY, CERTIFICATE):
            raise ValueError("an entry that only Java reads")
        if tag == KEY:
            read(number(4))
        yield (n,), (tag,), began, 0, alias
        for j in range(number(4) if tag == KEY else 1):
            if version == 2:
                read(number(2))
            content = read(number(4))
            yield (n, j), (tag, CHAIN), at - len(content), len(content), content


#: First places of a class file's rows: its name, its source file, and the parts of a module.
CLASS, SOURCE, MODULE, REQUIRES, EXPORTS, OPENS, PROVIDES, USES = range(8)
# How many bytes a constant has behind its tag; a text's length stands in front of it.
CONSTANTS = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


def java_class(data: bytes) -> Iterator[Record]:
    """A class file's name and source file; of a module its name and version, and what it requires, exports, opens, provides and uses.

    One pass notes where each constant begins; wide ones count as two.  Fields, methods and code are stepped over.
    """
    if data[:4] != b"\xca\xfe\xba\xbe":
        return
    two = lambda at: struct.unpack_from(">H", data, at)[0]
    places, at, n = {}, 10, 1
    while n < two(8):
        places[n] = at
        tag = data[at]
        at += 1 + (2 + two(at + 1) if tag == 1 else CONSTANTS[tag])
        n += 2 if tag in (5, 6) else 1

    def text(number: int) -> bytes:
        where = places[number]
        while data[where] != 1:  # a class, package or module names its text
            where = places[two(where + 1)]
        return data[where + 3 : where + 3 + two(where + 1)]

    def row(path: tuple[int, ...], number: int) -> Record:
        return path, (0,) * len(path), places[number], 0, text(number)

    def attributes(at: int) -> tuple[list[tuple[int, int]], int]:
        """Name and place of the content of each attribute, and where they end."""
        out = []
        count, at = two(at), at + 2
        for _ in range(count):
            out.append((two(at), at + 6))
            at += 6 + struct.unpack_from(">I", data, at + 2)[0]
        return out, at

    yield row((CLASS,), two(at + 2))
    at += 6
    at += 2 + 2 * two(at)
    for _ in range(2):  # fields and methods
        count, at = two(at), at + 2
        for _ in range(count):
            at = attributes(at + 6)[1]
    for name, at in attributes(at)[0]:
        if text(name) == b"SourceFile":
            yield row((SOURCE,), two(at))
        elif text(name) == b"Module":
            yield row((MODULE, 0), two(at))
            if two(at + 4):
                yield row((MODULE, 1), two(at + 4))
            at += 6
            for part in (REQUIRES, EXPORTS, OPENS, USES, PROVIDES):
                count, at = two(at), at + 2
                for j in range(count):
                    yield row((part, j), two(at))
                    at += {REQUIRES: 6, EXPORTS: 4, OPENS: 4}.get(part, 2)
                    if part in (EXPORTS, OPENS, PROVIDES):
                        many, at = two(at), at + 2
                        for k in range(many):
                            if part == PROVIDES:
                                yield row((part, j, k), two(at))
                            at += 2


# Tags of an RPM header whose texts and numbers are told.
RPM_TAGS = frozenset((1000, 1001, 1002, 1003, 1004, 1005, 1006, 1009, 1011, 1014, 1015, 1016, 1020, 1022))


def rpm(data: bytes) -> Iterator[Record]:
    """Texts and numbers of the main header of an RPM package, by tag; behind the lead and the signature header."""
    if data[:4] != b"\xed\xab\xee\xdb":
        return
    at = 96
    for main in (False, True):
        if data[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("a header is missing")
        entries, size = struct.unpack_from(">II", data, at + 8)
        store = at + 16 + 16 * entries
        if store + size > len(data):
            raise ValueError("the header is cut off")
        for n in range(entries if main else 0):
            tag, kind, offset, _ = struct.unpack_from(">IIII", data, at + 16 + 16 * n)
            if tag in RPM_TAGS and offset < size:
                if kind == 4:
                    value = data[store + offset : store + offset + 4]
                elif kind in (6, 8, 9):
                    value = data[store + offset : data.index(b"\0", store + offset)]
                else:
                    continue
                yield (n,), (tag,), store + offset, len(value), value
        at = store + size
        at += 0 if main else -at % 8


# Columns of .NET's metadata tables up to that of references: numbers by their bytes, heaps (s, g, b), tables in hex, and coded indexes.
TABLES = (
    "2 s g g g", "ResolutionScope s s", "4 s s TypeDefOrRef t04 t06", "t04", "2 s b", "t06", "4 2 2 s b t08", "t08", "2 2 s", "t02 TypeDefOrRef", "MemberRefParent s b", "2 HasConstant b",
    "HasCustomAttribute CustomAttributeType b", "HasFieldMarshal b", "2 HasDeclSecurity b", "2 4 t02", "4 t04", "b", "t02 t14", "t14", "2 s TypeDefOrRef", "t02 t17", "t17", "2 s b", "2 t06 HasSemantics",
    "t02 MethodDefOrRef MethodDefOrRef", "s", "b", "2 MemberForwarded s t1A", "4 t04", "4 4", "4", "4 2 2 2 2 4 b s s", "4", "4 4 4", "2 2 2 2 4 b s s b",
)
# The tables that a coded index may name, in the order of its lowest bits; FF is none.
CODED = {
    "TypeDefOrRef": "02 01 1B", "HasConstant": "04 08 17", "HasCustomAttribute": "06 04 01 02 08 09 0A 00 0E 17 14 11 1A 1B 20 23 26 27 28 2A 2C 2B", "HasFieldMarshal": "04 08", "HasDeclSecurity": "02 06 20",
    "MemberRefParent": "02 01 1A 06 1B", "HasSemantics": "14 17", "MethodDefOrRef": "06 0A", "MemberForwarded": "04 06", "CustomAttributeType": "FF FF 06 0A FF", "ResolutionScope": "00 1A 23 01",
}
TYPE_REF, MEMBER_REF, ATTRIBUTE, ASSEMBLY, REFERENCE = 0x01, 0x0A, 0x0C, 0x20, 0x23
#: First places of an assembly's rows: itself, what it refers to, and its attributes.
OWN, NEEDED, NOTED = 0, 1, 2


def assembly(data: bytes) -> Iterator[Record]:
    """A .NET assembly's name, version, culture and key, those of its references, and its attributes with a text.

    Below OWN and NEEDED: 0 name, 1 version as eight bytes, 2 culture, 3 key or token, 4 flags; below NOTED: 0 type, 1 text.
    How wide a row is depends on the sizes of heaps and on how many rows other tables have.
    """
    if data[:2] != b"MZ":
        return
    two, four = (lambda at, f=f: struct.unpack_from(f, data, at)[0] for f in ("<H", "<I"))
    head = four(0x3C)
    if data[head : head + 4] != b"PE\0\0":
        return
    optional = head + 24
    directories = optional + {0x10B: 96, 0x20B: 112}.get(two(optional), 0)
    sections = [struct.unpack_from("<IIII", data, optional + two(head + 20) + 40 * n + 8) for n in range(two(head + 6))]

    def place_of(address: int) -> int:
        for size, start, stored, raw in sections:
            if start <= address < start + max(size, stored):
                return raw + address - start
        raise ValueError("an address lies in no section")

    runtime = four(directories + 8 * 14)
    if directories == optional or not runtime:
        return
    root = place_of(four(place_of(runtime) + 8))
    if data[root : root + 4] != b"BSJB":
        raise ValueError("no metadata")
    at = root + 16 + four(root + 12)
    heaps = {}
    at, count = at + 4, two(at + 2)
    for _ in range(count):
        end = data.index(b"\0", at + 8)
        heaps[data[at + 8 : end].decode("latin-1")] = root + four(at)
        at = at + 8 + (end - at - 8) // 4 * 4 + 4
    base = heaps.get("#~", heaps.get("#-"))
    if base is None:
        raise ValueError("no tables")
    sizes, present = data[base + 6], struct.unpack_from("<Q", data, base + 8)[0]
    at, rows = base + 24, [0] * 64
    for n in range(64):
        if present >> n & 1:
            rows[n], at = four(at), at + 4

    def width(kind: str) -> int:
        if kind.isdigit():
            return int(kind)
        if kind in "sgb":
            return 4 if sizes >> "sgb".index(kind) & 1 else 2
        if kind in CODED:
            tables = [int(t, 16) for t in CODED[kind].split()]
            return 2 if max(rows[t] for t in tables if t < 64) < 1 << 16 - (len(tables) - 1).bit_length() else 4
        return 2 if rows[int(kind[1:], 16)] < 1 << 16 else 4

    layouts, starts = [[width(k) for k in t.split()] for t in TABLES], []
    for n, layout in enumerate(layouts):
        starts.append(at)
        at += rows[n] * sum(layout)

    def row(table: int, number: int) -> list[int]:
        where, out = starts[table] + (number - 1) * sum(layouts[table]), []
        if not 1 <= number <= rows[table]:
            raise ValueError("a row that is not there")
        for size in layouts[table]:
            out.append(int.from_bytes(data[where : where + size], "little"))
            where += size
        return out

    def text(offset: int) -> bytes:
        where = heaps["#Strings"] + offset
        return data[where : data.index(b"\0", where)]

    def sized(where: int) -> tuple[int, int]:
        """Size and start of what stands behind a packed length."""
        first = data[where]
        if first < 0x80:
            return first, where + 1
        if first < 0xC0:
            return (first & 0x3F) << 8 | data[where + 1], where + 2
        return int.from_bytes(data[where : where + 4], "big") & 0x1FFFFFFF, where + 4

    def blob(offset: int) -> bytes:
        size, where = sized(heaps["#Blob"] + offset) if offset else (0, 0)
        return data[where : where + size]

    out = lambda path, value: (path, (0,) * len(path), base, len(value), value)
    for table, first, own, skip in ((ASSEMBLY, OWN, 1, 1), (REFERENCE, NEEDED, rows[REFERENCE], 0)):
        for n in range(1, min(own, rows[table]) + 1):
            values = row(table, n)[skip:]
            version, flags, key, name, culture = values[:4], *values[4:8]
            for j, value in enumerate((text(name), struct.pack(">HHHH", *version), text(culture), blob(key), struct.pack(">I", flags))):
                yield out((first, n - 1, j), value)
    noted = 0
    for n in range(1, rows[ATTRIBUTE] + 1):
        parent, kind, value = row(ATTRIBUTE, n)
        if parent != 1 << 5 | 14 or kind & 7 != 3:  # of the assembly, made by a member of another
            continue
        owner = row(MEMBER_REF, kind >> 3)[0]
        if owner & 7 != 1:
            continue
        _, name, space = row(TYPE_REF, owner >> 3)
        content = blob(value)
        if content[:2] == b"\x01\0" and content[2:3] not in (b"", b"\xff"):
            size, start = sized(heaps["#Blob"] + value)
            length, start = sized(start + 2)
            yield out((NOTED, noted, 0), text(space) + b"." + text(name))
            yield out((NOTED, noted, 1), data[start : start + length])
            noted += 1


#: Walks of key material, and of packages, classes and assemblies.
WALKS = {"der": der, "ssh": ssh_certificate, "pgp": pgp, "store": key_store}
OTHER_WALKS = {"assembly": assembly, "rpm": rpm, "class": java_class}


def records(contents: DataFrame, kind: str) -> DataFrame:
    """Rows of RECORD from contents (id, content) of one kind, a key of WALKS or OTHER_WALKS."""
    walk = (WALKS | OTHER_WALKS)[kind]

    def rows(batches):
        for batch in batches:
            for id_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path: tuple[int, ...] = ()
                try:
                    for path, *rest in walk(data or b""):
                        yield (id_, path, *rest)
                except (ValueError, KeyError, IndexError, struct.error, binascii.Error, UnicodeDecodeError):
                    if path:
                        yield id_, (*path[:-1], path[-1] + 1), (BROKEN,), 0, 0, None

    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return contents.select("id", "content").mapInArrow(run, RECORD)
