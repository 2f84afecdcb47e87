import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.builder import GraphBuilder
from ledgerloom.operators import assemblies
from ledgerloom.sources import records as rec


class Heap:
    def __init__(self, start=b"\0"):
        self.data = start

    def add(self, value):
        at = len(self.data)
        self.data += value
        return at


def made(name="Lib.Core", version=(1, 2, 3, 0), refs=(("System.Runtime", (6, 0, 0, 0), b"\xb0\x3f\x5f\x7f\x11\xd5\x0a\x3a", 0),), notes=(("System.Reflection", "AssemblyDescriptionAttribute", "Does much"),), wide=False, plus=False, many=0, key=b"", types=1):
    """An assembly with the tables that tell, and others before them; wide heaps and many rows change how wide columns are."""
    strings, blobs = Heap(b"\0" * (1 + (70_000 if wide else 0))), Heap(b"\0")
    s = "<I" if wide else "<H"
    text = lambda t: struct.pack(s, strings.add(t.encode() + b"\0")) if t else struct.pack(s, 0)
    sized = lambda b: bytes([len(b)]) + b if len(b) < 128 else struct.pack(">H", 0x8000 | len(b)) + b
    blob = lambda b: struct.pack("<H", blobs.add(sized(b)) if b else 0)
    big = lambda n, bits: "<I" if n >= 1 << 16 - bits else "<H"
    type_rows = types + len(notes)
    scope, parent = big(max(1, len(refs), type_rows), 2), big(type_rows, 3)
    tables = {0x00: [struct.pack("<H", 0) + text("m.dll") + struct.pack("<HHH", 1, 0, 0)]}
    tables[0x01] = [struct.pack(scope, 3) + text("T") + text("N")] * types + [struct.pack(scope, 3) + text(n) + text(space) for space, n, _ in notes]
    tables[0x0A] = [struct.pack(parent, (types + i + 1) << 3 | 1) + text(".ctor") + blob(b"\x20\x01\x01\x0e") for i in range(len(notes))]
    attributed = big(max(type_rows, len(notes), many, 1), 5)
    tables[0x0C] = [struct.pack(attributed, 1 << 5 | 14) + struct.pack(big(len(notes), 3), (i + 1) << 3 | 3) + blob(b"\x01\0" + sized(t.encode()) + b"\0\0") for i, (_, _, t) in enumerate(notes)]
    tables[0x04] = [struct.pack("<H", 1) + text("f") + blob(b"\x06\x08")] * many
    tables[0x20] = [struct.pack("<IHHHHI", 0x8004, *version, 1 if key else 0) + blob(key) + text(name) + text("")]
    tables[0x23] = [struct.pack("<HHHHI", *v, flags) + blob(token) + text(n) + text("") + blob(b"") for n, v, token, flags in refs]
    tables = {k: v for k, v in sorted(tables.items()) if v}
    stream = struct.pack("<IBBBBQQ", 0, 2, 0, 1 if wide else 0, 1, sum(1 << k for k in tables), 0) + b"".join(struct.pack("<I", len(v)) for v in tables.values()) + b"".join(b"".join(v) for v in tables.values())
    streams = [(b"#~", stream), (b"#Strings", strings.data), (b"#Blob", blobs.data), (b"#GUID", bytes(16))]
    head = b"BSJB" + struct.pack("<HHI", 1, 1, 0) + struct.pack("<I", 12) + b"v4.0.30319\0\0" + struct.pack("<HH", 0, len(streams))
    size = len(head) + sum(8 + len(n) // 4 * 4 + 4 for n, _ in streams)
    index, body = b"", b""
    for n, data in streams:
        index += struct.pack("<II", size + len(body), len(data)) + n.ljust(len(n) // 4 * 4 + 4, b"\0")
        body += data + bytes(-len(data) % 4)
    metadata = head + index + body
    runtime = struct.pack("<IHHII", 72, 2, 5, 0x2000 + 72, len(metadata)) + bytes(56)
    content = runtime + metadata
    optional = struct.pack("<H", 0x20B if plus else 0x10B) + bytes((112 if plus else 96) - 2) + bytes(8 * 14) + struct.pack("<II", 0x2000, 72) + bytes(8)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0x2102)
    section = b".text\0\0\0" + struct.pack("<IIII", len(content), 0x2000, len(content), 0x400) + bytes(16)
    return (b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x80)).ljust(0x80, b"\0") + (coff + optional + section).ljust(0x380, b"\0") + content


def told(spark, **own):
    long, purls = assemblies.facts(rec.records(spark.createDataFrame(list(own.items()), "id string, content binary"), "assembly"))
    facts = {}
    for r in long.collect():
        facts.setdefault(r.id, {})[r.key] = r.value
    return facts, {r.id: r.purl for r in purls.collect()}


def test_assemblies(spark):
    two = (("Z.Last", (1, 0, 0, 5), b"", 0), ("A.First", (2, 1, 0, 0), bytes(range(160)), 1))
    facts, purls = told(spark, plain=made(), wide=made(wide=True, plus=True), rows=made(many=70_000, types=9_000), keyed=made("K", (4, 0, 0, 7), two, key=bytes(160)), native=b"MZ".ljust(300, b"\0"), text=b"hello", empty=b"", null=None, cut=made()[:-40])
    token = "b03f5f7f11d50a3a"
    want = {"Name": "Lib.Core, Version=1.2.3.0, Culture=neutral, PublicKeyToken=null", "SimpleName": "Lib.Core", "Version": "1.2.3.0", "Description": "Does much", "Dependencies": json.dumps({"dependencies": [{"name": "System.Runtime", "version": "6.0.0.0", "public_key_token": token}]}, separators=(",", ":"))}
    assert facts["plain"] == facts["wide"] == facts["rows"] == want
    assert {k: purls[k] for k in ("plain", "wide", "rows", "keyed")} == {"plain": "pkg:nuget/Lib.Core@1.2.3", "wide": "pkg:nuget/Lib.Core@1.2.3", "rows": "pkg:nuget/Lib.Core@1.2.3", "keyed": "pkg:nuget/K@4.0.0.7"}
    depends = json.loads(facts["keyed"]["Dependencies"])["dependencies"]
    assert [d["name"] for d in depends] == ["A.First", "Z.Last"] and depends[0]["public_key"] == bytes(range(160)).hex() and len(depends[0]["public_key_token"]) == 16
    assert facts["keyed"]["PublicKey"] == bytes(160).hex() and not {"native", "text", "empty", "null"} & facts.keys()


def test_token_of_a_known_key(spark):
    """The key that the runtime's standard libraries share, and its published token."""
    facts, _ = told(spark, ecma=made(key=bytes.fromhex("00000000000000000400000000000000")))
    assert facts["ecma"]["Name"].endswith("PublicKeyToken=b77a5c561934e089")


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=30), st.integers(0, 1600))
def test_damage(noise, at):
    whole = made()
    try:
        assert sum(1 for _ in rec.assembly(whole[:at] + noise + whole[at + len(noise) :])) < 1000
    except (ValueError, KeyError, IndexError, struct.error):
        pass


@pytest.mark.parametrize("name", ["lib.dll"])
def test_build(spark, tmp_path, name):
    (tmp_path / name).write_bytes(made(key=bytes(range(100))))
    (tmp_path / "native.exe").write_bytes(b"MZ".ljust(300, b"\0"))
    builder = GraphBuilder(spark).with_folder(str(tmp_path))
    builder.run()
    facts = {(r.key, r.value) for r in builder.extra.collect()}
    assert ("SimpleName", "Lib.Core") in facts and ("PublicKey", bytes(range(100)).hex()) in facts and [r.purl for r in builder.purls.collect()] == ["pkg:nuget/Lib.Core@1.2.3"]
