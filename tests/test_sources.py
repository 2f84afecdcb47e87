import bz2
import gzip
import io
import json
import lzma
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.builder import GraphBuilder
from ledgerloom.operators import cbom, graph
from ledgerloom.sources import cbor, clusters, files
from ledgerloom.sources.archives import members
from ledgerloom.streaming.upsert import compacted, current, upsert


def zipped(**own):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in own.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), data)
    return out.getvalue()


def tarred(**own):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in own.items():
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1000
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def cpio(**own):
    out = b""
    for name, data in [*own.items(), ("TRAILER!!!", b"")]:
        raw = name.encode() + b"\0"
        out += b"070701" + b"".join(b"%08x" % n for n in (0, 0o100644, 0, 0, 1, 7, len(data), 0, 0, 0, 0, len(raw), 0)) + raw
        out += b"\0" * (-len(out) % 4) + data
        out += b"\0" * (-len(out) % 4)
    return out


def iso(name, data):
    record = lambda n, where, size, flags: bytes([33 + len(n) + (len(n) + 1) % 2, 0]) + struct.pack("<I", where) + struct.pack(">I", where) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([flags, 0, 0]) + bytes(4) + bytes([len(n)]) + n + b"\0" * ((len(n) + 1) % 2)
    folder = record(b"\x00", 18, 2048, 2) + record(b"\x01", 18, 2048, 2) + record(name, 19, len(data), 0)
    volume = b"\x01CD001\x01".ljust(156, b"\0") + record(b"\x00", 18, 2048, 2)
    return bytes(16 * 2048) + volume.ljust(2048, b"\0") + b"\xffCD001".ljust(2048, b"\0") + folder.ljust(2048, b"\0") + data


def rpm(payload):
    head = b"\x8e\xad\xe8\x01" + bytes(4) + struct.pack(">II", 0, 0)
    return b"\xed\xab\xee\xdb".ljust(96, b"\0") + head + head + payload


DEB = b"!<arch>\n" + b"debian-binary/  " + b"12          0     0     100644  4         `\n2.0\n"


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (zipped(a=b"1"), {"a": b"1"}), (tarred(a=b"1", b=b""), {"a": b"1", "b": b""}), (gzip.compress(tarred(a=b"1")), {"a": b"1"}), (bz2.compress(tarred(a=b"1")), {"a": b"1"}),
        (lzma.compress(cpio(x=b"abc")), {"x": b"abc"}), (cpio(x=b"abc", y=b"z"), {"x": b"abc", "y": b"z"}), (rpm(gzip.compress(cpio(f=b"q"))), {"f": b"q"}), (iso(b"FILE.TXT;1", b"hello"), {"file.txt": b"hello"}),
        (DEB, {"debian-binary": b"2.0\n"}), (gzip.compress(b"plain"), {"": b"plain"}), (b"PK\x03\x04broken", {}),
    ],
)
def test_readers(data, want):
    assert {n: d for n, d, _ in members(data)} == want


def test_no_containers():
    for data in (b"", b"text", b"\x1f\x8bbroken", b"BZhxx"):
        assert members(data) is None


@pytest.fixture(scope="module")
def payload(tmp_path_factory):
    root = tmp_path_factory.mktemp("payload")
    inner = zipped(**{"deep.txt": b"deep", "same.txt": b"same"})
    (root / "one.jar").write_bytes(zipped(**{"inner.zip": inner, "same.txt": b"same"}))
    (root / "two.tgz").write_bytes(gzip.compress(tarred(**{"./x/inner.zip": inner, "only.json": b'{"a": 1}'})))
    (root / "plain.txt").write_text("-----BEGIN CERTIFICATE-----")
    (root / ".hidden").write_text("no")
    (root / "skip.log").write_text("no")
    return root


def test_build(spark, payload, tmp_path):
    builder = GraphBuilder(spark).with_folder(str(payload)).with_exclude(r"\.log$").with_tag("t").with_output(str(tmp_path / "graph"))
    items, edges = builder.run()
    names = {n: r.id for r in items.collect() for n in r.file_names}
    assert {n.rpartition("/")[2] for n in names} == {"one.jar", "two.tgz", "plain.txt", "inner.zip", "same.txt", "deep.txt", "only.json"}
    up = {(r.src, r.dst) for r in edges.filter("edge_type = 'contained:up'").collect()}
    by = {n.rpartition("/")[2]: i for n, i in names.items()}
    assert {(by["inner.zip"], by["one.jar"]), (by["inner.zip"], by["two.tgz"]), (by["deep.txt"], by["inner.zip"])} <= up
    own = {r.id for r in graph.roots(items, edges).collect()}
    assert own == {by["one.jar"], by["two.tgz"], by["plain.txt"]}
    types = {r.id: r.mime_types for r in items.collect()}
    assert "application/java-archive" in types[by["one.jar"]] and "application/x-pem-file" in types[by["plain.txt"]] and "application/json" in types[by["only.json"]]
    assert clusters.item_by_id(spark, str(tmp_path / "graph"), by["deep.txt"]).count() == 1
    again, _ = GraphBuilder(spark).with_folder(str(payload)).with_exclude(r"\.log$").run()
    assert {r.id for r in again.collect()} == {r.id for r in items.collect() if not r.id.startswith("tags")} - {r.id for r in items.filter("body_mime like '%.tag'").collect()}


def test_block_list_and_cutoff(spark, payload, tmp_path):
    whole, edges = GraphBuilder(spark).with_folder(str(payload)).run()
    inner = next(r.id for r in whole.collect() if any(n.endswith("inner.zip") for n in r.file_names))
    (tmp_path / "block").write_text(f"{inner}\n")
    (tmp_path / "list").write_text(f"{payload}/one.jar\n{payload}/missing\n")
    some, _ = GraphBuilder(spark).with_file_list(str(tmp_path / "list")).with_block_list(str(tmp_path / "block")).run()
    assert {n.rpartition("/")[2] for r in some.collect() for n in r.file_names} == {"one.jar", "same.txt"}
    none, rest = GraphBuilder(spark).with_file_list(str(tmp_path / "list")).with_cutoff("2019-01-01").run()
    assert none.count() == 0 and rest.count() == 0
    with pytest.raises(ValueError):
        GraphBuilder(spark).with_cutoff("whenever")


def test_cbor():
    for x in (None, True, 0, 23, 24, 255, 256, 70000, 1 << 40, -1, -500, "é", b"\x00", [1, [2]], {"a": {"b": None}}, "x" * 300):
        assert cbor.decode(cbor.encode(x))[0] == x
    assert cbor.decode(b"\x9f\x01\x02\xff")[0] == [1, 2] and cbor.decode(b"\xbf\x61a\x01\xff")[0] == {"a": 1}


def test_cluster_round_trip(spark, payload, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "ROLLOVER", 600)
    items, edges = GraphBuilder(spark).with_folder(str(payload)).run()
    extra = spark.createDataFrame([(items.first().id, "k", None, "v"), (items.first().id, "k", "m", "w")], "id string, key string, mime string, value string")
    rows = clusters.nested(items, edges, extra)
    path = clusters.export_cluster(rows, str(tmp_path / "c"))
    got = {r.id: (sorted(r.file_names), r.file_size, sorted((c.edge_type, c.target) for c in r.connections)) for r in clusters.read_cluster(spark, path).collect()}
    want = {r.id: (sorted(r.file_names or []), r.file_size if r.body_mime else None, sorted((c.edge_type, c.target) for c in r.connections or [])) for r in rows.collect()}
    assert got == want and len(list((tmp_path / "c").glob("*.grd"))) > 1
    damaged = next((tmp_path / "c").glob("*.grd"))
    damaged.write_bytes(damaged.read_bytes() + b"x")
    with pytest.raises(ValueError):
        clusters.read_cluster(spark, path)


def test_stream_replays_are_harmless(spark, payload, tmp_path):
    files.scan(spark, str(payload)).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    once = sorted(map(str, current(spark, str(tmp_path / "out"))[0].collect()))
    upsert(stream(), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(map(str, current(spark, str(tmp_path / "out"))[0].collect())) == once and len(once) == 4
    compacted(spark, str(tmp_path / "out"), str(tmp_path / "small"))
    assert sorted(map(str, current(spark, str(tmp_path / "small"))[0].collect())) == once


def test_cbom(spark):
    extra = spark.createDataFrame([("a", "Certificates:KeyAlgorithm", None, "RSA-2048"), ("b", "JWT:alg", None, "SHA256withRSA"), ("b", "maven:x", None, "y"), ("c", "Name", None, "n")], "id string, key string, mime string, value string")
    assert {r.id for r in cbom.crypto_items(extra).collect()} == {"a", "b"}
    found = spark.createDataFrame([("r:/1", "a", 1), ("r:/1", "b", 2), ("r:/1", "a", 3)], "root string, id string, depth int")
    parts = cbom.capped(cbom.algorithm_components(found, extra))
    doc = cbom.documents(parts, "2024-01-01T00:00:00Z").first()
    own = json.loads(doc.document)
    assert doc.file_name == "cbom_r__1.json" and own["specVersion"] == "1.6" and [c["bom-ref"] for c in own["components"]] == ["alg:hash:sha256withrsa", "alg:pke:rsa-2048"]
    assert own["components"][1]["cryptoProperties"]["algorithmProperties"]["parameterSetIdentifier"] == "2048"
    assert cbom.capped(parts, 1).filter(F.col("truncated")).count() == 1


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    """A jar with a manifest and a nested jar, its project file, a lockfile, a service's configuration and a tar with a password file."""
    root = tmp_path_factory.mktemp("project")
    pom = "<project><groupId>org.foo</groupId><artifactId>bar</artifactId><version>1.2</version><name>Bar</name></project>"
    manifest = b"Manifest-Version: 1.0\r\nAutomatic-Module-Name: org.foo.bar\r\n"
    (root / "org.foo.bar-1.2.jar").write_bytes(zipped(**{"META-INF/MANIFEST.MF": manifest, "lib/inner.jar": zipped(a=b"x"), "META-INF/services/org.foo.Api": b"org.foo.Impl"}))
    (root / "bar-1.2.pom").write_text(pom)
    (root / "requirements.txt").write_text("cryptography==41.0\nflask==1.0\n")
    (root / "nginx.conf").write_text("ssl_protocols TLSv1.2 TLSv1.3;\nssl_ciphers AES128-SHA:HIGH;\n")
    (root / "layer.tar").write_bytes(tarred(**{"etc/shadow": b"root:$6$salt$hash:19000:0:::::\n"}))
    return root


def test_build_from_files_to_bills(spark, project, tmp_path):
    """Claims, metadata, package URLs, archive facts, tags, the written tables and the bills of one folder."""
    builder = GraphBuilder(spark).with_folder(str(project)).with_tag("run").with_package_tags().with_bills(str(tmp_path / "bills")).with_output(str(tmp_path / "graph")).with_ingested_list(str(tmp_path / "read"))
    items, edges = builder.run()
    by = {n.rpartition("/")[2]: r.id for r in items.collect() for n in r.file_names or []}
    facts = {(r.id, r.key, r.value) for r in builder.extra.collect()}
    jar, layer = by["org.foo.bar-1.2.jar"], by["layer.tar"]
    assert {
        (jar, "maven:AutomaticModuleName", "org.foo.bar"), (jar, "maven:NestedJars", "lib/inner.jar"), (jar, "maven:ServiceProviders", "org.foo.Api"), (by["bar-1.2.pom"], "Name", "Bar"),
        (by["requirements.txt"], "CryptoDependency:name", "cryptography"), (by["nginx.conf"], "TLSConfig:algorithms", "aes-128-cbc"), (by["shadow"], "PasswordHash:Algorithm", "sha512"),
    } <= facts
    purls = {(r.id, r.purl) for r in builder.purls.collect()}
    assert (by["bar-1.2.pom"], "pkg:maven/org.foo/bar@1.2?type=pom") in purls
    links = {tuple(r) for r in edges.select("src", "edge_type", "dst").collect()}
    assert {(i, "alias:from", p) for i, p in purls} | {(p, "alias:to", i) for i, p in purls} <= links
    tags = [r.id for r in items.filter("body_mime like '%.tag'").collect()]
    assert len(tags) == 1 + len({p.partition("?")[0] for i, p in purls if i in by.values()}) and all((t, "tag:from", "tags") in links and ("tags", "tag:to", t) in links for t in tags)
    bills = {r.root: json.loads(r.document) for r in builder.bills.collect()}
    assert {c["name"].lower() for c in bills[layer]["components"]} == {"sha512", by["shadow"]} and bills[layer]["bomFormat"] == "CycloneDX" and jar not in bills
    assert len(list((tmp_path / "bills").glob("cbom_*.json"))) == len(bills) >= 2
    assert {r.value for r in spark.read.text(str(tmp_path / "graph/purls")).collect()} == {p for _, p in purls}
    assert spark.read.parquet(str(tmp_path / "graph/extra")).count() == len(facts) and spark.read.text(str(tmp_path / "read")).count() == 5
    rows = clusters.nested(items, edges, builder.extra)
    read = clusters.read_cluster(spark, clusters.export_cluster(rows, str(tmp_path / "c")))
    assert {(r.id, k, v.value) for r in read.collect() for k, values in (r.extra or {}).items() for v in values} == {f for f in facts}
    clusters.dump(items, edges, str(tmp_path / "dump"), builder.extra)
    assert spark.read.json(str(tmp_path / "dump")).count() == rows.count()
    clusters.dump_roots(items, edges, str(tmp_path / "roots"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "roots")).collect()] == sorted(r.id for r in graph.roots(items, edges).collect())


def test_types_of_long_texts(spark):
    """Multi-byte characters at the end of what is looked at, and marks far behind the beginning."""
    from ledgerloom.functions.mime import PROBE, mime_types

    contents = {"a.txt": ("a" + "é" * 3000).encode(), "b.txt": ("a" + "é" * PROBE).encode(), "c.pem": ("# " + "x" * 9000 + "\n-----BEGIN CERTIFICATE-----").encode(), "d.bin": b"\xff" * 5000, "e.crl": b"0\x82\x01\x00" + b"x" * 300, "f": b"", "g.asc": b"-----BEGIN PGP PUBLIC KEY BLOCK-----", "h.img": b"KDMV" + bytes(600)}
    df = spark.createDataFrame(list(contents.items()), "path string, content binary")
    got = {r.path: r.t for r in df.select("path", mime_types(F.col("content"), F.col("path")).alias("t")).collect()}
    assert got["a.txt"] == got["b.txt"] == ["text/plain"] and "application/x-pem-file" in got["c.pem"]
    assert got["d.bin"] == got["f"] == ["application/octet-stream"] and "application/pkix-crl" in got["e.crl"]
    assert "application/pgp-keys" in got["g.asc"] and "application/x-vmdk" in got["h.img"]


def test_deep_nesting_is_opened(spark, tmp_path):
    data = b"bottom"
    for _ in range(3):
        data = zipped(**{"in.zip": data})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "top.zip").write_bytes(data)
    assert files.expand(files.scan(spark, str(tmp_path / "in"))).count() == 4
    assert files.expand(files.scan(spark, str(tmp_path / "in")), most=1).count() == 2
