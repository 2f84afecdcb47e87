import io
import json
import struct
import tarfile
import gzip

from ledgerloom.builder import GraphBuilder
from ledgerloom.operators import manifests
from ledgerloom.sources import records

FILES = {
    "a/package.json": (json.dumps({"name": "@s/p", "version": "2", "license": "MIT", "author": {"name": "Me"}}), "pkg:npm/%40s/p@2"), "b/PKG-INFO": ("Metadata-Version: 2\nName: My_Pkg\nVersion: 1.0\nSummary: s\n", "pkg:pypi/my-pkg@1.0"),
    "c/Cargo.toml": ('[dependencies]\nname = "no"\n[package]\nversion = "0.1"\nname = "krate"\nauthors = ["A <a>"]\n', "pkg:cargo/krate@0.1"), "github.com/x/y@v1.2.3/go.mod": ("module github.com/x/y\n\ngo 1.20", "pkg:golang/github.com/x/y@v1.2.3"),
    "d/composer.json": (json.dumps({"name": "ven/dor", "version": "3", "license": ["MIT", "BSD"]}), "pkg:composer/ven/dor@3"), "e/META.json": (json.dumps({"name": "Foo-Bar", "version": "1", "abstract": "z"}), "pkg:cpan/Foo-Bar@1"),
    "info/index.json": (json.dumps({"name": "numpy", "version": "1.2"}), "pkg:conda/numpy@1.2"), "metadata.config": ('{<<"name">>,<<"jason">>}.\n{<<"version">>,<<"1.4.0">>}.\n{<<"licenses">>,[<<"Apache-2.0">>]}.', "pkg:hex/jason@1.4.0"),
    "P.podspec.json": (json.dumps({"name": "P", "version": "1", "license": {"type": "MIT"}}), "pkg:cocoapods/P@1"), "l-1.0-1.rockspec": ('package = "l"\nversion = "1.0-1"\ndescription = { summary = "s", license = "MIT" }', "pkg:luarocks/l@1.0-1"),
    "metadata.gz": ("--- !ruby/object:Gem::Specification\nname: rake\nversion: !ruby/object:Gem::Version\n  version: 13.0.6\nauthors:\n- Hiroshi\nlicenses:\n- MIT\nsummary: Make\n", "pkg:gem/rake@13.0.6"), "x/package.json": ("{}", None), "y/PKG-INFO": ("broken", None),
}


def test_language_ecosystems(spark):
    files = spark.createDataFrame([(p, p, t) for p, (t, _) in FILES.items()] + [("none", "none/package.json", None)], "id string, path string, text string")
    long, purls = manifests.facts(manifests.language_packages(files), True)
    assert {r.id: r.purl for r in purls.collect()} == {p: u for p, (_, u) in FILES.items() if u}
    facts = {(r.id, r.key, r.value) for r in long.collect()}
    assert {("a/package.json", "Publisher", "Me"), ("b/PKG-INFO", "Annatto:Ecosystem", "PyPi"), ("d/composer.json", "License", "MIT, BSD"), ("metadata.config", "License", "Apache-2.0"), ("P.podspec.json", "License", "MIT"), ("metadata.gz", "Publisher", "Hiroshi"), ("c/Cargo.toml", "Publisher", "A <a>"), ("l-1.0-1.rockspec", "Description", "s")} <= facts
    assert manifests.language_packages(files.limit(0)).count() == 0


def rpm_file(**own):
    tags = {"name": 1000, "version": 1001, "release": 1002, "summary": 1004, "size": 1009, "arch": 1022, "epoch": 1003, "names": 1027}
    index, store = b"", b""
    for k, v in own.items():
        number = isinstance(v, int)
        store += bytes(-len(store) % 4) if number else b""
        index += struct.pack(">IIII", tags[k], 4 if number else 6, len(store), 1)
        store += struct.pack(">I", v) if number else v.encode() + b"\0"
    header = lambda i, s: b"\x8e\xad\xe8\x01" + bytes(4) + struct.pack(">II", len(i) // 16, len(s)) + i + s
    return b"\xed\xab\xee\xdb".ljust(96, b"\0") + header(struct.pack(">IIII", 1000, 6, 0, 1), b"sig\0x") + bytes(-(96 + 37) % 8) + header(index, store)


def test_rpm_headers(spark):
    whole = rpm_file(name="bash", version="5.1", release="2.el9", summary="shell", size=7, arch="x86_64", epoch=1)
    own = spark.createDataFrame([("r", whole), ("cut", whole[:-9]), ("none", b"text"), ("null", None)], "id string, content binary")
    long, purls = manifests.facts(manifests.rpm_rows(records.records(own, "rpm")), False)
    assert {(r.id, r.purl) for r in purls.collect()} == {("r", "pkg:rpm/bash@5.1-2.el9?arch=x86_64&epoch=1")}
    assert {("r", "Name", "bash"), ("r", "Baharat:Release", "2.el9"), ("r", "Baharat:Installed_size", "7"), ("r", "Baharat:Epoch", "1")} <= {tuple(r) for r in long.collect()}


def tarred(**own):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in own.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_build_tells_packages_by_their_archives(spark, tmp_path):
    ar = lambda name, data: f"{name:<16}{0:<12}{0:<6}{0:<6}{100644:<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) % 2)
    info = b"pkgname = tool\npkgver = 1.0-1\narch = x86_64\npackager = P\n"
    files = {
        "hello.deb": b"!<arch>\n" + ar("debian-binary", b"2.0\n") + ar("control.tar.gz", gzip.compress(tarred(**{"./control": b"Package: hello\nVersion: 1:2.0\nArchitecture: amd64\n"}))), "rake.gem": tarred(**{"metadata.gz": gzip.compress(FILES["metadata.gz"][0].encode())}),
        "tool.apk": gzip.compress(tarred(**{".PKGINFO": info})), "tool.pkg.tar.gz": gzip.compress(tarred(**{".PKGINFO": info + b"# arch\n"})), "krate.crate": gzip.compress(tarred(**{"krate/Cargo.toml": FILES["c/Cargo.toml"][0].encode()})), "bash.rpm": rpm_file(name="bash", version="5", release="1", arch="noarch"),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    builder = GraphBuilder(spark).with_folder(str(tmp_path))
    items, _ = builder.run()
    by = {r.id: n.rpartition("/")[2] for r in items.collect() for n in r.file_names}
    assert {(by[r.id], r.purl) for r in builder.purls.collect()} == {
        ("hello.deb", "pkg:deb/debian/hello@1:2.0?arch=amd64"), ("rake.gem", "pkg:gem/rake@13.0.6"), ("tool.apk", "pkg:apk/alpine/tool@1.0-1?arch=x86_64"), ("tool.pkg.tar.gz", "pkg:alpm/arch/tool@1.0-1?arch=x86_64"), ("krate.crate", "pkg:cargo/krate@0.1"), ("bash.rpm", "pkg:rpm/bash@5-1?arch=noarch"),
    }
