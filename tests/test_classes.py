import io
import shutil
import struct
import subprocess
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.builder import GraphBuilder
from ledgerloom.operators import classes
from ledgerloom.sources import records as rec


def utf(t):
    return b"\x01" + struct.pack(">H", len(t)) + t


def class_bytes(name, source=None, members=1):
    """A class with numbers of all widths, an interface, a field and methods with attributes of their own."""
    pool = [utf(name), b"\x07\x00\x01", b"\x05" + bytes(8), None, b"\x06" + bytes(8), None, utf(b"SourceFile"), utf(source or b"none"), utf(b"Code"), b"\x03" + bytes(4), b"\x0f\x01\x00\x01", b"\x12\x00\x00\x00\x01", b"\x08\x00\x01"]
    member = struct.pack(">HHHHHI", 1, 9, 9, 1, 9, 5) + b"12345"
    own = struct.pack(">H", members) + member * members
    attributes = struct.pack(">HHI", 2, 9, 3) + b"abc" + struct.pack(">HIH", 7, 2, 8) if source else struct.pack(">H", 0)
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 65, len(pool) + 1) + b"".join(x for x in pool if x) + struct.pack(">HHHHH", 0x21, 2, 0, 1, 2) + own + own + attributes


def facts(spark, **own):
    rows = rec.records(spark.createDataFrame(list(own.items()), "id string, content binary"), "class")
    return {r.id: (r.class_name, r.source_path) for r in classes.class_facts(rows).collect()}


def test_class_files(spark):
    whole = class_bytes(b"com/example/Foo$1", b"Foo.java")
    got = facts(spark, inner=whole, plain=class_bytes(b"Top", b"Top.java", 0), bare=class_bytes(b"a/B"), cut=whole[:-4], text=b"hello", empty=b"", null=None)
    assert got == {"inner": ("com/example/Foo$1", "com/example/Foo.java"), "plain": ("Top", "Top.java"), "bare": ("a/B", None), "cut": ("com/example/Foo$1", None)}


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 260))
def test_damage(noise, at):
    whole = class_bytes(b"com/example/Foo", b"Foo.java")
    try:
        assert sum(1 for _ in rec.java_class(whole[:at] + noise + whole[at + len(noise) :])) < 100
    except (ValueError, KeyError, IndexError, struct.error):
        pass


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), data)
    return out.getvalue()


def test_classes_of_a_build(spark, tmp_path):
    """A jar beside its sources gives edges to them; the same classes elsewhere, or inside a bundle with its own sources, by their own companions."""
    foo, bar = class_bytes(b"p/Foo", b"Foo.java"), class_bytes(b"p/Bar", b"Bar.java")
    jar = zipped({"p/Foo.class": foo, "p/Foo$1.class": class_bytes(b"p/Foo$1", b"Foo.java"), "p/Bar.class": bar, "p/Gone.class": class_bytes(b"p/Gone", b"Gone.java")})
    sources = zipped({"p/Foo.java": b"class Foo {}", "p/Bar.java": b"class Bar {}", "Gone.java": b"elsewhere"})
    inner = zipped({"lib/q-1.jar": zipped({"p/Foo.class": foo}), "lib/q-1-sources.jar": zipped({"p/Foo.java": b"class Foo { int x; }"})})
    for name, data in {"m2/a-1.0.jar": jar, "m2/a-1.0-sources.jar": sources, "other/b-1.0.jar": zipped({"z/Bar.class": class_bytes(b"z/Bar", b"Bar.java")}), "bundle.zip": inner}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    items, edges = GraphBuilder(spark).with_folder(str(tmp_path)).run()
    names = {r.id: sorted(r.file_names) for r in items.collect()}
    built = {(names[r.src][0], names[r.dst][0]) for r in edges.filter("edge_type = 'build:down'").collect()}
    assert built == {("p/Foo.class", "p/Foo.java"), ("p/Foo$1.class", "p/Foo.java"), ("p/Bar.class", "p/Bar.java")}
    assert edges.filter("edge_type = 'build:down'").count() == edges.filter("edge_type = 'build:up'").count() == 4  # Foo was built from either source


@pytest.mark.skipif(not shutil.which("javac"), reason="needs a compiler")
def test_compiled(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "A.java").write_text("package p; public class A { long x = 5L; double y = 2.5; class B {} public static void main(String[] a) { Runnable r = () -> System.out.println(\"x\" + a.length); r.run(); } }")
    (tmp_path / "module-info.java").write_text("module m.one { requires java.logging; exports p; uses java.lang.Runnable; }")
    subprocess.run(["javac", "-d", "out", "p/A.java", "module-info.java"], cwd=tmp_path, check=True)
    read = lambda n: (tmp_path / "out" / n).read_bytes()
    assert facts(spark, a=read("p/A.class"), b=read("p/A$B.class")) == {"a": ("p/A", "p/A.java"), "b": ("p/A$B", "p/A.java")}
    rows = rec.records(spark.createDataFrame([("m", read("module-info.class"))], "id string, content binary"), "class")
    got = {r.key: r.value for r in classes.module_facts(rows).collect()}
    assert got["AutomaticModuleName"] == "m.one" and got["ModuleExports"] == '["p"]' and "java.logging" in got["ModuleRequires"] and got["ModuleUses"] == '["java.lang.Runnable"]'
