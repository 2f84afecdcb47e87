"""Column functions on single values: what the queries' fixed lists leave out."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import crypto, identity, packages, textual


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("commons-lang3-3.12.0.jar", (None, "commons-lang3", "3.12.0")), ("org.apache.foo-1.2.jar", ("org.apache", "foo", "1.2")), ("lib_2.13-1.0.jar", (None, "lib_2.13", "1.0")),
        ("noversion.jar", (None, None, None)), ("-1.jar", (None, None, None)), ("a--2.jar", (None, "a-", "2")), ("a-b-10-x-2.jar", (None, "a-b", "10-x-2")), ("", (None, None, None)),
        ("guava-31.1-jre.jar", (None, "guava", "31.1-jre")), (".jar", (None, None, None)), ("x-1", (None, "x", "1")), ("a9-b-c", (None, None, None)),
    ],
)
def test_coordinates(spark, name, want):
    own = value(spark, packages.coordinates, name)
    assert (own.group_id, own.artifact_id, own.version) == want


def test_identity(spark):
    text = "héllo\x00"
    raw = text.encode()
    want = "gitoid:blob:sha256:" + hashlib.sha256(b"blob %d\0" % len(raw) + raw).hexdigest()
    assert value(spark, identity.gitoid, text) == want
    assert value(spark, identity.name_uuid, want) == str(uuid.UUID(bytes=hashlib.md5(want.encode()).digest(), version=3))
    assert value(spark, identity.aliases, "")[2] == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert value(spark, identity.gitoid, None) is None


def test_tree_identity_ignores_order(spark):
    ids = ["gitoid:blob:sha256:" + hashlib.sha256(bytes([i])).hexdigest() for i in range(4)]
    df = spark.createDataFrame([(ids,), (ids[::-1],)], "i array<string>")
    a, b = [r.t for r in df.select(identity.tree_gitoid(F.col("i")).alias("t")).collect()]
    raw = b"".join(bytes.fromhex(i[-64:]) for i in sorted(ids))
    assert a == b == "gitoid:tree:sha256:" + hashlib.sha256(b"tree %d\0" % len(raw) + raw).hexdigest()


@pytest.mark.parametrize(("name", "kind"), [("SHA512/224", "hash"), ("hmacSHA9", "mac"), ("3DES", "block-cipher"), ("ECDHE", "key-agree"), ("scrypt", "hash"), ("X25519", "key-agree"), ("", "other"), (None, "other")])
def test_primitive(spark, name, kind):
    assert value(spark, crypto.primitive, name) == kind


def test_purl(spark):
    df = spark.createDataFrame([("a b+c", "1:2~x", "n/s")], "n string, v string, g string")
    assert df.select(packages.purl("maven", F.col("n"), F.col("v"), F.col("g"), F.lit("type=pom"))).first()[0] == "pkg:maven/n%2Fs/a%20b%2Bc@1:2~x?type=pom"
    assert df.select(packages.purl("maven", F.col("n"), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0] == "pkg:maven/a%20b%2Bc"


def test_dates(spark):
    assert value(spark, textual.date, "yesterday") < value(spark, textual.date, "now")
    assert value(spark, textual.date, None) is None and value(spark, textual.build_date, "9" * 30) is None


def test_checksum_line(spark):
    own = value(spark, textual.checksum_line, "golang.org/x/crypto v0.1 h1:abc=")
    assert (own.name, own.version) == ("golang.org/x/crypto", "v0.1") and value(spark, textual.checksum_line, "one") is None
