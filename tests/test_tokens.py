"""Keys and certificates made here, byte by byte."""

import base64
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.tokens import certificate, certificate_facts, pem_certificates, ssh_facts, ssh_key


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def oid(text):
    a, b, *rest = map(int, text.split("."))
    out = bytes([40 * a + b])
    for n in rest:
        own = [n & 0x7F]
        while n := n >> 7:
            own.append(n & 0x7F | 0x80)
        out += bytes(own[::-1])
    return tlv(6, out)


def dn(cn):
    return tlv(0x30, tlv(0x31, tlv(0x30, oid("2.5.4.10"), tlv(0x0C, b"Org"))), tlv(0x31, tlv(0x30, oid("2.5.4.3"), tlv(0x0C, cn.encode()))))


def rsa(bits):
    key = tlv(0x30, tlv(2, b"\x00" + (1 << bits - 1 | 1).to_bytes(bits // 8, "big")), tlv(2, b"\x01\x00\x01"))
    return tlv(0x30, tlv(0x30, oid("1.2.840.113549.1.1.1"), tlv(5)), tlv(3, b"\x00", key))


def made(spki, issuer="A", subject="A", sig="1.2.840.113549.1.1.11"):
    dates = tlv(0x30, tlv(0x17, b"240101000000Z"), tlv(0x18, b"20500101000000Z"))
    algorithm = tlv(0x30, oid(sig))
    return tlv(0x30, tlv(0x30, tlv(0xA0, tlv(2, b"\x02")), tlv(2, b"\x0a\xbc"), algorithm, dn(issuer), dates, dn(subject), spki), algorithm, tlv(3, b"\x00sig"))


def test_certificate():
    spki = rsa(2048)
    raw = made(spki)
    got = certificate(raw)
    assert got == {
        "subject": "CN=A,O=Org", "issuer": "CN=A,O=Org", "serial": "0abc", "not_before": "2024-01-01T00:00:00Z", "not_after": "2050-01-01T00:00:00Z", "version": 3, "key_algorithm": "RSA", "key_size": 2048, "curve": None,
        "sig_algorithm": "SHA256withRSA", "self_signed": True, "cert_sha256": hashlib.sha256(raw).hexdigest(), "spki_sha256": hashlib.sha256(spki).hexdigest(),
    }
    ec = tlv(0x30, tlv(0x30, oid("1.2.840.10045.2.1"), oid("1.2.840.10045.3.1.7")), tlv(3, b"\x00\x04point"))
    got = certificate(made(ec, "A", "B", "1.2.3.4"))
    assert (got["key_algorithm"], got["curve"], got["self_signed"], got["sig_algorithm"]) == ("EC", "secp256r1", False, "<unknown-sig-oid-1.2.3.4>")


@pytest.mark.parametrize("cut", [0, 1, 5, 50, 200])
def test_damaged_certificates(cut):
    assert certificate(made(rsa(2048))[:cut]) is None
    assert certificate(b"\x30\x03abc") is None


def test_pem(spark):
    raw = made(rsa(1024))
    pem = "x\n-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(raw).decode() + "-----END CERTIFICATE-----\n"
    df = spark.createDataFrame([(pem + pem,), ("none",), (None,), ("-----BEGIN CERTIFICATE-----!!-----END CERTIFICATE-----",)], "t string")
    own = df.select(pem_certificates(df.t).alias("c")).collect()
    assert [len(r.c or []) for r in own] == [2, 0, 0, 0]
    got = df.select(F.explode(pem_certificates(df.t)).alias("c"))
    assert got.select(certificate_facts("c").alias("f")).select("f.key_size").collect()[0][0] == 1024


def test_ssh(spark):
    field = lambda b: struct.pack(">I", len(b)) + b
    blob = field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(b"\x00" + (1 << 3071 | 1).to_bytes(384, "big"))
    line = "ssh-rsa " + base64.b64encode(blob).decode() + " me@host two"
    got = ssh_key(line)
    assert (got["key_size"], got["comment"]) == (3072, "me@host two") and got["fingerprint"] == base64.b64encode(hashlib.sha256(blob).digest()).decode().rstrip("=")
    assert ssh_key('command="x" ' + line)["key_type"] == "ssh-rsa"
    for bad in (None, "", "# c", "ssh-rsa", "ssh-rsa !!!", "ssh-ed25519 " + base64.b64encode(blob).decode()):
        assert ssh_key(bad) is None
    df = spark.createDataFrame([(line,), ("x",), (None,)], "l string")
    assert [r.k for r in df.select(ssh_facts("l").key_size.alias("k")).collect()] == [3072, None, None]
