"""Certificates, lists, rings, SSH certificates and stores made here, byte by byte."""

import base64
import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import keymaterial as km
from ledgerloom.sources import records as rec
from tests.test_tokens import dn, oid, rsa, tlv

ALGORITHM = tlv(0x30, oid("1.2.840.113549.1.1.11"), tlv(5))


def extension(name, value, critical=False):
    return tlv(0x30, oid(name), tlv(1, b"\xff") if critical else b"", tlv(4, value))


EXTENSIONS = [
    extension("2.5.29.19", tlv(0x30, tlv(1, b"\xff")), True), extension("2.5.29.15", tlv(3, b"\x01\x86")), extension("2.5.29.37", tlv(0x30, oid("1.3.6.1.5.5.7.3.1"), oid("1.2.3.4.500"))),
    extension("2.5.29.17", tlv(0x30, tlv(0x82, b"a.example"), tlv(0x81, b"m@e.org"), tlv(0x87, bytes([10, 0, 0, 255])), tlv(0x87, bytes(15) + b"\x01"), tlv(0xA4, dn("x")), tlv(0x86, b"https://u"))),
    extension("1.3.6.1.5.5.7.1.1", tlv(0x30, tlv(0x30, oid("1.3.6.1.5.5.7.48.2"), tlv(0x86, b"http://issuer")), tlv(0x30, oid("1.3.6.1.5.5.7.48.1"), tlv(0x86, b"http://ocsp")))),
    extension("2.5.29.31", tlv(0x30, tlv(0x30, tlv(0xA0, tlv(0xA0, tlv(0x86, b"http://one")))), tlv(0x30, tlv(0xA0, tlv(0xA0, tlv(0x86, b"http://two")))))),
    extension("2.5.29.14", tlv(4, b"\x01\xab\xff")), extension("2.5.29.32", tlv(0x30, tlv(0x30, oid("2.23.140.1.2.1"), tlv(0x30, tlv(0x30, oid("1.3.6.1.5.5.7.2.1"), tlv(0x16, b"http://cps")))))),
]


def certified(extensions=tuple(EXTENSIONS), subject="A", version=True):
    dates = tlv(0x30, tlv(0x17, b"240101000000Z"), tlv(0x18, b"20500101000000Z"))
    more = tlv(0xA3, tlv(0x30, *extensions)) if extensions else b""
    return tlv(0x30, tlv(0x30, tlv(0xA0, tlv(2, b"\x02")) if version else b"", tlv(2, b"\x0a"), ALGORITHM, dn("I"), dates, dn(subject), rsa(1024), more), ALGORITHM, tlv(3, b"\x00sig"))


def crl(serials, version=True, number=None):
    listed = tlv(0x30, *(tlv(0x30, tlv(2, s.to_bytes(s.bit_length() // 8 + 1, "big")), tlv(0x17, b"240101000000Z")) for s in serials)) if serials else b""
    more = tlv(0xA0, tlv(0x30, extension("2.5.29.20", tlv(2, number.to_bytes(number.bit_length() // 8 + 1, "big"))))) if number else b""
    return tlv(0x30, tlv(0x30, tlv(2, b"\x01") if version else b"", ALGORITHM, dn("CA, one"), tlv(0x17, b"240203040506Z"), tlv(0x18, b"20500101000000Z"), listed, more), ALGORITHM, tlv(3, b"\x00sig"))


def contents(spark, **own):
    return spark.createDataFrame(list(own.items()), "id string, content binary")


def told(df, id_=None):
    return {r.key: r.value for r in df.collect() if id_ is None or r.id == id_}


def test_extensions(spark):
    own = contents(spark, full=certified(), none=certified(()), damaged=certified()[:-200], text=b"hello", empty=b"", null=None)
    facts = km.extension_facts(km.extensions(rec.records(own, "der")))
    assert told(facts, "full") == {
        "IsCA": "true", "KeyUsage": "digital-signature,key-cert-sign,crl-sign", "ExtendedKeyUsage": "server-auth,1.2.3.4.500", "SAN": "DNS:a.example,email:m@e.org,IP:10.0.0.255,IP:0:0:0:0:0:0:0:1,OTHER:DirectoryName,URI:https://u",
        "OcspUrl": "http://ocsp", "CrlDistributionPoints": "http://one,http://two", "SubjectKeyIdentifier": "01abff", "CertificatePolicies": "2.23.140.1.2.1",
    }
    assert {r.id for r in facts.collect()} <= {"full", "damaged"}
    names = {(r.id, r.name) for r in km.distinguished(rec.records(own, "der")).collect()}
    assert {("full", "CN=A,O=Org"), ("none", "CN=I,O=Org")} <= names


def test_certificate_rows(spark):
    one, two = certified(), certified((), "B")
    rows = [("single", 0, 1, one), ("bundle", 0, 2, one), ("bundle", 1, 2, two), ("bad", 0, 1, b"0\x03abc")]
    got = km.certificate_rows(spark.createDataFrame(rows, "id string, n int, total int, content binary"))
    single, bundle = told(got, "single"), told(got, "bundle")
    assert single["SAN"].startswith("DNS:a.example") and single["SubjectDN"] == "CN=A,O=Org" and single["CertSha256"] == hashlib.sha256(one).hexdigest()
    assert bundle["Cert:0:KeyUsage"] == single["KeyUsage"] and bundle["Cert:1:SubjectDN"] == "CN=B,O=Org" and "Cert:1:SAN" not in bundle
    assert {k: bundle[k] for k in ("KeystoreType", "EntryCount", "CertCount", "KeyEntryCount")} == {"KeystoreType": "pem-bundle", "EntryCount": "2", "CertCount": "2", "KeyEntryCount": "0"}
    assert told(got, "bad") == {}


def test_revocation_lists(spark):
    many = list(range(5, 12_500))
    own = contents(spark, small=crl([255, 0x8000, 1], number=1 << 70), old=crl([7], version=False), empty=crl([]), large=crl(many), no=b"\x30\x01")
    got = km.revocation_facts(rec.records(own, "der"))
    small = told(got, "small")
    assert small == {"IssuerDN": r"CN=CA\, one,O=Org", "ThisUpdate": "2024-02-03T04:05:06Z", "NextUpdate": "2050-01-01T00:00:00Z", "SigAlgorithm": "SHA256withRSA", "CrlNumber": str(1 << 70), "RevokedCount": "3", "RevokedSerials": "ff,8000,1"}
    assert told(got, "old")["RevokedSerials"] == "7" and told(got, "empty")["RevokedCount"] == "0" and "RevokedSerials" not in told(got, "empty")
    large = told(got, "large")
    assert large["RevokedCount"] == str(len(many)) and large["RevokedTruncated"] == "true" and large["RevokedSerials"].split(",") == [f"{s:x}" for s in many[:10_000]]
    assert told(got, "no") == {}


def s(*parts):
    return b"".join(struct.pack(">I", len(p)) + p for p in parts)


def ssh_cert(kind="ssh-ed25519", key=(b"k" * 32,), after=0, before=(1 << 64) - 1, serial=(1 << 64) - 2, use=1):
    ca = s(b"ssh-ed25519", b"c" * 32)
    return s(kind.encode() + b"-cert-v01@openssh.com", b"nonce", *key) + struct.pack(">QI", serial, use) + s(b"me@host", s(b"alice", b"bob")) + struct.pack(">QQ", after, before) + s(s(b"force-command", s(b"/bin/x")), s(b"permit-pty", b"", b"permit-x11", b""), b"", ca, s(b"rsa-sha2-512", b"sig"))


def test_ssh_certificates(spark):
    modulus = b"\x00" + (1 << 2047 | 1).to_bytes(256, "big")
    plain, host = ssh_cert(), ssh_cert("ssh-rsa", (b"\x01\x00\x01", modulus), 1_700_000_000, 1_800_000_000, 5, 2)
    own = contents(spark, plain=plain, host=host, cut=plain[:-30], key=s(b"ssh-ed25519", b"k"), other=ssh_cert("dsa-new"))
    got = km.ssh_certificate_facts(rec.records(own, "ssh"), own)
    printed = lambda b: "SHA-256:" + base64.b64encode(hashlib.sha256(b).digest()).decode().rstrip("=")
    assert told(got, "plain") == {
        "KeyAlgorithm": "ed25519", "SshFingerprintSha256": printed(s(b"ssh-ed25519", b"k" * 32)), "SshCertSha256": hashlib.sha256(plain).hexdigest(), "SshCertType": "user", "SshCertSerial": str((1 << 64) - 2), "SshCertKeyId": "me@host",
        "SshCertPrincipals": "alice,bob", "SshCertValidAfter": "always", "SshCertValidBefore": "forever", "SshCertCriticalOptions": "force-command", "SshCertExtensions": "permit-pty,permit-x11", "SshCertCaFingerprint": printed(s(b"ssh-ed25519", b"c" * 32)), "SshCertSigAlgorithm": "rsa-sha2-512",
    }
    assert told(got, "host").items() >= {"KeyAlgorithm": "rsa", "KeySize": "2048", "SshCertType": "host", "SshCertValidAfter": "2023-11-14T22:13:20Z", "SshFingerprintSha256": printed(s(b"ssh-rsa", b"\x01\x00\x01", modulus))}.items()
    assert {r.id for r in got.collect()} == {"plain", "host"}


def packet(tag, body, old=False):
    return bytes([0x80 | tag << 2 | 1]) + struct.pack(">H", len(body)) + body if old else bytes([0xC0 | tag, 255]) + struct.pack(">I", len(body)) + body


def mpi(bits):
    return struct.pack(">H", bits) + (1 << bits - 1).to_bytes((bits + 7) // 8, "big")


def test_key_rings(spark):
    key = b"\x04" + struct.pack(">I", 1_600_000_000) + b"\x01" + mpi(3072) + mpi(17)
    curve = oid("1.3.6.1.4.1.11591.15.1")[2:]
    sub = b"\x04" + struct.pack(">I", 1_600_000_001) + b"\x16" + bytes([len(curve)]) + curve + mpi(263)
    signed = lambda *parts: b"\x04\x13\x01\x08" + struct.pack(">H", sum(map(len, parts))) + b"".join(parts) + b"\x00\x00\xab\xcd"
    expires = b"\x05\x09" + struct.pack(">I", 86_400)
    ring = packet(6, key, True) + packet(13, b"Me <me@x.org>") + packet(2, signed(b"\x05\x02" + bytes(4), expires)) + packet(13, b"second") + packet(14, sub) + packet(2, signed())
    secret = packet(5, key + b"\x00" + mpi(3000) + b"SECRETSECRET")
    armored = b"-----BEGIN PGP PUBLIC KEY BLOCK-----\nVersion: x\n\n" + base64.encodebytes(ring) + b"=abcd\n-----END PGP PUBLIC KEY BLOCK-----\n"
    own = contents(spark, ring=ring, armored=armored, secret=secret, cut=ring[:-20], junk=b"\x01\x02", part=packet(6, key)[:2])
    rows = rec.records(own, "pgp")
    got = km.key_ring_facts(rows)
    first = hashlib.sha1(b"\x99" + struct.pack(">H", len(key)) + key).hexdigest()
    second = hashlib.sha1(b"\x99" + struct.pack(">H", len(sub)) + sub).hexdigest()
    a, b = f"Key:{first[:8]}:", f"Key:{second[:8]}:"
    want = {
        "PgpKeyCount": "2", a + "Fingerprint": first, a + "Version": "4", a + "KeyAlgorithm": "rsa", a + "KeySize": "3072", a + "IsPrimary": "true", a + "CreationTime": "2020-09-13T12:26:40Z", a + "ExpirationTime": "2020-09-14T12:26:40Z", a + "UserIds": "Me <me@x.org>,second",
        b + "Fingerprint": second, b + "Version": "4", b + "KeyAlgorithm": "ed25519", b + "Curve": "ed25519", b + "IsPrimary": "false", b + "CreationTime": "2020-09-13T12:26:41Z",
    }
    assert told(got, "ring") == told(got, "armored") == want
    assert told(got, "secret")[a + "Fingerprint"] == first
    assert not any(b"SECRET" in bytes(r.value or b"") for r in rows.collect())  # the walk gives no private part away
    assert told(got, "junk") == told(got, "part") == {}


def store(*entries, magic=0xFEEDFEED):
    text = lambda t: struct.pack(">H", len(t)) + t
    long = lambda b: struct.pack(">I", len(b)) + b
    out = b""
    for alias, certs, key in entries:
        held = b"".join(text(b"X.509") + long(c) for c in certs)
        out += struct.pack(">I", 1 if key else 2) + text(alias) + bytes(8) + (long(b"PRIVATE" * 9) + struct.pack(">I", len(certs)) if key else b"") + held
    return struct.pack(">III", magic, 2, len(entries)) + out + bytes(20)


def test_key_stores(spark):
    root, leaf = certified((), "root"), certified((), "leaf")
    jks = store((b"my key", [leaf, root], True), (b"ca", [root], False))
    own = contents(spark, jks=jks, cut=jks[:-500], jce=store((b"x", [root], False), magic=0xCECECECE), empty=store(), p12=tlv(0x30, tlv(2, b"\x03")))
    rows = rec.records(own, "store")
    got = km.store_facts(rows, own)
    jks = told(got, "jks")
    assert jks.items() >= {"KeystoreType": "jks", "EntryCount": "2", "KeyEntryCount": "1", "CertCount": "3", "Entry:my+key:Chain:0:SubjectDN": "CN=leaf,O=Org", "Entry:my+key:Chain:1:SubjectDN": "CN=root,O=Org", "Entry:ca:SubjectDN": "CN=root,O=Org", "Entry:my+key:KeyAlgorithm": "RSA", "Entry:my+key:KeySize": "1024"}.items()
    assert told(got, "cut") == {"KeystoreType": "jks", "KeystoreEncrypted": "true"}
    assert told(got, "jce").items() >= {"KeystoreType": "jceks", "EntryCount": "1"}.items() and told(got, "empty") == {"KeystoreType": "jks", "EntryCount": "0", "KeyEntryCount": "0", "CertCount": "0"}
    assert told(got, "p12") == {"KeystoreType": "pkcs12", "KeystoreEncrypted": "true"}
    assert not any(b"PRIVATE" in bytes(r.value or b"") for r in rows.collect())


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(rec.WALKS)), st.binary(max_size=60), st.integers(0, 1400))
def test_damage_ends_a_walk(kind, noise, at):
    """No content makes a walk go on for ever or fail with anything but what ``records`` catches."""
    whole = {"der": certified(), "ssh": ssh_cert(), "pgp": packet(6, b"\x04\x00\x00\x00\x00\x01" + mpi(512) + mpi(17)), "store": store((b"a", [certified(())], True))}[kind]
    data = whole[:at] + noise + whole[at + len(noise) :]
    try:
        assert sum(1 for _ in rec.WALKS[kind](data)) < 5_000
    except (ValueError, IndexError, struct.error):
        pass


def test_numbers(spark):
    values = [0, 1, 255, 1 << 63, (1 << 120) - 1]
    rows = spark.createDataFrame([(v.to_bytes(15, "big"),) for v in values] + [(bytes(16),), (b"",)], "v binary")
    assert [r.n for r in rows.select(km.number(F.col("v")).cast("string").alias("n")).collect()] == [str(v) for v in values] + [None, "0"]
    ids = ["2.5.29.17", "1.2.840.113549.1.1.11", "0.9.2342.19200300.100.1.25", "2.999.3", "1.3.6.1.4.1.11591.15.1"]
    raw = [oid(i)[2:] if not i.startswith("2.999") else b"\x88\x37\x03" for i in ids]
    assert [r.i for r in spark.createDataFrame([(r,) for r in raw], "v binary").select(km.identifier(F.col("v")).alias("i")).collect()] == ids


@pytest.mark.parametrize("kind", sorted(rec.WALKS))
def test_empty_table(spark, kind):
    assert rec.records(contents(spark, a=None).limit(0), kind).count() == 0


def test_build_reads_all_kinds(spark, tmp_path):
    from ledgerloom.builder import GraphBuilder

    pem = lambda label, *blobs: "".join(f"-----BEGIN {label}-----\n{base64.encodebytes(b).decode()}-----END {label}-----\n" for b in blobs)
    key = b"\x04" + struct.pack(">I", 1_600_000_000) + b"\x01" + mpi(3072) + mpi(17)
    files = {
        "one.pem": pem("CERTIFICATE", certified()).encode(), "two.pem": pem("CERTIFICATE", certified(), certified((), "B")).encode(), "raw.der": certified((), "C"), "list.crl": crl([5, 6]), "list.pem": pem("X509 CRL", crl([7])).encode(),
        "ring.gpg": packet(6, key) + packet(13, b"Me"), "host-cert.pub": b"ssh-ed25519-cert-v01@openssh.com " + base64.b64encode(ssh_cert()) + b" note\n", "store.jks": store((b"ca", [certified((), "D")], False)), "broken.der": b"\x30\x82\xff",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    builder = GraphBuilder(spark).with_folder(str(tmp_path))
    items, _ = builder.run()
    by = {r.id: n.rpartition("/")[2] for r in items.collect() for n in r.file_names}
    facts = {(by[r.id], r.key.removeprefix("Certificates:"), r.value) for r in builder.extra.collect()}
    assert {
        ("one.pem", "SAN", "DNS:a.example,email:m@e.org,IP:10.0.0.255,IP:0:0:0:0:0:0:0:1,OTHER:DirectoryName,URI:https://u"), ("two.pem", "Cert:1:SubjectDN", "CN=B,O=Org"), ("two.pem", "CertCount", "2"), ("raw.der", "SubjectDN", "CN=C,O=Org"),
        ("list.crl", "RevokedSerials", "5,6"), ("list.pem", "RevokedSerials", "7"), ("ring.gpg", "PgpKeyCount", "1"), ("host-cert.pub", "SshCertKeyId", "me@host"), ("store.jks", "Entry:ca:SubjectDN", "CN=D,O=Org"),
    } <= facts
    assert not any(f == "broken.der" for f, _, _ in facts)
    assert sum(p.startswith("pkg:generic/x509/") for p in {r.purl for r in builder.purls.collect()}) == 1  # all have one key
