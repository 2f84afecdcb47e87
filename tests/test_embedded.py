import base64
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.builder import GraphBuilder
from ledgerloom.operators import embedded
from tests.test_tokens import oid, rsa, tlv

NUMBER = b"\x00" + (1 << 2047 | 1).to_bytes(256, "big")
PKCS1 = tlv(0x30, tlv(2, b"\x00"), tlv(2, NUMBER), tlv(2, b"\x01\x00\x01"), tlv(2, b"SECRETEXPONENT"))
RSA_ID = tlv(0x30, oid("1.2.840.113549.1.1.1"), tlv(5))
EC_ID = tlv(0x30, oid("1.2.840.10045.2.1"), oid("1.2.840.10045.3.1.7"))


def pem(label, raw):
    return f"-----BEGIN {label}-----\n{base64.encodebytes(raw).decode()}-----END {label}-----\n"


def test_marks_across_cuts(spark):
    """Marks planted at, before and across every cut are each found once, at their places."""
    rng = random.Random(4)
    size, rows, want = 64, [], set()
    for n in range(40):
        data = bytearray(rng.randrange(128, 256) for _ in range(600))
        for mark in rng.sample(embedded.MARKS, 3):
            at = 64 * rng.randrange(1, 8) + rng.randrange(-30, 31)
            if all(abs(at - a) > 40 for i, _, a in want if i == n):
                data[at : at + len(mark)] = mark.encode()
                want.add((n, mark, at))
        rows.append((n, bytes(data)))
    rows += [(100, b""), (101, None), (102, b"X509Certificate"), (103, b"a" * 64), (104, b"X509CertificateX509Certificate")]
    want |= {(102, "X509Certificate", 0), (104, "X509Certificate", 0), (104, "X509Certificate", 15)}
    got = [tuple(r) for r in embedded.marks(spark.createDataFrame(rows, "id long, content binary"), size=size).select("id", "mark", "at").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys(spark):
    texts = {
        "pkcs1": pem("RSA PRIVATE KEY", PKCS1), "pkcs8": "x\n" + pem("PRIVATE KEY", tlv(0x30, tlv(2, b"\x00"), RSA_ID, tlv(4, PKCS1))), "ec": pem("EC PRIVATE KEY", tlv(0x30, tlv(2, b"\x01"), tlv(4, b"SECRETNUMBER"), tlv(0xA0, oid("1.3.132.0.34")))),
        "ec8": pem("PRIVATE KEY", tlv(0x30, tlv(2, b"\x00"), EC_ID, tlv(4, b"SECRETNUMBER"))), "public": pem("PUBLIC KEY", rsa(2048)), "encrypted": pem("ENCRYPTED PRIVATE KEY", b"0\x03abc"), "broken": pem("PRIVATE KEY", b"0\x82\xff"),
        "kube": "client-key-data: " + base64.b64encode(pem("RSA PRIVATE KEY", PKCS1).encode()).decode(), "none": "nothing", "null": None, "certificate": pem("CERTIFICATE", b"x"),
    }
    rows = spark.createDataFrame([(i, f"p/{i}", t) for i, t in texts.items()], "id string, path string, text string")
    facts: dict = {}
    for r in embedded.text_keys(rows).collect():
        facts.setdefault(r.id, {})[r.key.rpartition(":")[2]] = r.value
    digest = facts["pkcs1"]["derived_spki_sha256"]
    private = {"kind": "private-key", "key_algorithm": "rsa", "key_size": "2048", "derived_spki_sha256": digest, "DerivedFromPrivateKey": "true"}
    assert facts["pkcs1"] == private | {"source": "p/pkcs1"} and facts["pkcs8"] == private | {"source": "p/pkcs8"} and facts["kube"] == private | {"source": "p/kube"}
    assert facts["public"] == {"kind": "public-key", "key_algorithm": "rsa", "key_size": "2048", "derived_spki_sha256": digest, "source": "p/public"}  # of one key pair, one digest
    assert facts["ec"]["key_size"] == "384" and facts["ec8"]["key_size"] == "256" and facts["encrypted"] == {"kind": "private-key", "source": "p/encrypted"} == facts["broken"] | {"source": "p/encrypted"}
    assert not {"none", "null", "certificate"} & facts.keys() and not any("SECRET" in v for f in facts.values() for v in f.values())


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "PUBLIC KEY"]), st.binary(max_size=80))
def test_damage(label, raw):
    assert embedded.key_of(label, raw)["kind"] in ("private-key", "public-key")


def test_build(spark, tmp_path):
    for name, data in {"usr/lib/libssl.so.3": b"\x7fELF" + bytes(3000) + b"-----BEGIN CERTIFICATE-----" + bytes(50), "usr/lib/libz.so": b"\x7fELF" + bytes(99), "app/tool": b"\x7fELF" + bytes(99), "conf/all.txt": ("key:\n" + pem("RSA PRIVATE KEY", PKCS1)).encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    builder = GraphBuilder(spark).with_folder(str(tmp_path))
    items, _ = builder.run()
    by = {r.id: n.rpartition("/")[2] for r in items.collect() for n in r.file_names}
    facts = {(by[r.id], r.key, r.value) for r in builder.extra.collect()}
    assert {("libssl.so.3", "EmbeddedCertificates:Marker", "PEM certificate delimiters"), ("libz.so", "EmbeddedCertificates:NoPemMarkers", "true"), ("all.txt", "EmbeddedKey:key_size", "2048")} <= facts
    assert not any(f == "tool" for f, _, _ in facts)
