"""Tokens, keys and certificates: what their bytes tell."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JWT = r"\beyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){1,2}\b"


def jwt_algorithms(text: Column) -> Column:
    """the algorithms that the headers of the text's tokens name."""
    tokens = F.regexp_extract_all(text, F.lit("(?i)(" + JWT + ")"), 1)

    def header(t: Column) -> Column:
        raw = F.translate(F.substring_index(t, ".", 1), "-_", "+/")
        padded = F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), "=")
        return F.get_json_object(F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64"))), "$.alg")

    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, header), lambda a: a.isNotNull())))


def jwk_facts(text: Column) -> Column:
    """type, curve and use of a JSON key, and whether it holds a private part; never the part itself."""
    one = lambda k: F.get_json_object(text, f"$.{k}")
    return F.when(one("kty").isNotNull(), F.struct(one("kty").alias("kty"), one("crv").alias("crv"), one("use").alias("use"), one("d").isNotNull().alias("private_present")))


def ssh_fields(blob: bytes) -> Iterator[bytes]:
    at = 0
    while at + 4 <= len(blob):
        n = struct.unpack(">I", blob[at : at + 4])[0]
        if at + 4 + n > len(blob):
            return
        yield blob[at + 4 : at + 4 + n]
        at += 4 + n


def ssh_key(line: str | None) -> dict | None:
    """type, size, curve, fingerprint and comment of a public key line, None for other lines."""
    parts = (line or "").split()
    at = next((i for i, p in enumerate(parts[:-1]) if p.startswith(("ssh-", "ecdsa-", "sk-"))), None)
    if at is None:
        return None
    try:
        blob = base64.b64decode(parts[at + 1], validate=True)
    except ValueError:
        return None
    fields = list(ssh_fields(blob))
    if not fields or fields[0].decode("latin-1") != parts[at]:
        return None
    kind, size, curve = parts[at], None, None
    if kind == "ssh-rsa" and len(fields) > 2:
        size = int.from_bytes(fields[2], "big").bit_length()  # the modulus
    elif kind == "ssh-dss" and len(fields) > 1:
        size = int.from_bytes(fields[1], "big").bit_length()
    elif kind.startswith("ecdsa") and len(fields) > 1:
        curve = fields[1].decode("latin-1")
    elif "ed25519" in kind:
        curve = "ed25519"
    print_ = base64.b64encode(hashlib.sha256(blob).digest()).decode().rstrip("=")
    return {"key_type": kind, "key_size": size, "curve": curve, "fingerprint": print_, "comment": " ".join(parts[at + 2 :]) or None}


def record(fields: str) -> T.StructType:
    """A schema from ``name type`` pairs; a string would need a running session when this module is imported."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


def frame(rows: list[dict | None], schema: T.StructType) -> pd.DataFrame:
    """Records as columns; what a record lacks is null."""
    kinds = {"integer": "Int32", "boolean": "boolean"}
    return pd.DataFrame({f.name: pd.Series([(r or {}).get(f.name) for r in rows], dtype=kinds.get(f.dataType.typeName(), "object")) for f in schema})


SSH = record("key_type string, key_size int, curve string, fingerprint string, comment string")


@F.pandas_udf(SSH)
def ssh_facts(lines: pd.Series) -> pd.DataFrame:
    return frame([ssh_key(x) for x in lines], SSH)


# Object identifiers of names, keys and signatures.
OIDS = {
    "2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU", "1.2.840.113549.1.9.1": "emailAddress",
    "1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "EC", "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448", "1.2.840.10040.4.1": "DSA",
    "1.2.840.113549.1.1.5": "SHA1withRSA", "1.2.840.113549.1.1.11": "SHA256withRSA", "1.2.840.113549.1.1.12": "SHA384withRSA", "1.2.840.113549.1.1.13": "SHA512withRSA",
    "1.2.840.10045.4.3.2": "SHA256withECDSA", "1.2.840.10045.4.3.3": "SHA384withECDSA", "1.2.840.10045.4.3.4": "SHA512withECDSA",
    "1.2.840.10045.3.1.7": "secp256r1", "1.3.132.0.34": "secp384r1", "1.3.132.0.35": "secp521r1",
}


def der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """Tag, content and the place behind one DER element."""
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        n, start = int.from_bytes(data[start : start + size], "big"), start + size
    if start + n > len(data):
        raise ValueError("the element is cut off")
    return tag, data[start : start + n], start + n


def elements(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, content, at = der(data, at)
        out.append((tag, content))
    return out


def oid(content: bytes) -> str:
    numbers, n = [], 0
    for b in content:
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, (first, numbers[0] - 40 * first, *numbers[1:])))


def name(content: bytes) -> str:
    """A distinguished name, most specific part first."""
    parts = []
    for _, group in elements(content):
        for _, pair in elements(group):
            (_, kind), (_, value) = elements(pair)[:2]
            parts.append(f"{OIDS.get(oid(kind), oid(kind))}={value.decode('utf-8', 'replace')}")
    return ",".join(parts[::-1])


def moment(tag: int, content: bytes) -> str:
    text = content.decode("ascii").rstrip("Z")
    if tag == 0x17:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    return f"{text[:4]}-{text[4:6]}-{text[6:8]}T{text[8:10]}:{text[10:12]}:{text[12:14] or '00'}Z"


def certificate(raw: bytes) -> dict | None:
    """the fields of an X.509 certificate, None if the bytes are none."""
    try:
        tag, body, end = der(raw)
        if tag != 0x30:
            return None
        (_, tbs), (_, signature) = elements(body)[:2]
        fields = elements(tbs)
        version = 1 + int.from_bytes(der(fields[0][1])[1], "big") if fields[0][0] == 0xA0 else 1
        fields = fields[1:] if fields[0][0] == 0xA0 else fields
        (_, serial), _, (_, issuer), (_, validity), (_, subject), (_, spki) = fields[:6]
        algorithm, (_, bits) = elements(spki)[:2]
        kind = elements(algorithm[1])
        key = OIDS.get(oid(kind[0][1]), oid(kind[0][1]))
        size = int.from_bytes(elements(der(bits[1:])[1])[0][1], "big").bit_length() if key == "RSA" else None
        curve = OIDS.get(oid(kind[1][1]), oid(kind[1][1])) if key == "EC" and len(kind) > 1 and kind[1][0] == 0x06 else None
        before, after = (moment(t, c) for t, c in elements(validity)[:2])
        at = tbs.find(spki)
        whole = raw[:end]
        head = b"\x30" + (bytes([len(spki)]) if len(spki) < 128 else bytes([0x80 | (len(spki).bit_length() + 7) // 8]) + len(spki).to_bytes((len(spki).bit_length() + 7) // 8, "big"))
        assert at >= 0
        sig = oid(elements(signature)[0][1])
        return {
            "subject": name(subject), "issuer": name(issuer), "serial": serial.hex(), "not_before": before, "not_after": after, "version": version, "key_algorithm": key, "key_size": size,
            "curve": curve, "sig_algorithm": OIDS.get(sig, f"<unknown-sig-oid-{sig}>"), "self_signed": subject == issuer, "cert_sha256": hashlib.sha256(whole).hexdigest(), "spki_sha256": hashlib.sha256(head + spki).hexdigest(),
        }
    except (ValueError, IndexError, AssertionError, UnicodeDecodeError):
        return None


CERTIFICATE = record("subject string, issuer string, serial string, not_before string, not_after string, version int, key_algorithm string, key_size int, curve string, sig_algorithm string, self_signed boolean, cert_sha256 string, spki_sha256 string")


@F.pandas_udf(CERTIFICATE)
def certificate_facts(raw: pd.Series) -> pd.DataFrame:
    return frame([certificate(bytes(x)) if x is not None else None for x in raw], CERTIFICATE)


def pem_certificates(text: Column) -> Column:
    """The DER bytes of a text's PEM certificates."""
    bodies = F.regexp_extract_all(text, F.lit(r"-----BEGIN CERTIFICATE-----([A-Za-z0-9+/=\s]+)-----END CERTIFICATE-----"), 1)
    return F.filter(F.transform(bodies, lambda b: F.try_to_binary(F.regexp_replace(b, r"\s+", ""), F.lit("base64"))), lambda b: b.isNotNull())


def manifest(text: Column) -> Column:
    """the headers of a manifest, keys in lower case, continued lines joined; of equal keys the first counts."""
    whole = F.regexp_replace(text, r"\r?\n ", "")
    lines = F.filter(F.split(whole, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_.-]+: ?"))
    put = lambda m, x: F.map_concat(F.create_map(F.lower(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))), m)
    fresh = lambda m, x: F.when(F.map_contains_key(m, F.lower(F.substring_index(x, ":", 1))), m).otherwise(put(F.map_filter(m, lambda k, _: k != F.lower(F.substring_index(x, ":", 1))), x))
    return F.aggregate(lines, F.create_map().cast("map<string,string>"), fresh)


IMAGE = "struct<architecture string, os string, created string, author string, config struct<WorkingDir string, User string, Entrypoint array<string>, Cmd array<string>, Env array<string>, Labels map<string,string>>, history array<struct<created_by string, empty_layer boolean>>, rootfs struct<diff_ids array<string>>>".replace(" string", ":string").replace(" array", ":array").replace(" map", ":map").replace(" struct", ":struct").replace(" boolean", ":boolean")


def image_facts(config: Column) -> Column:
    """platform, command facts, environment, labels and last three commands of an image configuration."""
    own = F.from_json(config, IMAGE)
    history = F.transform(F.filter(own["history"], lambda h: ~F.coalesce(h["empty_layer"], F.lit(False)) & h["created_by"].isNotNull()), lambda h: h["created_by"])
    label = lambda *keys: F.coalesce(*(F.try_element_at(own["config"]["Labels"], F.lit(k)) for k in keys))
    return F.struct(
        F.concat_ws("/", own["os"], own["architecture"]).alias("platform"), own["created"].alias("created"), own["author"].alias("author"), own["config"]["WorkingDir"].alias("working_dir"), own["config"]["User"].alias("user"),
        F.coalesce(F.size(own["config"]["Env"]), F.lit(0)).alias("env_count"), F.coalesce(F.size(own["rootfs"]["diff_ids"]), F.lit(0)).alias("layer_count"),
        F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), F.lit(3)).alias("history"),
        label("org.opencontainers.image.source", "org.label-schema.vcs-url").alias("source"), label("org.opencontainers.image.revision", "org.label-schema.vcs-ref").alias("revision"),
        label("org.opencontainers.image.title", "org.label-schema.name").alias("title"), label("org.opencontainers.image.licenses").alias("license"),
    )
