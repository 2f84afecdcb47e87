"""Key material inside other contents: marks in libraries (strategy 6), keys in texts (strategy 14).

Contents are cut into blocks that overlap by one byte less than the longest mark, as rows.  A mark begins in exactly one
block, also where a cut goes through it, so contents of any size are searched whole, block by block.

Defined results: an empty or null content has no marks; a key that cannot be read tells its kind alone; nothing of a private key but
its algorithm, its size and the digest of its public part is given away.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import der, elements, frame, oid, record

# Marks of certificates in binaries, and where libraries lie and how those of cryptography are named.
MARKS = ("-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----", "-----BEGIN X509 CRL-----", "-----END X509 CRL-----", "X509Certificate", "CertificateFactory")
FOLDERS = r"(^|/)(usr/(local/)?)?lib(64)?/"
LIBRARIES = r"mbedtls|mbedx509|mbedcrypto|libcrypto|libssl|libtls|wolfssl|gnutls|nss3|nssutil|libssh|libssh2|libdropbear"
# Algorithms of keys, and the sizes of curves.
ALGORITHMS = {"1.2.840.113549.1.1.1": "rsa", "1.2.840.10040.4.1": "dsa", "1.2.840.10045.2.1": "ec", "1.3.101.112": "ed25519", "1.3.101.113": "ed448"}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521}
SIZES = {"ed25519": 256, "ed448": 448}


def is_library(path: Column, mime: Column) -> Column:
    """Binaries in folders of libraries, and what is named like a library of cryptography."""
    binary = F.arrays_overlap(mime, F.array(*map(F.lit, ("application/x-sharedlib", "application/x-executable", "application/x-pie-executable", "application/x-object", "application/octet-stream"))))
    return (binary & F.lower(path).rlike(FOLDERS)) | F.lower(path).rlike(LIBRARIES)


def blocks(contents: DataFrame, overlap: int, size: int = 1 << 20) -> DataFrame:
    """id, start and block of contents (id, content): each byte begins one block's own part, and ``overlap`` bytes of the next follow it."""
    n = F.ceil(F.octet_length("content") / size).cast("int")
    cuts = contents.filter(F.octet_length("content") > 0).select("id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return cuts.select("id", (F.col("k").cast("long") * size).alias("start"), F.col("content").substr(F.col("k") * size + 1, F.lit(size + overlap)).alias("block"))


def marks(contents: DataFrame, words: tuple[str, ...] = MARKS, size: int = 1 << 20) -> DataFrame:
    """id, mark and at: every place at which a mark begins, each once."""
    text = F.decode("block", "ISO-8859-1")

    def places(word: str) -> Column:
        """Where a word begins in a block: lengths of what stands between, added up."""
        between = F.transform(F.split(text, "\\Q" + word + "\\E", -1), F.length)
        at = F.transform(F.sequence(F.lit(1), F.size(between) - 1), lambda i: F.aggregate(F.slice(between, 1, i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(word))
        return F.when(text.contains(word), F.transform(at, lambda p: F.struct(F.lit(word).alias("mark"), p.alias("p"))))

    found = [places(word) for word in words]
    rows = blocks(contents, max(map(len, words)) - 1, size).select("id", "start", F.explode(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("m"))
    return rows.filter(F.col("m.p") < size).select("id", "m.mark", (F.col("start") + F.col("m.p")).alias("at"))


def library_facts(libraries: DataFrame) -> DataFrame:
    """(id, key, value) of libraries (id, path, content): whether certificates are marked in them."""
    found = marks(libraries.select("id", "content").dropDuplicates(["id"])).select("id").distinct().withColumn("marked", F.lit(True))
    own = libraries.select("id", "path").distinct().join(found, "id", "left")
    fact = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    name = F.substring_index("path", "/", -1)
    each = F.array(fact("Name", name), fact("EmbeddedCertificates:FilePath", F.concat(F.lit("/"), "path")), F.when(F.col("marked"), fact("EmbeddedCertificates:Marker", F.lit("PEM certificate delimiters"))).otherwise(fact("EmbeddedCertificates:NoPemMarkers", F.lit("true"))))
    return own.select("id", F.explode(each).alias("f")).select("id", "f.key", "f.value").distinct()


def _size(content: bytes) -> bytes:
    n = len(content)
    return bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _element(tag: int, content: bytes) -> bytes:
    return bytes([tag]) + _size(content) + content


def _rsa(modulus: bytes, exponent: bytes) -> tuple[int, str]:
    """Size and digest of the public part of an RSA key."""
    numbers = _element(0x30, _element(2, modulus) + _element(2, exponent))
    algorithm = _element(0x30, bytes.fromhex("06092a864886f70d010101") + b"\x05\x00")
    return int.from_bytes(modulus, "big").bit_length(), hashlib.sha256(_element(0x30, algorithm + _element(3, b"\x00" + numbers))).hexdigest()


def key_of(label: str, raw: bytes | None) -> dict | None:
    """Kind, algorithm, size and digest of the public part of a PEM block's key; None for other blocks."""
    kind = "private-key" if label.endswith("PRIVATE KEY") else "public-key" if label.endswith("PUBLIC KEY") else None
    if kind is None or raw is None:
        return None
    found = {"kind": kind}
    try:
        tag, body, end = der(raw)
        parts = elements(body) if tag == 0x30 else []
        if label == "RSA PRIVATE KEY":
            size, digest = _rsa(parts[1][1], parts[2][1])
            return found | {"algorithm": "rsa", "size": size, "spki_sha256": digest}
        if label == "EC PRIVATE KEY":
            curve = next((oid(der(c)[1]) for t, c in parts if t == 0xA0), None)
            return found | {"algorithm": "ec", "size": CURVES.get(curve)}
        algorithm = elements(parts[1][1] if label == "PRIVATE KEY" else parts[0][1]) if label in ("PRIVATE KEY", "PUBLIC KEY") else None
        if algorithm is None:
            return found
        name = ALGORITHMS.get(oid(algorithm[0][1]), oid(algorithm[0][1]))
        found |= {"algorithm": name, "size": SIZES.get(name)}
        if name == "ec" and len(algorithm) > 1 and algorithm[1][0] == 6:
            found["size"] = CURVES.get(oid(algorithm[1][1]))
        if label == "PUBLIC KEY":
            found["spki_sha256"] = hashlib.sha256(raw[:end]).hexdigest()
            if name == "rsa":
                found["size"] = int.from_bytes(elements(der(parts[1][1][1:])[1])[0][1], "big").bit_length()
        elif name == "rsa":
            inner = elements(der(parts[2][1])[1])
            found["size"], found["spki_sha256"] = _rsa(inner[1][1], inner[2][1])
        return found
    except (ValueError, IndexError, UnicodeDecodeError):
        return found


FIELDS = record("kind string, algorithm string, size int, spki_sha256 string")


@F.pandas_udf(FIELDS)
def key_facts(label: pd.Series, raw: pd.Series) -> pd.DataFrame:
    return frame([key_of(a, None if b is None else bytes(b)) for a, b in zip(label, raw, strict=True)], FIELDS)


def text_keys(texts: DataFrame) -> DataFrame:
    """(id, key, value) of the keys in texts (id, path, text), also in fields whose names end in ``-data`` and whose values are texts in base 64."""
    fields = F.regexp_extract_all("text", F.lit(r"\b[A-Za-z0-9_.-]+-data\s*[:=]\s*[\"']?([A-Za-z0-9+/=_-]{20,})[\"']?"), 1)
    inner = texts.filter(F.col("text").contains("-data")).select("id", "path", F.explode(fields).alias("b")).select("id", "path", F.try_validate_utf8(F.try_to_binary(F.translate("b", "-_", "+/"), F.lit("base64"))).alias("text"))
    texts = texts.select("id", "path", "text").unionByName(inner.filter("text is not null"))
    pattern = r"(?s)-----BEGIN ([A-Z0-9 ]+)-----\s*([A-Za-z0-9+/=\s]+)-----END \1-----"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("label"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("body"))
    own = texts.filter(F.col("text").contains("-----BEGIN ")).select("id", "path", F.explode(pairs).alias("p")).filter(F.col("p.label").endswith("KEY"))
    raw = F.try_to_binary(F.regexp_replace("p.body", r"\s+", ""), F.lit("base64"))
    found = own.select("id", "path", key_facts(F.col("p.label"), raw).alias("k")).filter("k.kind is not null")
    fact = lambda k, v: F.struct(F.lit(f"EmbeddedKey:{k}").alias("key"), v.cast("string").alias("value"))
    derived = F.struct(F.lit("Certificates:DerivedFromPrivateKey").alias("key"), F.when((F.col("k.kind") == "private-key") & F.col("k.algorithm").isNotNull(), "true").alias("value"))
    each = F.array(fact("source", F.col("path")), derived, fact("kind", F.col("k.kind")), fact("key_algorithm", F.col("k.algorithm")), fact("key_size", F.col("k.size")), fact("derived_spki_sha256", F.col("k.spki_sha256")))
    return found.select("id", F.explode(each).alias("f")).select("id", "f.key", "f.value").filter("value is not null").distinct()
