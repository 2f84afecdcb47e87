"""Content types from the first bytes and the name (S15-S17), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures of formats: first bytes in hex, type.
SIGNATURES = (
    ("504B0304", "application/zip"), ("504B0506", "application/zip"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"), ("FD377A585A00", "application/x-xz"),
    ("28B52FFD", "application/zstd"), ("EDABEEDB", "application/x-rpm"), ("213C617263683E0A", "application/x-archive"), ("303730373031", "application/x-cpio"),
    ("7F454C46", "application/x-sharedlib"), ("4D5A", "application/x-msdownload"), ("CAFEBABE", "application/java-vm"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"),
    ("474946383", "image/gif"), ("25504446", "application/pdf"), ("FEEDFEED", "application/x-java-keystore"), ("CECECECE", "application/x-java-jce-keystore"), ("514649FB", "application/x-qemu-disk"),
    ("4B444D56", "application/x-vmdk"), ("7668647866696C65", "application/x-vhdx"), ("636F6E6563746978", "application/x-vhd"),
)
# Extensions of archives that Java tools read.
JAVA_ARCHIVES = ("jar", "war", "ear", "par", "sar", "nar", "jpi", "hpi", "kar", "far", "lpkg", "rar", "zap", "aar", "jmod")
# Keys of Java security files, and strong keywords of OpenSSL files.
JAVA_SECURITY = ("security.provider.", "jdk.tls.disabledAlgorithms", "jdk.certpath.disabledAlgorithms", "jdk.jar.disabledAlgorithms", "jdk.tls.legacyAlgorithms", "jdk.tls.namedGroups", "jdk.tls.ephemeralDHKeySize", "crypto.policy", "securerandom.source", "keystore.type")
# What the text of key material begins with, and its type.
KEY_TEXTS = (("-----BEGIN PGP", "application/pgp-keys"), ("-----BEGIN X509 CRL-----", "application/pkix-crl"), ("-----BEGIN PKCS7-----", "application/x-pkcs7-certificates"), ("untrusted comment:", "text/x-usign"))
# Extensions of key material in DER, and its type.
DER = {"der": "application/pkix-cert", "cer": "application/pkix-cert", "crt": "application/pkix-cert", "crl": "application/pkix-crl", "p7b": "application/x-pkcs7-certificates", "p7c": "application/x-pkcs7-certificates", "p12": "application/x-pkcs12", "pfx": "application/x-pkcs12"}
#: So many bytes are looked at for words that tell a type.
PROBE = 256 << 10
OPENSSL = ("openssl_conf", "CipherString", "Ciphersuites", "MinProtocol", "MaxProtocol", "default_md", "distinguished_name", "req_extensions")


def text_head(content: Column, size: int = PROBE) -> Column:
    """The first bytes of a content as text, cut between two characters; null if they are no UTF-8."""
    cuts = [F.try_validate_utf8(F.substring(content, 1, size - n)) for n in range(4)]
    return F.when(F.octet_length(content) <= size, cuts[0]).otherwise(F.coalesce(*cuts))


def mime_types(content: Column, path: Column) -> Column:
    """The types of a file, most certain first; application/octet-stream if nothing is known."""
    head = F.hex(F.substring(content, 1, 300))
    text = text_head(content)
    plain = text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0e-\x1f]") & (F.octet_length(content) > 0)
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    zipped = head.startswith("504B0304")
    own = lambda condition, name: F.when(condition, F.lit(name))
    every = lambda words: "|".join(w.replace(".", r"\.") for w in words)
    found = [own(head.startswith(h), t) for h, t in SIGNATURES]
    found += [
        own(F.substring(head, 515, 10) == "7573746172", "application/x-tar"),
        own(zipped & extension.isin(*JAVA_ARCHIVES), "application/java-archive"),
        own(zipped & (extension == "nupkg"), "application/zip"),
        own(plain & (F.octet_length(content) < 1 << 20) & F.try_parse_json(F.try_validate_utf8(content)).isNotNull() & text.rlike(r"^\s*[\[{]"), "application/json"),
        own(plain & text.contains("-----BEGIN "), "application/x-pem-file"),
        *(own(plain & text.contains(mark), name) for mark, name in KEY_TEXTS),
        *(own(head.startswith("30") & (extension == end), name) for end, name in DER.items()),
        own(F.substring(head, 129, 8) == "7F10DABE", "application/x-vdi"),
        own(plain & text.rlike(every(JAVA_SECURITY)), "text/x-java-security"),
        own(plain & text.rlike(every(OPENSSL)), "text/x-openssl-config"),
        own(plain & text.rlike(r"(^|\n)(ssh-|ecdsa-|sk-)[a-z0-9@.-]+ AAAA"), "text/x-ssh-public-key"),
        own(plain, "text/plain"),
    ]
    known = F.array_distinct(F.filter(F.array(*found), lambda m: m.isNotNull()))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("application/octet-stream")))
