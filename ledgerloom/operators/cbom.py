"""Cryptographic bills of materials: one CycloneDX document for each root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crypto import algorithm_ref, is_crypto_key, parameter, primitive
from ..functions.identity import name_uuid
from ..functions.packages import bom_name

DEPTH, COMPONENTS = 32, 100_000


def crypto_items(extra: DataFrame) -> DataFrame:
    """Ids with a metadata key of a cryptographic family."""
    return extra.filter(is_crypto_key(F.col("key"))).select("id").distinct()


def algorithm_components(found: DataFrame, extra: DataFrame) -> DataFrame:
    """(root, ref, name, primitive, parameter) of the algorithms of the roots' items, each reference once."""
    own = extra.filter(F.col("key").rlike("(?i)(^|:)(algorithm|algorithms|KeyAlgorithm|SigAlgorithm|alg)$")).select("id", F.col("value").alias("name"))
    named = found.join(own, "id").withColumn("ref", algorithm_ref(F.col("name")))
    first = Window.partitionBy("root", "ref").orderBy("depth", "id", "name")
    kept = named.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.select("root", "ref", "name", primitive(F.col("name")).alias("primitive"), parameter(F.col("name")).alias("parameter"))


def capped(components: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """At most so many components for each root, with a flag where there are more."""
    order = Window.partitionBy("root").orderBy("ref")
    ranked = components.withColumn("n", F.row_number().over(order))
    return ranked.filter(F.col("n") <= most + 1).withColumn("truncated", F.max("n").over(Window.partitionBy("root")) > most).filter(F.col("n") <= most).drop("n")


def documents(components: DataFrame, timestamp: str, version: str = "1.6") -> DataFrame:
    """(root, file_name, document) of every root with components (root, ref, name, primitive, parameter, truncated)."""
    properties = F.struct(F.lit("algorithm").alias("assetType"), F.struct("primitive", F.col("parameter").alias("parameterSetIdentifier")).alias("algorithmProperties"))
    one = F.struct("ref", F.struct(F.lit("cryptographic-asset").alias("type"), F.col("ref").alias("bom-ref"), "name", properties.alias("cryptoProperties")).alias("component"))
    grouped = components.groupBy("root").agg(F.array_sort(F.collect_list(one)).alias("own"), F.bool_or("truncated").alias("truncated"))
    body = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit(version).alias("specVersion"), F.concat(F.lit("urn:uuid:"), name_uuid(F.col("root"))).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(F.lit(timestamp).alias("timestamp"), F.array(F.struct(F.lit("truncated").alias("name"), F.col("truncated").cast("string").alias("value"))).alias("properties")).alias("metadata"),
        F.transform("own", lambda c: c["component"]).alias("components"),
    )
    return grouped.select("root", bom_name(F.col("root")).alias("file_name"), F.to_json(body).alias("document"))


# Families in order of precedence, and the key prefixes that tell them.
FAMILIES = (
    ("certificate", "Certificates"), ("protocol", "openssl.cnf"), ("policy", "java.security"), ("password", "PasswordHash"), ("usign", "Usign"), ("ssh", "SSH"), ("tls-config", "TLSConfig"), ("embedded-certificates", "EmbeddedCertificates"),
    ("service", "ServiceCrypto"), ("kerberos", "Kerberos"), ("token", "JWT"), ("json-key", "JWK"), ("embedded-key", "EmbeddedKey"), ("footprint", "CryptoAlgorithms"), ("dependency", "CryptoDependency"), ("mobile", "MobileTls"),
)


def families(extra: DataFrame) -> DataFrame:
    """(id, family): the first family that any of an item's keys belongs to."""
    own = F
    for name, prefix in FAMILIES:
        own = own.when(F.bool_or(F.col("key").startswith(prefix + ":")), name)
    return extra.filter(is_crypto_key(F.col("key"))).groupBy("id").agg(own.otherwise(None).alias("family"))


def main_components(extra: DataFrame) -> DataFrame:
    """(id, name): an item's name, else its description, else its id."""
    first = lambda k: F.min(F.when(F.col("key") == k, F.col("value")))
    return crypto_items(extra).join(extra, "id").groupBy("id").agg(F.coalesce(first("Name"), first("Description"), F.first("id")).alias("name"))


def certificate_fields(extra: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(id, field, value) of a certificate, or of the first one of its bundle."""
    keys = F.regexp_extract("key", "^Certificates:(?:Cert:0:)?([^:]+)$", 1)
    own = extra.withColumn("field", keys).filter(F.col("field").isin(*names))
    return own.groupBy("id", "field").agg(F.coalesce(F.min(F.when(~F.col("key").contains(":Cert:0:"), F.col("value"))), F.min("value")).alias("value"))


def protocols(extra: DataFrame) -> DataFrame:
    """(id, min_version, max_version, suites) of items that configure a protocol."""
    one = lambda *names: F.min(F.when(F.regexp_extract("key", "^[^:]+:(.*)$", 1).isin(*names), F.col("value")))
    number = lambda c: F.regexp_replace(c, "^(?i)(TLS|SSL)v", "")
    own = extra.filter(F.col("key").rlike(r"^(openssl\.cnf|TLSConfig|ServiceCrypto):"))
    return own.groupBy("id").agg(
        number(one("MinProtocol", "min_protocol", "protocol_min")).alias("min_version"), number(one("MaxProtocol", "max_protocol", "protocol_max")).alias("max_version"),
        F.filter(F.split(one("CipherString", "cipher_string", "cipher_suite"), r"[:;,\s]+"), lambda s: s != "").alias("suites"),
    )


def key_entries(extra: DataFrame) -> DataFrame:
    """(id, alias) of key store entries that have a chain."""
    alias = F.regexp_extract("key", "^Certificates:Entry:([^:]+):Chain:0:", 1)
    return extra.select("id", alias.alias("alias")).filter("alias <> ''").distinct()


def write_documents(documents_: DataFrame, folder: str) -> None:
    """One file for each document, below a folder that the driver can write.

    Documents come to the driver one partition at a time.  A file is written
    under another name first and then takes its own; links are not followed.
    """
    import os

    os.makedirs(folder, mode=0o750, exist_ok=True)
    for r in documents_.select("file_name", "document").toLocalIterator():
        path = os.path.join(folder, os.path.basename(r.file_name))
        if os.path.islink(path):
            raise ValueError(f"{path} is a link")
        part = os.open(path + ".part", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o640)
        with os.fdopen(part, "w") as file:
            file.write(r.document)
        os.replace(path + ".part", path)


def related_material(extra: DataFrame) -> DataFrame:
    """(id, type, algorithm, size, fingerprint) of key material that is no certificate."""
    one = lambda *names: F.min(F.when(F.regexp_extract("key", "^[^:]+:(.*)$", 1).isin(*names), F.col("value")))
    own = extra.filter(F.col("key").rlike("^(SSH|Usign|EmbeddedKey|JWK):"))
    kind = F.when(F.bool_or((F.col("key") == "JWK:private_present") & (F.col("value") == "true")), "private-key").otherwise("public-key")
    return own.groupBy("id").agg(kind.alias("type"), one("KeyAlgorithm", "KeyType", "key_algorithm", "kty").alias("algorithm"), one("KeySize", "key_size").alias("size"), one("KeyFingerprintSha256", "KeyFingerprint").alias("fingerprint"))
