"""Queries of key material: the tables' rows written as certificates, lists, rings and stores, and read by the operators.

Contents are made of columns by binary expressions, so every row differs; the SQL beside each query tells what must come
out from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import keymaterial as km
from ..sources.records import records
from .base import query, table


def raw(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def whole(value: Column, size: int) -> Column:
    """A number as so many bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def text(value: Column) -> Column:
    return F.encode(value.cast("string"), "UTF-8")


def tlv(tag: str, *parts: Column) -> Column:
    """One DER element.  The body is bound by a lambda, so that nested elements do not repeat it for each use of its length."""

    def element(body: Column) -> Column:
        n = F.length(body)
        size = F.when(n < 128, whole(n, 1)).when(n < 1 << 16, F.concat(raw("82"), whole(n, 2))).otherwise(F.concat(raw("84"), whole(n, 4)))
        return F.concat(raw(tag), size, body)

    return F.get(F.transform(F.array(F.concat(*parts) if parts else raw("")), element), F.lit(0))


def strings(*parts: Column) -> Column:
    """Length-prefixed strings."""
    return F.concat(*(F.get(F.transform(F.array(p), lambda b: F.concat(whole(F.length(b), 4), b)), F.lit(0)) for p in parts))


def named(name: Column) -> Column:
    return tlv("30", tlv("31", tlv("30", raw("0603550403"), tlv("0C", text(name)))))


def rsa_signed() -> Column:
    return raw("300D06092A864886F70D01010B0500")


def dates() -> Column:
    return F.concat(F.lit(b"\x17\x0d240203040506Z"), F.lit(b"\x18\x0f20500101000000Z"))


def extension(name: str, value: Column) -> Column:
    return tlv("30", raw(name), tlv("04", value))


@query("o06_revocation_lists", """WITH l AS (SELECT o_custkey, count(*) AS n, string_agg(ltrim(lower(hex(o_orderkey)), '0') || CASE WHEN o_orderkey = 0 THEN '0' ELSE '' END, ',' ORDER BY o_orderkey) AS serials FROM orders GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS id, u.key, u.value FROM l, LATERAL (VALUES ('IssuerDN', 'CN=Customer ' || o_custkey), ('ThisUpdate', '2024-02-03T04:05:06Z'), ('NextUpdate', '2050-01-01T00:00:00Z'), ('SigAlgorithm', 'SHA256withRSA'), ('CrlNumber', CAST(1000 + o_custkey AS VARCHAR)), ('RevokedCount', CAST(n AS VARCHAR)), ('RevokedSerials', serials)) u(key, value)""")
def o06_revocation_lists(spark, sf_dir):
    """Each customer revokes its orders' keys."""
    entry = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: tlv("30", tlv("02", whole(k, 8)), F.lit(b"\x17\x0d240101000000Z")))
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(entry.alias("entries"))
    listed = tlv("30", F.aggregate("entries", raw(""), lambda a, e: F.concat(a, e)))
    number = extension("0603551D14", tlv("02", whole(F.col("o_custkey") + 1000, 4)))
    signed = tlv("30", raw("020101"), rsa_signed(), named(F.concat(F.lit("Customer "), "o_custkey")), dates(), listed, tlv("A0", tlv("30", number)))
    content = tlv("30", signed, rsa_signed(), raw("030100"))
    return km.revocation_facts(records(own.select(F.col("o_custkey").cast("string").alias("id"), content.alias("content")), "der"))


@query("f30_certificate_extensions", """SELECT CAST(p_partkey AS VARCHAR) AS id, u.key, u.value FROM part, LATERAL (VALUES
    ('SAN', 'DNS:' || p_name || ',IP:10.' || (p_size % 256) || '.0.' || (p_partkey % 256)), ('IsCA', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END),
    ('KeyUsage', array_to_string(list_filter([CASE WHEN p_size & 128 > 0 THEN 'digital-signature' END, CASE WHEN p_size & 64 > 0 THEN 'non-repudiation' END, CASE WHEN p_size & 32 > 0 THEN 'key-encipherment' END, CASE WHEN p_size & 16 > 0 THEN 'data-encipherment' END, CASE WHEN p_size & 8 > 0 THEN 'key-agreement' END, CASE WHEN p_size & 4 > 0 THEN 'key-cert-sign' END, CASE WHEN p_size & 2 > 0 THEN 'crl-sign' END, CASE WHEN p_size & 1 > 0 THEN 'encipher-only' END], lambda x: x IS NOT NULL), ',')),
    ('ExtendedKeyUsage', CASE WHEN p_partkey % 3 = 0 THEN 'server-auth' ELSE '1.3.6.1.5.5.7.3.' || (p_partkey % 3 + 16) END), ('CrlDistributionPoints', 'http://crl/' || p_brand), ('SubjectKeyIdentifier', lpad(lower(to_hex(p_partkey)), 16, '0'))) u(key, value) WHERE u.value <> ''""")
def f30_certificate_extensions(spark, sf_dir):
    """Each part has a certificate."""
    key, size = F.col("p_partkey"), F.col("p_size")
    purpose = F.when(key % 3 == 0, raw("06082B06010505070301")).otherwise(F.concat(raw("06082B060105050703"), whole(key % 3 + 16, 1)))
    parts = [
        extension("0603551D11", tlv("30", tlv("82", text(F.col("p_name"))), tlv("87", raw("0A"), whole(size % 256, 1), raw("00"), whole(key % 256, 1)))),
        extension("0603551D13", tlv("30", F.when(size % 2 == 0, raw("0101FF")).otherwise(raw("")))), extension("0603551D0F", tlv("03", raw("00"), whole(size % 256, 1))), extension("0603551D25", tlv("30", purpose)),
        extension("0603551D1F", tlv("30", tlv("30", tlv("A0", tlv("A0", tlv("86", text(F.concat(F.lit("http://crl/"), "p_brand")))))))), extension("0603551D0E", tlv("04", whole(key, 8))),
    ]
    key_info = tlv("30", tlv("30", raw("06032B6570")), tlv("03", raw("00"), whole(key, 8)))
    signed = tlv("30", raw("A003020102"), tlv("02", whole(key, 8)), rsa_signed(), named(F.lit("Issuer")), tlv("30", dates()), named(F.col("p_name")), key_info, tlv("A3", tlv("30", *parts)))
    own = table(spark, sf_dir, "part").select(key.cast("string").alias("id"), tlv("30", signed, rsa_signed(), raw("030100")).alias("content"))
    return km.extension_facts(km.extensions(records(own, "der")))


@query("f57_ssh_certificates", """SELECT CAST(o_orderkey AS VARCHAR) AS id, u.key, u.value FROM orders, LATERAL (VALUES ('KeyAlgorithm', 'ed25519'), ('SshCertType', CASE WHEN o_orderkey % 2 = 0 THEN 'host' ELSE 'user' END), ('SshCertSerial', CAST(o_orderkey AS VARCHAR)), ('SshCertKeyId', o_orderpriority),
    ('SshCertPrincipals', 'c' || o_custkey || ',' || o_orderstatus), ('SshCertValidAfter', CASE WHEN o_orderkey % 5 = 0 THEN 'always' ELSE strftime(to_timestamp(CAST(o_orderkey AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END), ('SshCertValidBefore', 'forever'), ('SshCertExtensions', 'permit-pty'), ('SshCertSigAlgorithm', 'ssh-ed25519')) u(key, value) WHERE u.value <> ''""")
def f57_ssh_certificates(spark, sf_dir):
    """Each order is a certificate, valid from its key on as a second."""
    k = F.col("o_orderkey")
    content = F.concat(
        strings(F.lit(b"ssh-ed25519-cert-v01@openssh.com"), F.lit(b"nonce"), F.sha2(text(k), 256).cast("binary")), whole(k, 8), whole(2 - k % 2, 4),
        strings(text(F.col("o_orderpriority")), strings(text(F.concat(F.lit("c"), "o_custkey")), text(F.col("o_orderstatus")))), whole(F.when(k % 5 == 0, 0).otherwise(k), 8), raw("FFFFFFFFFFFFFFFF"),
        strings(raw(""), strings(F.lit(b"permit-pty"), raw("")), raw(""), strings(F.lit(b"ssh-ed25519"), F.lit(b"authority")), strings(F.lit(b"ssh-ed25519"), F.lit(b"signature"))),
    )
    own = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), content.alias("content"))
    return km.ssh_certificate_facts(records(own, "ssh"), own).filter("key not like '%Sha256' and key not like '%Fingerprint'")


@query("f60_key_rings", """WITH k AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey % 2 = 0 THEN 2048 ELSE 3072 END AS bits FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id, u.key, u.value FROM k, LATERAL (VALUES ('PgpKeyCount', '2'), ('primary:KeyAlgorithm', 'rsa'), ('primary:KeySize', CAST(bits AS VARCHAR)), ('primary:UserIds', c_name), ('primary:CreationTime', strftime(to_timestamp(CAST(1500000000 + c_custkey AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')),
    ('primary:ExpirationTime', CASE WHEN c_nationkey > 0 THEN strftime(to_timestamp(CAST(1500000000 + c_custkey + 86400 * c_nationkey AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END), ('primary:Version', '4'), ('sub:KeyAlgorithm', 'ec'), ('sub:Curve', 'p-256'), ('sub:CreationTime', strftime(to_timestamp(CAST(1500000000 AS DOUBLE)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')), ('sub:Version', '4')) u(key, value) WHERE u.value <> ''""")
def f60_key_rings(spark, sf_dir):
    """Each customer has a ring of an RSA key, which its nation makes expire, and a subkey."""
    packet = lambda tag, body: F.concat(raw(f"{0xC0 | tag:02X}FF"), whole(F.length(body), 4), body)
    bits = F.when(F.col("c_nationkey") % 2 == 0, 2048).otherwise(3072)
    primary = F.concat(raw("04"), whole(F.col("c_custkey") + 1_500_000_000, 4), raw("01"), whole(bits, 2), raw("80"), F.unhex(F.repeat(F.lit("00"), (bits / 8 - 1).cast("int"))), raw("000103"))
    sub = F.concat(raw("04"), whole(F.lit(1_500_000_000), 4), raw("12082A8648CE3D030107"), raw("0003"), raw("04"), raw("03010807"), whole(F.col("c_custkey"), 2))
    part = F.concat(raw("0509"), whole(F.col("c_nationkey") * 86_400, 4))
    signed = F.concat(raw("04130108"), whole(F.length(part), 2), part, raw("0000ABCD"))
    ring = F.concat(packet(6, primary), packet(13, text(F.col("c_name"))), packet(2, signed), packet(14, sub))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), ring.alias("content"))
    facts = km.key_ring_facts(records(own, "pgp"))
    kinds = facts.filter("key like '%:IsPrimary'").select("id", F.substring_index("key", ":", 2).alias("ring"), F.when(F.col("value") == "true", "primary").otherwise("sub").alias("kind"))
    split = facts.withColumn("ring", F.substring_index("key", ":", 2)).join(kinds, ["id", "ring"], "left")
    shown = F.coalesce(F.concat("kind", F.lit(":"), F.substring_index("key", ":", -1)), F.col("key"))
    return split.select("id", shown.alias("key"), "value").filter("key not like '%Fingerprint' and key not like '%IsPrimary'")


@query("f59_key_stores", """WITH s AS (SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS keys, bool_or(s_suppkey % 7 = 0) AS broken FROM supplier GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS VARCHAR) AS id, u.key, u.value FROM s, LATERAL (VALUES ('KeystoreType', 'jks'), ('KeystoreEncrypted', CASE WHEN broken THEN 'true' END), ('EntryCount', CASE WHEN NOT broken THEN CAST(n AS VARCHAR) END), ('KeyEntryCount', CASE WHEN NOT broken THEN CAST(keys AS VARCHAR) END), ('CertCount', CASE WHEN NOT broken THEN CAST(n + keys AS VARCHAR) END)) u(key, value) WHERE u.value IS NOT NULL""")
def f59_key_stores(spark, sf_dir):
    """Each nation's suppliers are entries of its store: even ones are keys with a chain of two; each seventh makes the store unreadable."""
    utf = lambda c: F.concat(whole(F.length(text(c)), 2), text(c))
    held = F.concat(utf(F.lit("X.509")), strings(text(F.concat(F.lit("certificate of "), "s_name"))))
    entry = F.when(F.col("s_suppkey") % 2 == 0, F.concat(raw("00000001"), utf(F.col("s_name")), raw("0000000000000000"), strings(F.lit(b"private")), raw("00000002"), held, held)).otherwise(F.concat(raw("00000002"), utf(F.col("s_name")), raw("0000000000000000"), held))
    entry = F.when(F.col("s_suppkey") % 7 == 0, raw("00000003")).otherwise(entry)
    own = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.count("*").alias("n"))
    content = F.concat(raw("FEEDFEED00000002"), whole(F.col("n"), 4), F.aggregate("entries", raw(""), lambda a, e: F.concat(a, e)))
    stores = own.select(F.col("s_nationkey").cast("string").alias("id"), content.alias("content"))
    return km.store_facts(records(stores, "store"), stores)
