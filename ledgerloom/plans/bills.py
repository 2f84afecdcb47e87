"""Queries of bills of materials: parts as cryptographic items of their brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bills
from .base import query, table

KINDS = 6


def items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metadata (id, key, mime, value) of parts, and (root, id, depth) of those that brands hold.

    By key a part is a certificate, a protocol, a password file, a private key, a dependency or a token.
    """
    own = table(spark, sf_dir, "part").withColumn("kind", F.col("p_partkey") % KINDS)
    size = F.col("p_size").cast("string")
    told = [
        {"Name": F.col("p_name"), "Certificates:SubjectDN": F.concat(F.lit("CN="), "p_name"), "Certificates:KeyAlgorithm": F.lit("RSA"), "Certificates:KeySize": size, "Certificates:SigAlgorithm": F.concat(F.lit("SHA"), size, F.lit("withRSA"))},
        {"openssl.cnf:min_protocol": F.concat(F.lit("TLSv1."), F.col("p_size") % 4), "openssl.cnf:max_protocol": F.when(F.col("p_size") % 2 == 0, "TLSv1.3"), "openssl.cnf:cipher_string": F.concat(F.lit("HIGH:S"), size)},
        {"Description": F.col("p_type"), "PasswordHash:Algorithm": F.concat(F.lit("h "), F.col("p_size") % 5)}, {"JWK:kty": F.lit("EC"), "JWK:size": size, "JWK:private_present": (F.col("p_size") % 2 == 0).cast("string")},
        {"CryptoDependency:name": F.concat(F.lit("Lib/"), F.col("p_size") % 9), "CryptoDependency:version": size, "CryptoDependency:algorithms": F.lit("aes")}, {"JWT:signature_algorithm": F.when(F.col("p_size") % 3 > 0, "ecdsa").otherwise("none")},
    ]
    id_ = F.concat(F.lit("part:"), "p_partkey")
    rows = F.array(*(F.when(F.col("kind") == n, F.struct(F.lit(k).alias("key"), v.alias("value"))) for n, own_ in enumerate(told) for k, v in own_.items()))
    extra = own.select(id_.alias("id"), F.explode(rows).alias("r")).select("id", "r.key", F.lit(None).cast("string").alias("mime"), "r.value").filter("value is not null")
    return extra, own.select(F.col("p_brand").alias("root"), id_.alias("id"), (F.col("p_size") % 3).cast("int").alias("depth"))


PARTS_SQL = "p AS (SELECT *, p_partkey % 6 AS kind, 'part:' || p_partkey AS id, CAST(p_size AS VARCHAR) AS s FROM part)"


def parts(spark, sf_dir):
    extra, found = items(spark, sf_dir)
    return found, bills.components(bills.described(bills.item_maps(extra)))


@query("c01_components", f"""WITH {PARTS_SQL} SELECT DISTINCT p_brand AS root, u.ref, u.name, u.type FROM p, LATERAL (VALUES
    (CASE WHEN kind NOT IN (4) THEN id END, CASE WHEN kind = 0 THEN p_name WHEN kind = 2 THEN p_type ELSE id END, 'cryptographic-asset'), (CASE WHEN kind = 0 THEN 'alg:pke:rsa' END, 'RSA', 'cryptographic-asset'),
    (CASE WHEN kind = 0 THEN 'alg:signature:sha' || s || 'withrsa' END, 'SHA' || s || 'withRSA', 'cryptographic-asset'), (CASE WHEN kind = 2 THEN 'alg:hash:h-' || p_size % 5 END, 'h ' || p_size % 5, 'cryptographic-asset'),
    (CASE WHEN kind = 3 THEN 'alg:pke:ec' END, 'ec', 'cryptographic-asset'), (CASE WHEN kind = 4 THEN 'dep-lib-' || p_size % 9 END, 'Lib/' || p_size % 9, 'library'), (CASE WHEN kind = 5 AND p_size % 3 > 0 THEN 'alg:signature:ecdsa' END, 'ecdsa', 'cryptographic-asset')) u(ref, name, type) WHERE u.ref IS NOT NULL""")
def c01_components(spark, sf_dir):
    """Every component of every brand once."""
    found, own = parts(spark, sf_dir)
    json = lambda k: F.get_json_object("component", f"$.{k}")
    return bills.of_roots(found, own).select("root", "ref", json("name").alias("name"), json("type").alias("type"))


@query("c06_protocols", f"""WITH {PARTS_SQL} SELECT id, 'min:TLSv1.' || p_size % 4 || CASE WHEN p_size % 2 = 0 THEN ' max:TLSv1.3' ELSE '' END AS version, 'S' || s AS suite FROM p WHERE kind = 1""")
def c06_protocols(spark, sf_dir):
    _, own = parts(spark, sf_dir)
    json = lambda k: F.get_json_object("component", f"$.cryptoProperties.protocolProperties.{k}")
    return own.filter(json("type") == "tls").select("id", json("version").alias("version"), json("cipherSuites[1].name").alias("suite"))


@query("c07_material", f"""WITH {PARTS_SQL} SELECT id, CASE WHEN kind = 2 THEN 'password' WHEN kind = 3 AND p_size % 2 = 0 THEN 'private-key' WHEN kind = 3 THEN 'public-key' ELSE 'other' END AS type,
    CASE WHEN kind = 2 THEN 'alg:hash:h-' || p_size % 5 WHEN kind = 3 THEN 'alg:pke:ec' WHEN p_size % 3 > 0 THEN 'alg:signature:ecdsa' END AS algorithm FROM p WHERE kind IN (2, 3, 5)""")
def c07_material(spark, sf_dir):
    _, own = parts(spark, sf_dir)
    json = lambda k: F.get_json_object("component", f"$.cryptoProperties.relatedCryptoMaterialProperties.{k}")
    return own.filter(json("type").isNotNull()).select("id", json("type").alias("type"), json("algorithmRef").alias("algorithm"))


@query("o03_capped_components", f"""WITH {PARTS_SQL} SELECT p_brand AS root, least(count(*), 3) AS kept, count(*) > 3 AS truncated FROM p WHERE kind = 1 GROUP BY p_brand""")
def o03_capped_components(spark, sf_dir):
    """A cap of three protocols for each brand, with a flag where there are more."""
    found, own = parts(spark, sf_dir)
    only = own.filter(F.get_json_object("component", "$.cryptoProperties.assetType") == "protocol")
    return bills.of_roots(found, only, 3).groupBy("root").agg(F.count("*").alias("kept"), F.bool_or("truncated").alias("truncated"))
