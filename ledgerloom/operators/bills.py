"""Whole bills of materials: what every cryptographic item of a root is, the algorithms it names, and one document a root.

An item's metadata becomes one map, from which its family decides what the item is and which algorithms it
uses; this does not depend on roots, so an item that a thousand roots hold is described once.  Roots then meet
descriptions.  Components with one reference are merged by a combining aggregation, the first by depth wins;
a root's first ``COMPONENTS`` are ranked with partial limits per partition, and those beyond only counted.

Defined results: of several values of a key the least counts; an item whose name is empty has no component of its own;
algorithms without a name have none; metadata that no family claims is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crypto import algorithm_ref, is_crypto_key, normal_name, parameter, primitive, signature_name
from ..functions.identity import name_uuid
from ..functions.packages import bom_name, dependency_ref

COMPONENTS = 100_000
ALGORITHM = "array<struct<raw:string,context:string,size:string,curve:string>>"


def item_maps(extra: DataFrame) -> DataFrame:
    """id and facts, a map from each key to its sorted values, of items with cryptographic metadata."""
    crypto = extra.filter(is_crypto_key(F.col("key"))).select("id").distinct()
    values = extra.join(crypto, "id", "left_semi").groupBy("id", "key").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("facts"))


def _values(key: str) -> Column:
    return F.coalesce(F.try_element_at("facts", F.lit(key)), F.array().cast("array<string>"))


def _first(*keys: str) -> Column:
    return F.coalesce(*(F.get(F.try_element_at("facts", F.lit(k)), F.lit(0)) for k in keys))


def _whole(value: Column) -> Column:
    return value.try_cast("int").cast("string")


def _algorithm(raw: Column, context: str, size: Column | None = None, curve: Column | None = None) -> Column:
    """An array of one use of an algorithm, or of none."""
    none = F.lit(None).cast("string")
    use = F.struct(raw.alias("raw"), F.lit(context).alias("context"), (none if size is None else size).alias("size"), (none if curve is None else curve).alias("curve"))
    return F.when(raw.isNotNull(), F.array(use)).otherwise(F.array().cast(ALGORITHM))


def _each(key: str, context: str) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(_values(key), lambda v: F.struct(v.alias("raw"), F.lit(context).alias("context"), none.alias("size"), none.alias("curve")))


def _families() -> list[tuple]:
    """family, condition, asset type, algorithms, and type of material, in order of precedence."""
    names = F.map_keys("facts")
    has = lambda prefix: F.exists(names, lambda k: k.startswith(prefix))
    there = lambda key: F.map_contains_key("facts", F.lit(key))
    cert = lambda k: _first(f"Certificates:{k}", f"Certificates:Cert:0:{k}")
    size = _whole(_first("Certificates:KeySize", "Usign:KeySize", "SSH:KeySize"))
    curve = _first("Certificates:Curve", "SSH:Curve")
    chains = F.filter(names, lambda k: k.rlike("^Certificates:Entry:[^:]+:Chain:0:"))
    aliases = F.array_sort(F.array_distinct(F.transform(chains, lambda k: F.regexp_extract(k, "^Certificates:Entry:([^:]+):", 1))))
    of = lambda a, field: F.get(F.try_element_at(F.col("facts"), F.concat(F.lit("Certificates:Entry:"), a, F.lit(f":{field}"))), F.lit(0))
    entries = F.filter(F.transform(aliases, lambda a: F.struct(of(a, "KeyAlgorithm").alias("raw"), F.lit("pke").alias("context"), _whole(of(a, "KeySize")).alias("size"), of(a, "Curve").alias("curve"))), lambda x: x["raw"].isNotNull())
    none = F.array().cast(ALGORITHM)
    sig = _algorithm(cert("SigAlgorithm"), "signature")
    ssh_kind = F.coalesce(_first("SSH:MaterialType"), F.when(has("SSH:KeyType"), "public-key"), F.lit("other"))
    ssh_key = F.regexp_extract(_first("SSH:KeyType"), "^(?:sk-)?(?:ssh-|ecdsa-sha2-)?([a-z0-9]+)", 1)
    kind = lambda c: F.when(c.isin("private-key", "public-key"), c).otherwise("other")
    jwk = F.when(_first("JWK:kty") == "RSA", "rsa").when(_first("JWK:kty") == "EC", "ec")
    return [
        ("certificate", there("Certificates:SubjectDN") | has("Certificates:Cert:"), "certificate", F.concat(_algorithm(cert("KeyAlgorithm"), "pke", size, curve), sig), None),
        ("protocol", has("openssl.cnf:"), "protocol", none, None),
        ("policy", has("java.security:"), "material", none, F.lit("other")),
        ("store", there("Certificates:KeystoreType"), "material", entries, F.lit("key")),
        ("list", there("Certificates:CrlSha256"), "material", _algorithm(_first("Certificates:SigAlgorithm"), "signature"), F.lit("other")),
        ("key", has("Certificates:"), "material", F.concat(_algorithm(_first("Certificates:KeyAlgorithm"), "pke", size, curve), _algorithm(_first("Certificates:SshCertSigAlgorithm"), "signature")), F.lit("public-key")),
        ("password", has("PasswordHash:"), "material", _each("PasswordHash:Algorithm", "hash"), F.lit("password")),
        ("usign", has("Usign:"), "material", _algorithm(_first("Usign:KeyAlgorithm"), "pke", _whole(_first("Usign:KeySize"))), F.lit("public-key")),
        ("ssh", has("SSH:"), "material", _algorithm(F.coalesce(_first("SSH:KeyAlgorithm"), F.nullif(ssh_key, F.lit("")), _first("Certificates:KeyAlgorithm")), "pke", _whole(_first("SSH:KeySize")), _first("SSH:Curve")), F.when(ssh_kind == "private-key-placeholder", "private-key").otherwise(ssh_kind)),
        ("tls-config", has("TLSConfig:"), "material", none, F.lit("other")),
        ("embedded-certificate", has("EmbeddedCertificates:"), "material", none, F.lit("other")),
        ("embedded-key", has("EmbeddedKey:"), "material", _algorithm(_first("EmbeddedKey:key_algorithm"), "pke", _whole(_first("EmbeddedKey:key_size"))), kind(_first("EmbeddedKey:kind"))),
        ("service", has("ServiceCrypto:"), "material", _each("ServiceCrypto:algorithms", "other"), F.lit("other")),
        ("kerberos", has("Kerberos:"), "material", _each("Kerberos:algorithms", "other"), F.lit("other")),
        ("token", has("JWT:"), "material", F.filter(_each("JWT:signature_algorithm", "signature"), lambda x: x["raw"] != "none"), F.lit("other")),
        ("json-key", has("JWK:"), "material", _algorithm(jwk, "pke", _whole(_first("JWK:size"))), F.when(F.array_contains(_values("JWK:private_present"), "true"), "private-key").otherwise("public-key")),
        ("footprint", has("CryptoAlgorithms:"), "none", F.filter(_each("CryptoAlgorithms:algorithm", "other"), lambda x: x["raw"] != ""), None),
        ("dependency", has("CryptoDependency:"), "none", none, None),
        ("mobile", has("MobileTls:"), "material", _each("MobileTls:algorithms", "other"), F.lit("other")),
    ]


def described(maps: DataFrame) -> DataFrame:
    """id, facts, family, asset, material and uses, the algorithms with their references, of each item."""
    kinds = _families()
    own = maps.select("id", "facts", _chain(kinds, 0, "string").alias("family"), _chain(kinds, 2, "string").alias("asset"), _chain(kinds, 4, "string").alias("material"), _chain(kinds, 3, ALGORITHM).alias("raw"))
    canonical = lambda x: signature_name(x["raw"])

    def use(x: Column) -> Column:
        name, context = canonical(x), x["context"]
        told = F.coalesce(x["size"], x["curve"], parameter(name))
        return F.struct(algorithm_ref(name, context).alias("ref"), name.alias("name"), primitive(name, context).alias("primitive"), told.alias("parameter"), x["curve"].alias("curve"), context.alias("context"))

    named = F.filter("raw", lambda x: normal_name(canonical(x)) != "unknown")
    return own.filter("family is not null").withColumn("uses", F.transform(named, use)).drop("raw")


def _chain(kinds: list[tuple], i: int, kind: str) -> Column:
    out = F
    for k in kinds:
        value = k[i] if isinstance(k[i], Column) else F.lit(k[i])
        out = out.when(k[1], value.cast(kind))
    return out.otherwise(F.lit(None).cast(kind))


def components(items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id, ref, place and component, as JSON, of all that an item brings; ``aliases`` (id, alias) gives software identifiers."""
    first_ref = F.get(F.transform("uses", lambda u: u["ref"]), F.lit(0))
    of = lambda context: F.get(F.transform(F.filter("uses", lambda u: u["context"] == context), lambda u: u["ref"]), F.lit(0))
    cert = lambda k: _first(f"Certificates:{k}", f"Certificates:Cert:0:{k}")
    certificate = F.struct(cert("SubjectDN").alias("subjectName"), cert("IssuerDN").alias("issuerName"), cert("NotBefore").alias("notValidBefore"), cert("NotAfter").alias("notValidAfter"), of("pke").alias("subjectPublicKeyRef"), of("signature").alias("signatureAlgorithmRef"), F.lit("X.509").alias("certificateFormat"))
    least, most = _first("openssl.cnf:min_protocol"), _first("openssl.cnf:max_protocol")
    version = F.nullif(F.concat_ws(" ", F.concat(F.lit("min:"), least), F.concat(F.lit("max:"), most)), F.lit(""))
    listed = F.concat(F.when(_first("openssl.cnf:cipher_string").isNotNull(), F.split(_first("openssl.cnf:cipher_string"), ":")).otherwise(F.array().cast("array<string>")), _values("openssl.cnf:cipher_suites"), _values("openssl.cnf:options"))
    suites = F.when(F.size(listed) > 0, F.transform(listed, lambda s: F.struct(s.alias("name"), F.array(s).alias("identifiers"))))
    protocol = F.struct(F.lit("tls").alias("type"), version.alias("version"), suites.alias("cipherSuites"))
    size = _first("Certificates:KeySize", "Usign:KeySize", "SSH:KeySize", "Certificates:Cert:0:KeySize").try_cast("int")
    material = F.struct(F.col("material").alias("type"), first_ref.alias("algorithmRef"), size.alias("size"))
    only = lambda asset, value: F.when(F.col("asset") == asset, value)
    crypto = F.struct(
        F.when(F.col("asset") == "material", "related-crypto-material").otherwise(F.col("asset")).alias("assetType"), only("certificate", certificate).alias("certificateProperties"), only("protocol", protocol).alias("protocolProperties"),
        only("material", material).alias("relatedCryptoMaterialProperties"),
    )
    told = F.filter(F.flatten(F.transform(F.map_entries("facts"), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("name"), v.alias("value"))))), lambda p: is_crypto_key(p["name"]))
    own = items
    if aliases is not None:
        prefix = "gitoid:blob:sha1:"
        swh = aliases.filter(F.col("alias").rlike(f"^{prefix}[0-9a-f]{{40}}$")).groupBy("id").agg(F.min("alias").alias("alias"))
        own = own.join(swh.select("id", F.concat(F.lit("swh:1:cnt:"), F.substring("alias", len(prefix) + 1, 40)).alias("swhid")), "id", "left")
        told = F.concat(told, F.when(F.col("swhid").isNotNull(), F.array(F.struct(F.lit("swhid:core").alias("name"), F.col("swhid").alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>")))
    name = F.coalesce(_first("Name", "Description"), F.col("id"))
    main = F.struct(F.lit("cryptographic-asset").alias("type"), F.col("id").alias("bom-ref"), name.alias("name"), _first("Description").alias("description"), F.when(F.size(told) > 0, told).alias("properties"), crypto.alias("cryptoProperties"))
    row = lambda ref, place, component: F.struct(ref.alias("ref"), place.cast("int").alias("place"), component.alias("component"))
    itself = F.when((F.col("asset") != "none") & (name != ""), F.array(row(F.col("id"), F.lit(0), F.to_json(main))))

    def algorithm(u: Column) -> Column:
        properties = F.struct(u["primitive"].alias("primitive"), u["parameter"].alias("parameterSetIdentifier"), u["curve"].alias("curve"))
        return F.to_json(F.struct(F.lit("cryptographic-asset").alias("type"), u["ref"].alias("bom-ref"), u["name"].alias("name"), F.struct(F.lit("algorithm").alias("assetType"), properties.alias("algorithmProperties")).alias("cryptoProperties")))

    algorithms = F.transform("uses", lambda u, i: row(u["ref"], i + 1, algorithm(u)))
    groups = _values("CryptoDependency:algorithms")
    properties = F.when(F.size(groups) > 0, F.concat(F.transform(groups, lambda g: F.struct(F.lit("crypto-family").alias("name"), g.alias("value"))), F.array(F.struct(F.lit("algorithms").alias("name"), F.array_join(groups, ",").alias("value")))))
    libraries = F.transform(F.filter(_values("CryptoDependency:name"), lambda n: n != ""), lambda n, i: row(dependency_ref(n), i, F.to_json(F.struct(F.lit("library").alias("type"), dependency_ref(n).alias("bom-ref"), n.alias("name"), _first("CryptoDependency:version").alias("version"), properties.alias("properties")))))
    none = F.array().cast("array<struct<ref:string,place:int,component:string>>")
    all_ = F.when(F.map_contains_key("facts", F.lit("CryptoDependency:name")), libraries).otherwise(F.concat(F.coalesce(itself, none), algorithms))
    return own.select("id", F.explode(all_).alias("c")).select("id", "c.ref", "c.place", "c.component")


def of_roots(found: DataFrame, parts: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Root, place, ref, component and truncated: each reference of a root once, its first by depth, at most ``most``.

    found: root, id and depth of the items that roots hold.
    """
    order = F.struct("depth", "id", "place")
    once = found.join(parts, "id").groupBy("root", "ref").agg(F.min_by("component", order).alias("component"), F.min(order).alias("at"))
    sizes = once.groupBy("root").agg((F.count("*") > most).alias("truncated"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("at"))).filter(F.col("place") <= most)
    return ranked.join(sizes, "root").select("root", "place", "ref", "component", "truncated")


def documents(parts: DataFrame, timestamp: str, tool: str = "ledgerloom", tool_version: str = "1", version: str = "1.6") -> DataFrame:
    """Root, file_name and document, a CycloneDX text, of every root."""
    grouped = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "component"))).alias("own"), F.bool_or("truncated").alias("truncated"))
    about = F.struct(F.lit(timestamp).alias("timestamp"), F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(tool).alias("name"), F.lit(tool_version).alias("version"))).alias("components")).alias("tools"))
    head = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit(version).alias("specVersion"), F.concat(F.lit("urn:uuid:"), name_uuid(F.col("root"))).alias("serialNumber"), F.lit(1).alias("version"), about.alias("metadata")))
    body = F.array_join(F.transform("own", lambda c: c["component"]), ",")
    cut = F.when(F.col("truncated"), ',"properties":[{"name":"cbom:truncated","value":"true"}]').otherwise("")
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"components":['), body, F.lit("]"), cut, F.lit("}"))
    return grouped.select("root", bom_name(F.col("root")).alias("file_name"), whole.alias("document"))
