"""The claim chain over artifacts, and what each strategy extracts.

``claims`` names one strategy for each artifact in one pass.  ``extract`` runs
the strategies' extractors over the claimed texts and gives two long tables:
metadata (id, key, mime, value) and package URLs (id, purl).  Key material never
leaves: ``without_leaks`` is applied to all metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto, packages, poms, textual, tokens
from ..storage import materialised
from ..sources import records
from . import assemblies, configs, embedded, inifiles, keymaterial, manifests
from .filters import scan_filtered
from .joins import claimed, needles_in

__all__ = ["claims", "extract", "scan_filtered"]

# Identifiers of crypto libraries and the algorithm they stand for; an empty one stands for several.
FOOTPRINTS = {
    "EVP_sha1": "sha-1", "EVP_sha224": "sha-224", "EVP_sha256": "sha-256", "EVP_sha384": "sha-384", "EVP_sha512": "sha-512", "EVP_sha3_224": "sha3-224", "EVP_sha3_256": "sha3-256",
    "EVP_sha3_384": "sha3-384", "EVP_sha3_512": "sha3-512", "EVP_sha512_224": "sha512-224", "EVP_sha512_256": "sha512-256", "EVP_md5": "md5", "EVP_md4": "md4", "EVP_mdc2": "mdc2", "EVP_sm3": "sm3",
    "EVP_blake2b512": "blake2b-512", "EVP_blake2s256": "blake2s-256", "EVP_shake128": "shake128", "EVP_shake256": "shake256", "EVP_whirlpool": "whirlpool", "EVP_aes_128_cbc": "aes-128-cbc",
    "EVP_aes_256_cbc": "aes-256-cbc", "EVP_aes_128_gcm": "aes-128-gcm", "EVP_aes_256_gcm": "aes-256-gcm", "EVP_aes_128_ccm": "aes-128-ccm", "EVP_aes_256_ccm": "aes-256-ccm",
    "EVP_chacha20_poly1305": "chacha20-poly1305", "EVP_rc4": "rc4", "EVP_des_ede3_cbc": "3des", "EVP_des_cbc": "des", "EVP_ecdsa": "ecdsa", "EVP_ed25519": "ed25519", "EVP_ed448": "ed448", "EVP_dh": "dh",
    "EVP_ripemd160": "ripemd160", "crypto/md5": "md5", "crypto/sha1": "sha-1", "crypto/sha256": "sha-256", "crypto/sha512": "sha-512", "crypto/aes": "aes", "crypto/rsa": "rsa", "crypto/ecdsa": "ecdsa",
    "crypto/ed25519": "ed25519", "crypto/hmac": "hmac", "crypto/tls": "tls", "aes-gcm": "aes-gcm", " sha2 ": "sha-2", " sha3 ": "sha-3", "hkdf": "hkdf", " ring ": "", " rustls ": "",
}
LOCKFILES = {"Cargo.lock": "cargo", "package-lock.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "go.sum": "go", "requirements.txt": "pip"}
# Keys of a Java runtime's release file and the names of the facts.
RELEASE = {"JAVA_VERSION": "JavaVersion", "JAVA_RUNTIME_VERSION": "JavaRuntimeVersion", "IMAGE_TYPE": "ImageType", "OS_ARCH": "OsArch", "OS_NAME": "OsName", "LIBC": "Libc", "JVM_VARIANT": "JvmVariant", "SEMANTIC_VERSION": "SemanticVersion", "FULL_VERSION": "FullVersion", "SOURCE_REPO": "SourceRepo", "BUILD_SOURCE_REPO": "BuildSourceRepo", "JAVA_VERSION_DATE": "JavaVersionDate"}


def _name() -> Column:
    return F.substring_index("path", "/", -1)


def claims(artifacts: DataFrame, before: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Artifacts (path, mime, text) with the first strategy that takes them; text is null for binary contents.

    ``before`` has names and conditions of other strategies, which come first.
    What belongs to a container image is told by ``images.members``, as it takes several artifacts.
    """
    name, text, path = _name(), F.coalesce("text", F.lit("")), F.col("path")
    has = lambda *types: F.arrays_overlap("mime", F.array(*map(F.lit, types)))
    chain = [
        *(before or []),
        ("maven", packages.is_archive(name) | name.rlike(r"\.pom$|-(sources|javadocs?)\.jar$") | (name == "pom.xml")),
        ("os-package", has("application/x-rpm") | name.rlike(r"\.(deb|apk|pkg\.tar\.(xz|zst))$") | (path.rlike(r"(^|/)control$") & text.rlike("(?m)^Package: ")) | name.isin(".PKGINFO", "+MANIFEST", "+COMPACT_MANIFEST")),
        ("dotnet", has("application/x-msdownload") & name.rlike(r"(?i)\.(dll|exe)$")),
        ("language-package", name.rlike(r"\.(whl|gem|crate|nupkg)$") | manifests.is_language_manifest(path)),
        ("embedded-certificates", embedded.is_library(path, F.col("mime"))),
        ("certificates", (has("application/x-pem-file") & text.rlike("-----BEGIN (CERTIFICATE|X509 CRL|PGP PUBLIC KEY BLOCK)-----")) | textual.keystore_type(name).isNotNull() | name.rlike(r"(?i)\.(crt|cer|der|crl|pgp|gpg|asc)$|-cert\.pub$")),
        ("shadow", path.rlike(r"(^|/)etc/(shadow|gshadow|passwd|group)$")),
        ("usign", path.contains("etc/opkg/keys/") | text.rlike(r"^untrusted comment:")),
        ("ssh", path.rlike(r"(^|/)\.ssh/|authorized_keys|ssh_host_[a-z0-9]+_key(\.pub)?$|id_[a-z0-9]+(\.pub)?$")),
        ("service-tls", name.isin("uhttpd", "nginx.conf", "lighttpd.conf")),
        ("service-crypto", configs.service(path).isNotNull() & ~configs.service(path).isin("java.security", "crypto.policy")),
        ("tokens", text.rlike(tokens.JWT) | text.rlike(r'"kty"\s*:')),
        ("embedded-pem", text.contains("-----BEGIN ") | text.rlike(r"-data\s*[:=]\s*[\"']?LS0tLS1CRUdJTi")),
        ("crypto-footprint", text.rlike("EVP_[a-z0-9_]+|golang.org/x/crypto|crypto/(md5|sha1|sha256|sha512|aes|rsa|tls)")),
        ("mobile-tls", name.isin("network_security_config.xml", "AndroidManifest.xml", "Info.plist", "crypto.policy")),
        ("crypto-dependency", name.isin(*LOCKFILES)),
        ("jvm", (name == "release") & text.contains("JAVA_VERSION")),
        ("gradle", (name == "gradle.lockfile") | path.rlike(r"dependency-locks/[^/]*\.lockfile$")),
        ("openssl", has("text/x-openssl-config")),
        ("java-security", has("text/x-java-security") | (name == "java.security")),
    ]
    return claimed(artifacts, chain)


def with_text(artifacts: DataFrame, most: int = 16 << 20) -> DataFrame:
    """Artifacts (id, path, mime), once for each path of a content, with their text: UTF-8 contents of at most ``most`` bytes."""
    own = artifacts.select("id", F.when(F.octet_length("content") <= most, F.try_validate_utf8("content")).alias("text")).filter("text is not null")
    return artifacts.select("id", "path", "mime").distinct().join(own.dropDuplicates(["id"]), "id", "left")


def needed(claimed_: DataFrame) -> DataFrame:
    """Claimed artifacts without the texts that no extractor reads: a licence under a million paths is not written a million times."""
    read = (F.col("strategy") != "generic") | F.array_contains("mime", "application/json")
    return claimed_.withColumn("text", F.when(read, F.col("text")))


def _rows(df: DataFrame, prefix: str, facts: dict[str, Column]) -> DataFrame:
    """One metadata row for each fact that is not null."""
    each = F.array(*(F.struct(F.lit(prefix + k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()))
    return df.select("id", F.explode(each).alias("f")).select("id", "f.key", F.lit(None).cast("string").alias("mime"), "f.value").filter("value is not null and value <> ''")


def prefixed(prefix: str, facts: DataFrame) -> DataFrame:
    """Facts (id, key, value) as metadata rows."""
    return facts.select("id", F.concat(F.lit(prefix), "key").alias("key"), F.lit(None).cast("string").alias("mime"), "value")


def bundled(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, key, value) of the files that each of ``files`` (scope, path, id) includes by a reference."""
    edges = inifiles.include_edges(files, wanted)
    return inifiles.associated(files, edges, inifiles.layers(files, edges)).select("id", F.lit("associated_files").alias("key"), "value")


def extract(claimed_: DataFrame, contents: DataFrame | None = None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata and package URLs of claimed artifacts (id, path, mime, text, strategy).

    ``contents`` (id, path, content) has the claimed key material that is no text; ``places`` (scope, path, id)
    tells which files lie in one container, the empty scope being that of the files themselves.
    """
    of = lambda *names: claimed_.filter(F.col("strategy").isin(*names) & F.col("text").isNotNull())
    lines = lambda df: df.select("id", "path", F.explode(F.split("text", r"\r?\n")).alias("line"))
    extra, purls = [], []

    pem = of("certificates", "embedded-pem").select("id", "text").dropDuplicates(["id"])
    blocks = pem.withColumn("c", tokens.pem_certificates(F.col("text"))).select("id", F.size("c").alias("total"), F.posexplode("c").alias("n", "content"))
    binary = contents.filter(F.lower("path").rlike(r"\.(crt|cer|der)$") & (F.hex(F.substring("content", 1, 1)) == "30")).select("id", F.lit(1).alias("total"), F.lit(0).alias("n"), "content") if contents is not None else None
    certificates = blocks.unionByName(binary) if binary is not None else blocks
    facts = keymaterial.certificate_rows(certificates)
    if contents is not None:
        facts = facts.unionByName(keymaterial.material_rows(pem, contents))
    extra.append(prefixed("Certificates:", facts))
    keys = certificates.select("id", tokens.certificate_facts("content").alias("c")).filter("c.subject is not null")
    purls.append(keys.select("id", F.concat(F.lit("pkg:generic/x509/spki-sha256@"), "c.spki_sha256", F.lit("?alg="), F.lower("c.key_algorithm")).alias("purl")))

    extra.append(prefixed("", embedded.text_keys(of("embedded-pem").select("id", "path", "text").distinct())))
    if contents is not None:
        libraries = claimed_.filter("strategy = 'embedded-certificates'").select("id", "path").distinct()
        extra.append(prefixed("", embedded.library_facts(contents.select("id", "content").join(libraries, "id"))))

    shadow = lines(of("shadow")).filter(F.col("path").rlike("shadow$") & F.col("line").contains(":")).select("id", F.split("line", ":").alias("f"))
    shadow = shadow.select("id", F.element_at("f", 1).alias("user"), crypto.crypt_details(F.element_at("f", 2)).alias("h"))
    extra.append(_rows(shadow, "PasswordHash:", {"User": F.col("user"), "Algorithm": F.col("h.algorithm"), "Cost": F.col("h.cost"), "Params": F.col("h.params")}))

    ssh = lines(of("ssh")).select("id", tokens.ssh_facts("line").alias("k")).filter("k.key_type is not null")
    extra.append(_rows(ssh, "SSH:", {"KeyType": F.col("k.key_type"), "KeySize": F.col("k.key_size"), "Curve": F.col("k.curve"), "KeyFingerprintSha256": F.col("k.fingerprint"), "Comment": F.col("k.comment")}))

    usign = of("usign").select("id", F.regexp_extract("text", r"^untrusted comment:\s*(.*)", 1).alias("comment"), F.to_binary(F.regexp_extract("text", r"(?m)^(RW[A-Za-z0-9+/]{54}(?:==|=)?)\s*$", 1), F.lit("base64")).alias("raw"))
    extra.append(_rows(usign, "Usign:", {"Comment": F.col("comment"), "KeyId": F.when(F.length("raw") >= 10, F.lower(F.hex(F.substring("raw", 3, 8)))), "KeyAlgorithm": F.when(F.length("raw") >= 10, F.lit("ed25519"))}))

    prefix = F.when(F.col("service").isin("uhttpd", "nginx", "lighttpd"), "TLSConfig:").when(F.col("service").isin("java.security", "crypto.policy"), "java.security:").otherwise("ServiceCrypto:")
    facts = configs.service_facts(of("service-tls", "service-crypto", "mobile-tls").select("id", "path", "text"))
    extra.append(facts.select("id", F.concat(prefix, "key").alias("key"), F.lit(None).cast("string").alias("mime"), "value"))
    suites = facts.filter(F.col("key").isin("cipher_suite", "CipherString")).select("id", prefix.alias("p"), F.explode(F.split("value", r"[:;,\s]+")).alias("t"))
    resolved = suites.select("id", "p", F.explode(F.split(F.coalesce(crypto.suite_algorithms(F.col("t")), F.try_element_at(crypto.lookup(crypto.ALGORITHM_NAMES), F.upper("t"))), " ")).alias("value"))
    extra.append(resolved.select("id", F.concat("p", F.lit("algorithms")).alias("key"), F.lit(None).cast("string").alias("mime"), "value"))
    extra.append(configs.mobile_facts(of("mobile-tls")).select("id", F.concat(F.lit("MobileTls:"), "key").alias("key"), F.lit(None).cast("string").alias("mime"), "value"))

    jwt = of("tokens").select("id", F.explode(tokens.jwt_algorithms(F.col("text"))).alias("alg"))
    extra.append(_rows(jwt, "JWT:", {"alg": F.col("alg"), "signature_algorithm": crypto.jose_name(F.col("alg"))}))
    jwk = of("tokens").select("id", tokens.jwk_facts(F.col("text")).alias("k")).filter("k is not null")
    extra.append(_rows(jwk, "JWK:", {"kty": F.col("k.kty"), "crv": F.col("k.crv"), "use": F.col("k.use"), "private_present": F.col("k.private_present")}))

    found = needles_in(of("crypto-footprint"), list(FOOTPRINTS)).withColumn("algorithm", F.try_element_at(crypto.lookup(FOOTPRINTS), F.col("needle")))
    extra.append(_rows(found, "CryptoAlgorithms:", {"value": F.trim("needle"), "algorithm": F.col("algorithm"), "unknown": F.when(F.col("algorithm") == "", "true")}))

    locks = of("crypto-dependency").select("id", _name().alias("name"), "text")
    whole = F.when(F.col("name") == "Cargo.lock", textual.cargo_lock(F.col("text"))).when(F.col("name") == "package-lock.json", textual.npm_lock(F.col("text"))).when(F.col("name").isin("yarn.lock", "pnpm-lock.yaml"), textual.yarn_lock(F.col("text")))
    by_line = F.when(F.col("name") == "go.sum", F.transform(F.split("text", "\n"), textual.checksum_line)).when(F.col("name") == "requirements.txt", F.transform(F.split("text", "\n"), textual.requirement))
    asked = locks.select("id", F.explode(F.coalesce(whole, F.filter(by_line, lambda d: d.isNotNull()))).alias("d")).select("id", "d.name", "d.version")
    asked = asked.withColumn("families", F.try_element_at(crypto.lookup(crypto.FAMILIES), F.col("name"))).filter(F.col("families").isNotNull() | F.col("name").isin(*crypto.UNMAPPED))
    extra.append(_rows(asked, "CryptoDependency:", {"name": F.col("name"), "version": F.col("version"), "algorithms": F.col("families"), "mapped": F.col("families").isNotNull()}))

    release = of("jvm").select("id", "path", textual.properties(F.col("text")).alias("p"))
    value = lambda k: textual.unquoted(F.try_element_at("p", F.lit(k.lower())))
    vendor = textual.vendor(value("IMPLEMENTOR"), F.col("path"))
    extra.append(_rows(release, "jvm:", {n: value(k) for k, n in RELEASE.items()} | {"Vendor": vendor["vendor"], "IsJDK": F.upper(value("IMAGE_TYPE")) == "JDK"}))
    version = F.coalesce(*(F.nullif(value(k), F.lit("")) for k in ("JAVA_RUNTIME_VERSION", "JAVA_VERSION", "SEMANTIC_VERSION", "FULL_VERSION")))
    purls.append(release.select("id", packages.purl("generic", vendor["product"], version, vendor["vendor"]).alias("purl")))

    gradle = lines(of("gradle")).select("id", textual.gradle_dependency(F.col("line")).alias("d")).filter("d is not null")
    purls.append(gradle.select("id", packages.purl("maven", F.col("d.artifact_id"), F.col("d.version"), F.col("d.group_id")).alias("purl")))
    counted = gradle.groupBy("id").agg(F.count("*").alias("n"))
    extra.append(_rows(counted, "gradle:", {"DependencyCount": F.col("n")}))

    pom = of("maven").filter(_name().rlike(r"\.pom$|^pom\.xml$")).select("id", poms.project_facts("text").alias("m")).filter("m.artifact_id is not null")
    extra.append(_rows(pom, "", {"Name": F.col("m.name"), "Description": F.col("m.description"), "Url": F.col("m.url"), "ArtifactID": F.col("m.artifact_id"), "Version": F.col("m.version"), "License": F.array_join("m.licences", ", "), "maven:ParentPOM": F.col("m.parent"), "maven:SCM_URL": F.col("m.scm_url"), "maven:DEPENDENCIES": poms.rendered(F.col("m.dependencies")), "maven:RuntimeDependencies": poms.rendered(poms.runtime(F.col("m.dependencies")))}))
    purls.append(pom.filter("m.group_id is not null and m.version is not null").select("id", packages.purl("maven", packages.maven_id(F.col("m.artifact_id")), F.col("m.version"), packages.maven_id(F.col("m.group_id")), F.lit("type=pom")).alias("purl")))
    jars = claimed_.filter("strategy = 'maven'").select("id", packages.coordinates(_name()).alias("c"), packages.classifier_qualifier(packages.classifier(_name())).alias("q")).filter("c.version is not null and c.group_id is not null")
    purls.append(jars.select("id", packages.purl("maven", F.col("c.artifact_id"), F.col("c.version"), F.col("c.group_id"), F.col("q")).alias("purl")))

    at = places if places is not None else claimed_.select(F.lit("").alias("scope"), "path", "id")
    once = lambda name: of(name).select("id", "path", "text").distinct()
    for found, language in ((manifests.language_packages(once("language-package")), True), (manifests.system_packages(once("os-package"), at), False)):
        facts, own = manifests.facts(manifests.held_by(found, at), language)
        extra.append(prefixed("", facts))
        purls.append(own)
    if contents is not None:
        facts, own = assemblies.facts(records.records(contents.filter(F.hex(F.substring("content", 1, 2)) == "4D5A"), "assembly"))
        extra.append(prefixed("", facts))
        purls.append(own)
        rpms = contents.filter(F.hex(F.substring("content", 1, 4)) == "EDABEEDB")
        facts, own = manifests.facts(manifests.rpm_rows(records.records(rpms, "rpm")), False)
        extra.append(prefixed("", facts))
        purls.append(own)

    ini = of("openssl").select("id", "text").dropDuplicates(["id"])
    if not ini.isEmpty():
        rows = materialised(inifiles.section_rows(ini), "sections")
        sections = materialised(inifiles.active(rows), "active")
        own = at.join(of("openssl").select("id", "path").distinct(), ["id", "path"], "left_semi")
        extra += [prefixed("openssl.cnf:", inifiles.security_facts(rows, sections)), prefixed("openssl.cnf:", bundled(own, inifiles.openssl_includes(rows, sections)))]
    java = of("java-security").select("id", "text").dropDuplicates(["id"])
    if not java.isEmpty():
        own = at.join(of("java-security").select("id", "path").distinct(), ["id", "path"], "left_semi")
        wanted = inifiles.java_includes(java)
        facts = inifiles.effective(own, inifiles.java_properties(java), inifiles.include_edges(own, wanted))
        extra += [prefixed("java.security:", facts), prefixed("java.security:", bundled(own, wanted))]

    def union(parts: list[DataFrame]) -> DataFrame:
        whole_ = parts[0]
        for more in parts[1:]:
            whole_ = whole_.unionByName(more)
        return whole_.distinct()

    return configs.without_leaks(union(extra).filter("value is not null")), union(purls).filter("purl is not null")
