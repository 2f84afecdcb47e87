"""Queries for column functions: inputs are picked from fixed lists by the keys of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, packages, textual
from ..functions.tokens import image_facts
from ..operators import bills, joins
from ..operators.jars import coordinates
from .base import picked, picked_sql, query, quoted, table, values_sql


def part(spark, sf_dir, **columns):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", *(c.alias(n) for n, c in columns.items()))


ALGORITHMS = ("AES-128-GCM", "SHA256withRSA", "hmac-md4", "sha3-256", "argon2id", "ChaCha20-Poly1305", "ECDH", "ed25519", "RSA-2048", "pbkdf-x", "ml-kem-768", "x448", "Foo Bar (7)", "blake2b-512", "rc4-40", "HMAC", "des", "kyber512", "dsa-1024", "---", "md5", "SLH-DSA")
A_SQL = picked_sql("p_partkey", ALGORITHMS)
PRIMITIVE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(a), '{'|'.join(parts)}') THEN '{kind}'" for kind, parts in crypto.PRIMITIVES) + " ELSE 'other' END"
NAME_SQL = "CASE WHEN regexp_replace(regexp_replace(regexp_replace(lower(a), '-?[^a-z0-9-]+', '-', 'g'), '^-', ''), '-$', '') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(regexp_replace(lower(a), '-?[^a-z0-9-]+', '-', 'g'), '^-', ''), '-$', '') END"


@query("f20_primitive", f"SELECT p_partkey, {PRIMITIVE_SQL} AS primitive FROM (SELECT p_partkey, {A_SQL} AS a FROM part) t")
def f20_primitive(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.primitive(picked("p_partkey", ALGORITHMS)).alias("primitive"))


@query("f21_parameter", f"""SELECT p_partkey, CASE WHEN lower(a) IN ({', '.join(map(quoted, crypto.NO_PARAMETER))}) THEN NULL
ELSE coalesce((SELECT v.v FROM {values_sql(crypto.PARAMETERS.items())} v(k, v) WHERE v.k = lower(t.a)), CASE WHEN regexp_matches(lower(a), 'ed25519|ed448|x25519|x448') THEN NULL ELSE nullif(regexp_extract(lower(a), '([0-9]+)', 1), '') END) END AS parameter
FROM (SELECT p_partkey, {A_SQL} AS a FROM part) t""")
def f21_parameter(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.parameter(picked("p_partkey", ALGORITHMS)).alias("parameter"))


@query("f22_algorithm_ref", f"SELECT p_partkey, 'alg:' || {PRIMITIVE_SQL} || ':' || {NAME_SQL} AS ref FROM (SELECT p_partkey, {A_SQL} AS a FROM part) t")
def f22_algorithm_ref(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.algorithm_ref(picked("p_partkey", ALGORITHMS)).alias("ref"))


SIGNATURES = ("<unknown-sig-oid-2.16.840.1.101.3.4.3.17>", "<unknown-sig-oid-2.16.840.1.101.3.4.3.40>", "<unknown-sig-oid-1.2.3>", "SHA256withRSA", "<", "<>")


@query("f23_signature_name", f"""SELECT p_partkey, CASE WHEN regexp_matches(a, '^<.*>$') THEN coalesce((SELECT v.v FROM {values_sql(crypto.SIGNATURE_IDS.items())} v(k, v) WHERE v.k = a[2:-2]), a[2:-2]) ELSE a END AS name
FROM (SELECT p_partkey, {picked_sql('p_partkey', SIGNATURES)} AS a FROM part) t""")
def f23_signature_name(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.signature_name(picked("p_partkey", SIGNATURES)).alias("name"))


CIPHERS = ("ECDHE-RSA-AES128-GCM-SHA256:!aNULL:AES256-SHA@SECLEVEL=1", "tls_aes_128_gcm_sha256, ?DES-CBC3-SHA", "HIGH;!MD5;+AES128-SHA", "", "TLS_CHACHA20_POLY1305_SHA256")
TOKEN_SQL = f"tokens AS (SELECT p_partkey, trim(unnest(regexp_split_to_array({picked_sql('p_partkey', CIPHERS)}, '[:;,]'))) AS token FROM part)"


def tokens(spark, sf_dir):
    own = part(spark, sf_dir).select("p_partkey", F.explode(F.split(picked("p_partkey", CIPHERS), "[:;,]")).alias("token"))
    return own.select("p_partkey", F.trim("token").alias("token")).filter("token <> ''")


@query("f24_cipher_tokens", f"WITH {TOKEN_SQL} SELECT p_partkey, upper(regexp_replace(regexp_replace(token, '^[!+?]+', ''), '@.*$', '')) AS token FROM tokens WHERE token <> ''")
def f24_cipher_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("p_partkey", crypto.cipher_token(F.col("token")).alias("token"))


@query("j11_cipher_suites", f"WITH {TOKEN_SQL} SELECT p_partkey, token, (SELECT v.v FROM {values_sql(crypto.SUITES.items())} v(k, v) WHERE v.k = upper(regexp_replace(regexp_replace(t.token, '^[!+?]+', ''), '@.*$', ''))) AS algorithms FROM tokens t WHERE token <> ''")
def j11_cipher_suites(spark, sf_dir):
    return tokens(spark, sf_dir).select("p_partkey", "token", crypto.suite_algorithms(F.col("token")).alias("algorithms"))


LISTS = ("AES-256-GCM:AES-128-GCM CHACHA20-POLY1305", "bf-cbc, des", "SHA512,sha1", "none")


@query("j11_algorithm_lists", f"""SELECT p_partkey, v.v AS algorithm FROM (SELECT p_partkey, unnest(regexp_split_to_array({picked_sql('p_partkey', LISTS)}, '[ ,:]+')) AS t FROM part) t JOIN {values_sql(crypto.ALGORITHM_NAMES.items())} v(k, v) ON v.k = upper(t.t)""")
def j11_algorithm_lists(spark, sf_dir):
    own = part(spark, sf_dir).select("p_partkey", F.explode(F.split(picked("p_partkey", LISTS), r"[\s,:]+")).alias("t"))
    return own.select("p_partkey", F.try_element_at(crypto.lookup(crypto.ALGORITHM_NAMES), F.upper("t")).alias("algorithm")).filter("algorithm is not null")


PROPOSALS = ("aes256-sha256-modp2048,aes128-sha1-modp1536", "chacha20poly1305-prfsha256-x25519!", "aes128gcm16-ecp384", "bogus", "sha1-sha1-aes128")


@query("f25_transforms", f"""SELECT p_partkey, i, v.v AS algorithm FROM (SELECT p_partkey, unnest(string_split(p, '-')) AS t, generate_subscripts(string_split(p, '-'), 1) AS i FROM (SELECT p_partkey, trim(string_split({picked_sql('p_partkey', PROPOSALS)}, ',')[1]) AS p FROM part) a) b
JOIN {values_sql(crypto.TRANSFORMS.items())} v(k, v) ON v.k = b.t QUALIFY row_number() OVER (PARTITION BY p_partkey, v.v ORDER BY i) = 1""".replace("SELECT p_partkey, i, v.v", "SELECT p_partkey, v.v"))
def f25_transforms(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.explode(crypto.transform_algorithms(picked("p_partkey", PROPOSALS))).alias("algorithm"))


HASHED = ("$1$salt$hash", "$2b$12$abcdefghijklmnopqrstuv", "$6$rounds=5000$saltsalt$h", "$5$s$h", "$7$params$salt$h", "$y$j9T$salt$h", "$argon2id$v=19$m=1,t=2,p=1$salt$h", "$apr1$salt$h", "$3$$h", "*", "!!", "", "plain", "$6$x")
FULL = "list_filter(string_split(h, '$'), lambda x: x <> '')"


@query("f26_crypt_details", f"""SELECT p_partkey, algorithm, CASE WHEN algorithm = 'bcrypt' THEN string_split(h, '$')[3] END AS cost,
CASE WHEN algorithm IN ('scrypt', 'yescrypt') THEN string_split(h, '$')[3] WHEN algorithm = 'argon2id' THEN string_split(h, '$')[4] END AS params,
CASE WHEN algorithm = 'bcrypt' THEN CASE WHEN len({FULL}) >= 2 THEN {FULL}[-1] END WHEN algorithm NOT IN ('locked', 'nt-hash', 'other') AND len({FULL}) >= 3 THEN {FULL}[-2] END AS salt
FROM (SELECT p_partkey, h, CASE WHEN h IN ('*', '!', '!!', 'x', '') THEN 'locked' WHEN starts_with(h, '$1$') THEN 'md5' WHEN regexp_matches(h, '^[$]2[aby][$]') THEN 'bcrypt' WHEN starts_with(h, '$3$') THEN 'nt-hash' WHEN starts_with(h, '$5$') THEN 'sha256'
WHEN starts_with(h, '$6$') THEN 'sha512' WHEN starts_with(h, '$7$') THEN 'scrypt' WHEN starts_with(h, '$y$') THEN 'yescrypt' WHEN starts_with(h, '$argon2id$') THEN 'argon2id' WHEN starts_with(h, '$apr1$') THEN 'apr1' ELSE 'other' END AS algorithm
FROM (SELECT p_partkey, {picked_sql('p_partkey', HASHED)} AS h FROM part) a) b""")
def f26_crypt_details(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.crypt_details(picked("p_partkey", HASHED)).alias("d")).select("p_partkey", "d.*")


TOKENS = ("HS256", "RS512", "EdDSA", "none", "XX1", "ES384")


@query("f27_jose_names", f"SELECT p_partkey, coalesce((SELECT v.v FROM {values_sql(crypto.JOSE.items())} v(k, v) WHERE v.k = t.a), lower(a)) AS name FROM (SELECT p_partkey, {picked_sql('p_partkey', TOKENS)} AS a FROM part) t")
def f27_jose_names(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.jose_name(picked("p_partkey", TOKENS)).alias("name"))


PACKAGES = ("ring", "serde", "sha2", "webpki", "p256", "left-pad", "cryptography", "golang.org/x/crypto", "botan")


@query("j10_families", f"""SELECT p_partkey, name, families, families IS NOT NULL AS mapped FROM (SELECT p_partkey, name, (SELECT v.v FROM {values_sql(crypto.FAMILIES.items())} v(k, v) WHERE v.k = t.name) AS families FROM (SELECT p_partkey, {picked_sql('p_partkey', PACKAGES)} AS name FROM part) t) u
WHERE families IS NOT NULL OR name IN ({', '.join(map(quoted, crypto.UNMAPPED))})""")
def j10_families(spark, sf_dir):
    own = part(spark, sf_dir, name=picked("p_partkey", PACKAGES)).withColumn("families", F.try_element_at(crypto.lookup(crypto.FAMILIES), F.col("name")))
    return own.filter(F.col("families").isNotNull() | F.col("name").isin(*crypto.UNMAPPED)).select("p_partkey", "name", "families", F.col("families").isNotNull().alias("mapped"))


KEYS = ("Certificates:SubjectDN", "openssl.cnf:suite:0", "maven:JarType", "opensslXcnf:a", "JWT:alg", "Name", "java.security:x", "JWTs:alg")


@query("p06_crypto_keys", f"SELECT p_partkey, regexp_matches(k, '^({'|'.join(p.replace('.', '[.]') for p in crypto.CRYPTO_PREFIXES)}):') AS is_crypto FROM (SELECT p_partkey, {picked_sql('p_partkey', KEYS)} AS k FROM part) t")
def p06_crypto_keys(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", crypto.is_crypto_key(picked("p_partkey", KEYS)).alias("is_crypto"))


@query("p07_crypto_family", f"""WITH t AS (SELECT p_brand, {picked_sql('p_partkey', KEYS)} AS k FROM part)
SELECT p_brand, CASE WHEN bool_or(starts_with(k, 'Certificates:')) THEN 'certificate' WHEN bool_or(starts_with(k, 'openssl.cnf:')) THEN 'protocol' WHEN bool_or(starts_with(k, 'java.security:')) THEN 'policy' WHEN bool_or(starts_with(k, 'JWT:')) THEN 'token' ELSE 'none' END AS family FROM t GROUP BY p_brand""")
def p07_crypto_family(spark, sf_dir):
    """The first family in the order of precedence that any of an item's keys belongs to."""
    has = lambda p: F.bool_or(F.col("k").startswith(p + ":"))
    family = F.when(has("Certificates"), "certificate").when(has("openssl.cnf"), "protocol").when(has("java.security"), "policy").when(has("JWT"), "token").otherwise("none")
    return part(spark, sf_dir, k=picked("p_partkey", KEYS)).groupBy("p_brand").agg(family.alias("family"))


DIRT = ("..a..b..", " org/apache//x ", "née!", "...", "", "a b", "x_y-z.1")


@query("f08_sanitizer", f"""SELECT p_partkey, nullif(regexp_replace(regexp_replace(regexp_replace(trim(replace(a, '/', '.')), '[^A-Za-z0-9_.-]', '', 'g'), '[.]{{2,}}', '.', 'g'), '^[.]+|[.]+$', '', 'g'), '') AS id FROM (SELECT p_partkey, {picked_sql('p_partkey', DIRT)} AS a FROM part) t""")
def f08_sanitizer(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.maven_id(picked("p_partkey", DIRT)).alias("id"))


PURL_SQL = "'pkg:generic/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') || '@' || p_size"


@query("f09_purl", f"SELECT p_partkey, {PURL_SQL} AS purl FROM part")
def f09_purl(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.purl("generic", F.col("p_name"), F.col("p_size").cast("string"), F.col("p_brand")).alias("purl"))


@query("k05_purls", f"SELECT DISTINCT {PURL_SQL} AS purl FROM part ORDER BY purl")
def k05_purls(spark, sf_dir):
    """The registry of package URLs."""
    return f09_purl(spark, sf_dir).select("purl").distinct().orderBy("purl")


@query("a05_purl_aliases", f"SELECT 'P' || p_partkey AS src, 'alias:from' AS edge_type, {PURL_SQL} AS dst FROM part UNION SELECT {PURL_SQL}, 'alias:to', 'P' || p_partkey FROM part")
def a05_purl_aliases(spark, sf_dir):
    from ..operators.graph import with_reversed

    return with_reversed(f09_purl(spark, sf_dir).select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.lit("alias:from").alias("edge_type"), F.col("purl").alias("dst")))


@query("f10_coordinates", """WITH t AS (SELECT p_partkey, p_partkey % 4 AS kind, p_size, replace(lower(p_brand), '#', '') AS b FROM part)
SELECT p_partkey, CASE WHEN kind = 0 THEN 'org.' || b END AS group_id, CASE kind WHEN 0 THEN 'lib' || p_size WHEN 1 THEN 'tool-' || b WHEN 3 THEN 'x_' || p_size END AS artifact_id,
    CASE kind WHEN 0 THEN p_size || '.' || p_partkey WHEN 1 THEN p_size || '-rc' || p_partkey WHEN 3 THEN p_partkey || '+b' END AS version FROM t""")
def f10_coordinates(spark, sf_dir):
    """File names made of known coordinates; every fourth tells no version."""
    brand, size, key = F.regexp_replace(F.lower("p_brand"), "#", ""), F.col("p_size"), F.col("p_partkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("org."), brand, F.lit(".lib"), size, F.lit("-"), size, F.lit("."), key, F.lit(".jar"))).when(key % 4 == 1, F.concat(F.lit("tool-"), brand, F.lit("-"), size, F.lit("-rc"), key, F.lit(".war")))
    name = name.when(key % 4 == 2, F.concat(F.lit("noversion"), key, F.lit(".jar"))).otherwise(F.concat(F.lit("x_"), size, F.lit("-"), key, F.lit("+b.jar")))
    return part(spark, sf_dir).select("p_partkey", packages.coordinates(name).alias("c")).select("p_partkey", "c.*")


@query("f11_package_group", f"SELECT p_partkey, CASE WHEN contains(a, '.') THEN regexp_replace(a, '[.][^.]*$', '') END AS group_id FROM (SELECT p_partkey, trim(regexp_replace({picked_sql('p_partkey', ('org.apache.commons', 'org.x.y.*', 'single', '*', 'a.b'))}, '[.][*]$', '')) AS a FROM part) t")
def f11_package_group(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.group_of_package(picked("p_partkey", ("org.apache.commons", "org.x.y.*", "single", "*", "a.b"))).alias("group_id"))


COMPANIONS = ("a-1.jar", "a-1-SOURCES.jar", "b-javadoc.jar", "b-javadocs.jar", "c.war", "c.txt", "d-sources.jar", "e.lpkg")


@query("f12_classifier", f"SELECT p_partkey, CASE WHEN lower(a) LIKE '%-sources.jar' THEN 'sources' WHEN regexp_matches(lower(a), '-javadocs?[.]jar$') THEN 'javadoc' END AS classifier FROM (SELECT p_partkey, {picked_sql('p_partkey', COMPANIONS)} AS a FROM part) t")
def f12_classifier(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.classifier(picked("p_partkey", COMPANIONS)).alias("classifier"))


@query("p08_archive_names", f"SELECT p_partkey, regexp_matches(lower(a), '[.]({'|'.join(packages.ARCHIVES)})$') AND NOT regexp_matches(lower(a), '-(sources|javadoc)[.]jar$') AS is_archive FROM (SELECT p_partkey, {picked_sql('p_partkey', COMPANIONS)} AS a FROM part) t")
def p08_archive_names(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.is_archive(picked("p_partkey", COMPANIONS)).alias("is_archive"))


IDS = ("spring", "spring-core", "commons", "commons-collections4", "core", "a", "spring_boot", "springframework")
STEMS = ("spring-core", "spring", "commons-collections4", "a", "spring_boot-x")
SCORE_SQL = """CASE WHEN length(n) < 2 THEN 0 WHEN a = n THEN 3 WHEN length(a) > 2 AND (starts_with(n, a || '-') OR starts_with(n, a || '_')) THEN 2 WHEN length(n) > 2 AND (starts_with(a, n || '-') OR starts_with(a, n || '_')) THEN 1 ELSE 0 END"""


@query("f13_match_score", f"SELECT p_partkey, {SCORE_SQL} AS score FROM (SELECT p_partkey, {picked_sql('p_partkey', IDS)} AS a, {picked_sql('p_size', STEMS)} AS n FROM part) t")
def f13_match_score(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.match_score(picked("p_partkey", IDS), picked("p_size", STEMS)).alias("score"))


@query("w01_primary", f"""SELECT jar, artifact_id, score FROM (SELECT p_brand AS jar, a AS artifact_id, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY p_brand ORDER BY {SCORE_SQL} DESC, length(a) DESC, a) AS r
FROM (SELECT p_brand, {picked_sql('p_partkey', IDS)} AS a, {picked_sql('length(p_brand)', STEMS)} AS n FROM part) t WHERE {SCORE_SQL} > 0) u WHERE r = 1""")
def w01_primary(spark, sf_dir):
    own = part(spark, sf_dir, artifact_id=picked("p_partkey", IDS)).withColumn("len", F.length("p_brand")).withColumn("name", picked("len", STEMS))
    return joins.primary(own.select(F.col("p_brand").alias("jar"), "name", "artifact_id", F.lit("g").alias("group_id"), F.lit("1").alias("version"))).select("jar", "artifact_id", "score")


@query("w02_priority", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN 'pom' END, CASE WHEN p_size % 3 = 0 THEN 'embedded' END, CASE WHEN p_size % 5 = 0 THEN 'filename' END, 'manifest') AS origin FROM part")
def w02_priority(spark, sf_dir):
    """Each field comes from the first source that tells it."""
    told = lambda n, name: F.when(F.col("p_size") % n == 0, F.struct(F.lit(name).alias("source"), F.lit("version").alias("field"), F.concat(F.lit("1."), "p_size").alias("value")))
    rows = F.filter(F.array(told(5, "filename"), told(3, "embedded"), told(1, "manifest"), told(2, "pom")), lambda r: r.isNotNull())
    own = part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.explode(rows).alias("r")).select("id", "r.*")
    return coordinates(own).select(F.col("id").alias("p_partkey"), F.col("source").alias("origin"))


IMAGES = ("nginx:1.2", "library/nginx:latest", "reg.io:5000/ns/app:v1", "a/b/c/d:e", "nginx")
I = "regexp_replace(a, ':[^:]*$', '')"


@query("f14_image_parts", f"SELECT p_partkey, CASE WHEN len(string_split({I}, '/')) >= 3 THEN split_part({I}, '/', 1) END AS namespace, CASE WHEN len(string_split({I}, '/')) >= 3 THEN regexp_replace({I}, '^[^/]*/', '') ELSE {I} END AS name, nullif(regexp_extract(a, ':([^:]*)$', 1), '') AS version FROM (SELECT p_partkey, {picked_sql('p_partkey', IMAGES)} AS a FROM part) t")
def f14_image_parts(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.image_parts(picked("p_partkey", IMAGES)).alias("c")).select("p_partkey", "c.*")


@query("f15_short_name", f"SELECT p_partkey, regexp_split_to_array(a, '[:/]')[-1] AS name FROM (SELECT p_partkey, {picked_sql('p_partkey', IMAGES)} AS a FROM part) t")
def f15_short_name(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", packages.short_name(picked("p_partkey", IMAGES)).alias("name"))


@query("f17_bom_names", f"SELECT p_partkey, 'cbom_' || replace(replace(a, ':', '_'), '/', '_') || '.json' AS file, 'dep-' || replace(replace(lower(a), '/', '-'), ' ', '-') AS ref FROM (SELECT p_partkey, {picked_sql('p_partkey', IMAGES)} AS a FROM part) t")
def f17_bom_names(spark, sf_dir):
    own = picked("p_partkey", IMAGES)
    return part(spark, sf_dir).select("p_partkey", packages.bom_name(own).alias("file"), packages.dependency_ref(own).alias("ref"))


DATES = (("2024-01-15T10:30:00Z", "2024-01-15 10:30:00"), ("2024-01-15", "2024-01-15 00:00:00"), ("2024-01-15 10:30:00", "2024-01-15 10:30:00"), ("3/4/2021", "2021-03-04 00:00:00"), ("13/2/2020", "2020-02-13 00:00:00"), ("Jan 5, 2020", "2020-01-05 00:00:00"), ("5 January 2020", "2020-01-05 00:00:00"), ("not a date", ""))


@query("f40_dates", f"SELECT p_partkey, CAST(nullif({picked_sql('p_partkey', [d for _, d in DATES])}, '') AS TIMESTAMP) AS date FROM part")
def f40_dates(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", textual.date(picked("p_partkey", [d for d, _ in DATES])).cast("timestamp_ntz").alias("date"))


BUILD = (("1704067200000", "2024-01-01 00:00:00"), ("2024-01-15T10:30:00Z", "2024-01-15 10:30:00"), ("05-Jan-2020", "2020-01-05 00:00:00"), ("20200105-1010", "2020-01-05 10:10:00"), ("x", ""))


@query("f41_build_dates", f"SELECT p_partkey, CAST(nullif({picked_sql('p_partkey', [d for _, d in BUILD])}, '') AS TIMESTAMP) AS date FROM part")
def f41_build_dates(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", textual.build_date(picked("p_partkey", [d for d, _ in BUILD])).cast("timestamp_ntz").alias("date"))


REQUIREMENTS = ("ring==1.2", "  a >= 2 ", "# note", "-r other.txt", "b~=1!=2", "plain", "==3", "")


@query("f45_requirements", f"""SELECT p_partkey, trim(CASE WHEN op IS NULL THEN a ELSE left(a, strpos(a, op) - 1) END) AS name, CASE WHEN op IS NULL THEN '' ELSE trim(substr(a, strpos(a, op) + 2)) END AS version FROM (SELECT *, CASE WHEN contains(a, '==') THEN '==' WHEN contains(a, '>=') THEN '>=' WHEN contains(a, '<=') THEN '<=' WHEN contains(a, '~=') THEN '~=' WHEN contains(a, '!=') THEN '!=' END AS op
FROM (SELECT p_partkey, trim({picked_sql('p_partkey', REQUIREMENTS)}) AS a FROM part) t) u WHERE a <> '' AND NOT starts_with(a, '#') AND NOT starts_with(a, '-') AND trim(CASE WHEN op IS NULL THEN a ELSE left(a, strpos(a, op) - 1) END) <> ''""")
def f45_requirements(spark, sf_dir):
    return part(spark, sf_dir, r=textual.requirement(picked("p_partkey", REQUIREMENTS))).filter("r is not null").select("p_partkey", "r.*")


LOCKED = ("org.a:b:1.0=compileClasspath,runtimeClasspath", "# comment", "empty=annotationProcessor", "g:a:2", "x.y:z:3=test")


@query("f45_gradle", f"""SELECT p_partkey, regexp_extract(a, '^([^:=#]+):([^:=]+):([^:=]+)(=(.*))?$', 1) AS group_id, regexp_extract(a, '^([^:=#]+):([^:=]+):([^:=]+)(=(.*))?$', 2) AS artifact_id, regexp_extract(a, '^([^:=#]+):([^:=]+):([^:=]+)(=(.*))?$', 3) AS version, regexp_extract(a, '^([^:=#]+):([^:=]+):([^:=]+)(=(.*))?$', 5) AS configurations
FROM (SELECT p_partkey, {picked_sql('p_partkey', LOCKED)} AS a FROM part) t WHERE regexp_matches(a, '^([^:=#]+):([^:=]+):([^:=]+)')""")
def f45_gradle(spark, sf_dir):
    own = part(spark, sf_dir, d=textual.gradle_dependency(picked("p_partkey", LOCKED))).filter("d is not null")
    return own.select("p_partkey", "d.group_id", "d.artifact_id", "d.version", F.array_join("d.configurations", ",").alias("configurations"))


RELEASES = (("Azul Systems", "/opt/jdk"), ("Eclipse Adoptium", "/x"), ("Amazon.com Inc.", "/x"), ("Oracle Corporation", "/x"), ("", "/opt/zulu-17"), ("Unknown", "/x"), ("Microsoft", "/y"), ("IBM", "/z"))


@query("f51_vendors", f"""SELECT p_partkey, CASE WHEN contains(i, 'azul') OR contains(p, 'zulu') THEN 'azul/zulu' WHEN regexp_matches(i, 'eclipse|adoptium|temurin') THEN 'eclipse/temurin' WHEN regexp_matches(i, 'amazon|corretto') THEN 'amazon/corretto' WHEN contains(i, 'oracle') THEN 'oracle/jdk' WHEN contains(i, 'ibm') THEN 'ibm/jdk' WHEN contains(i, 'microsoft') THEN 'microsoft/jdk' ELSE 'openjdk/jdk' END AS vendor
FROM (SELECT p_partkey, lower({picked_sql('p_partkey', [a for a, _ in RELEASES])}) AS i, lower({picked_sql('p_partkey', [b for _, b in RELEASES])}) AS p FROM part) t""")
def f51_vendors(spark, sf_dir):
    own = textual.vendor(picked("p_partkey", [a for a, _ in RELEASES]), picked("p_partkey", [b for _, b in RELEASES]))
    return part(spark, sf_dir, v=own).select("p_partkey", F.concat_ws("/", "v.vendor", "v.product").alias("vendor"))


PROPS = ("# c\nGroupId=org.a\nartifactId = b=c\nversion=1\nversion=2", "none", "A=1\r\n b = 2 ")


@query("f44_properties", f"""WITH l AS (SELECT p_partkey, unnest(string_split({picked_sql('p_partkey', PROPS)}, chr(10))) AS x, generate_subscripts(string_split({picked_sql('p_partkey', PROPS)}, chr(10)), 1) AS i FROM part)
SELECT p_partkey, lower(trim(split_part(t, '=', 1))) AS key, arg_max(trim(regexp_replace(t, '^[^=]*=', '')), i) AS value FROM (SELECT p_partkey, i, trim(replace(x, chr(13), '')) AS t FROM l) u WHERE contains(t, '=') AND NOT starts_with(t, '#') GROUP BY 1, 2""")
def f44_properties(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.explode(textual.properties(picked("p_partkey", PROPS))))


@query("f54_bundle_headers", """WITH t AS (SELECT p_partkey, p_size, replace(lower(p_brand), '#', '') AS b FROM part)
SELECT p_partkey, 'org.' || b AS name, 'version=1.' || p_size || ';x=y' AS attributes FROM t UNION ALL SELECT p_partkey, 'com.n' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'uses=a.b' ELSE '' END FROM t""")
def f54_bundle_headers(spark, sf_dir):
    """Headers of two packages, the first with a quoted version."""
    brand, uses = F.regexp_replace(F.lower("p_brand"), "#", ""), F.when(F.col("p_size") % 2 == 0, ";uses:=a.b").otherwise("")
    header = F.concat(F.lit("org."), brand, F.lit(';version="1.'), "p_size", F.lit('";x=y,com.n'), "p_partkey", uses)
    own = part(spark, sf_dir).select("p_partkey", F.explode(textual.bundle_header(header)).alias("c"))
    return own.select("p_partkey", "c.name", F.array_join("c.attributes", ";").alias("attributes"))


STORES = ("lib/security/cacerts", "a.P12", "b.jks", "c.pem", "x/keystore", "d.kbx", "e.bks", "f.jceks", "g.pfx")


@query("f58_keystores", f"""SELECT p_partkey, CASE WHEN n IN ('cacerts', 'jssecacerts', 'keystore') OR n LIKE '%.jks' THEN 'application/x-java-keystore' WHEN n LIKE '%.jceks' THEN 'application/x-java-jce-keystore' WHEN n LIKE '%.bks' THEN 'application/x-bks-keystore'
WHEN regexp_matches(n, '[.](p12|pfx)$') THEN 'application/x-pkcs12' WHEN n LIKE '%.kbx' THEN 'application/x-gnupg-keybox' END AS type FROM (SELECT p_partkey, lower(split_part({picked_sql('p_partkey', STORES)}, '/', -1)) AS n FROM part) t""")
def f58_keystores(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", textual.keystore_type(picked("p_partkey", STORES)).alias("type"))


@query("w05_history", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'COPY ' || p_name END, 'RUN ' || p_type, CASE WHEN p_size % 3 = 0 THEN 'CMD ' || p_brand END, CASE WHEN p_size % 5 = 0 THEN 'END' END], lambda x: x IS NOT NULL)[-3:], '|') AS history FROM part")
def w05_history(spark, sf_dir):
    """The last three commands of each part's image configuration, without empty layers."""
    step = lambda c, empty: F.struct(c.alias("created_by"), empty.alias("empty_layer"))
    odd = lambda n: F.col("p_size") % n != 0
    steps = F.array(step(F.concat(F.lit("COPY "), "p_name"), odd(2)), step(F.concat(F.lit("RUN "), "p_type"), F.lit(False)), step(F.concat(F.lit("CMD "), "p_brand"), odd(3)), step(F.lit("END"), odd(5)))
    config = F.to_json(F.struct(F.lit("linux").alias("os"), steps.alias("history")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(image_facts(config)["history"], "|").alias("history"))


@query("c03_algorithm_components", f"""WITH t AS (SELECT p_brand AS root, {A_SQL} AS a FROM part) SELECT DISTINCT root, 'alg:' || {PRIMITIVE_SQL} || ':' || {NAME_SQL} AS ref FROM t WHERE {NAME_SQL} <> 'unknown'""")
def c03_algorithm_components(spark, sf_dir):
    """The algorithms of services, each once for a brand."""
    own = part(spark, sf_dir, a=picked("p_partkey", ALGORITHMS)).select(F.col("p_brand").alias("root"), F.col("p_partkey").cast("string").alias("id"), "a")
    extra = own.select("id", F.lit("CryptoAlgorithms:algorithm").alias("key"), F.lit(None).cast("string").alias("mime"), F.col("a").alias("value"))
    parts = bills.components(bills.described(bills.item_maps(extra)))
    return bills.of_roots(own.select("root", "id", F.lit(0).alias("depth")), parts).select("root", "ref")


@query("c04_library_components", f"SELECT name, min(CAST(p_size AS VARCHAR)) AS version, 'dep-' || replace(replace(lower(name), '/', '-'), ' ', '-') AS ref FROM (SELECT {picked_sql('p_partkey', PACKAGES)} AS name, p_size FROM part) t GROUP BY name")
def c04_library_components(spark, sf_dir):
    """Lock files of one dependency in several versions: the lowest comes first."""
    own = part(spark, sf_dir, name=picked("p_partkey", PACKAGES)).select("name", F.col("p_size").cast("string").alias("version")).distinct()
    fact = lambda k, v: F.struct(F.lit(f"CryptoDependency:{k}").alias("key"), F.col(v).alias("value"))
    extra = own.select(F.col("name").alias("id"), F.explode(F.array(fact("name", "name"), fact("version", "version"))).alias("f")).select("id", "f.key", F.lit(None).cast("string").alias("mime"), "f.value")
    parts = bills.components(bills.described(bills.item_maps(extra)))
    json = lambda k: F.get_json_object("component", f"$.{k}")
    return parts.select(json("name").alias("name"), json("version").alias("version"), "ref")


@query("c05_certificate_keys", f"SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(nullif({picked_sql('p_partkey', ('CN=a', '', 'CN=b'))}, ''), 'CN=' || p_name) AS subject FROM part")
def c05_certificate_keys(spark, sf_dir):
    """A certificate's own value, else that of the first of its bundle."""
    own = F.nullif(picked("p_partkey", ("CN=a", "", "CN=b")), F.lit(""))
    rows = F.array(F.struct(F.lit("Certificates:SubjectDN").alias("key"), own.alias("value")), F.struct(F.lit("Certificates:Cert:0:SubjectDN").alias("key"), F.concat(F.lit("CN="), "p_name").alias("value")), F.struct(F.lit("Certificates:Cert:1:SubjectDN").alias("key"), F.lit("CN=0").alias("value")))
    extra = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.explode(rows).alias("f")).select("id", "f.key", F.lit(None).cast("string").alias("mime"), "f.value").filter("value is not null")
    parts = bills.components(bills.described(bills.item_maps(extra)))
    return parts.select("id", F.get_json_object("component", "$.cryptoProperties.certificateProperties.subjectName").alias("subject"))
