"""Queries over service files, tokens and policies; files are picked from fixed lists by the keys of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import configs
from .base import picked, picked_sql, query, quoted, table, values_sql

FILES = (
    ("etc/openvpn/server.conf", "# c\ndata-ciphers AES-256-GCM:AES-128-GCM\n auth sha256\ncert a.pem\nkey b.pem\ndh none"),
    ("etc/ipsec.conf", "conn x\n  ike=aes256-sha256-modp2048,aes128-sha1\n  esp = aes128gcm16"),
    ("etc/mosquitto.conf", "tls_ciphers HIGH\npsk_file /secret\ncertfile c"),
    ("etc/my.cnf", "[client]\nssl-cipher=NO\n[mysqld]\nssl-cipher=DHE-RSA-AES256-SHA\ntls_version=TLSv1.2, TLSv1.3\n[mysqldump]\nssl-key=n"),
    ("etc/wg0.conf", "PrivateKey = abc\nPresharedKey=def"),
    ("etc/krb5.conf", "[libdefaults]\n permitted_enctypes = aes256-cts aes128-cts"),
    ("etc/nginx.conf", "server {\n ssl_certificate /a.pem;\n ssl_ciphers HIGH:!aNULL;\n}"),
    ("etc/postgresql.conf", "ssl = on\nssl_min_protocol_version = TLSv1.2"),
    ("etc/haproxy.cfg", "bind *:443 ssl crt /x.pem\nssl-default-bind-ciphers ECDHE-RSA-AES128-GCM-SHA256"),
    ("lib/security/java.security", "jdk.tls.disabledAlgorithms=SSLv3, RC4\njdk.tls.ephemeralDHKeySize=2048"),
    ("etc/redis.conf", "tls-ciphers DEFAULT\ntls-cert-file r.crt"),
    ("etc/other.conf", "cipher none"),
)
PATHS, TEXTS = [p for p, _ in FILES], [t for _, t in FILES]


def files(spark, sf_dir, own=FILES):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), picked("p_partkey", [p for p, _ in own]).alias("path"), picked("p_partkey", [t for _, t in own]).alias("text"))


SERVICE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(path, {quoted(p)}) THEN '{s}'" for p, s in configs.SERVICES) + " END"


@query("f46_service_facts", f"""WITH f AS (SELECT p_partkey AS id, {picked_sql('p_partkey', PATHS)} AS path, {picked_sql('p_partkey', TEXTS)} AS text FROM part),
l AS (SELECT id, {SERVICE_SQL} AS service, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM f),
s AS (SELECT id, service, trim(raw) AS line, last_value(CASE WHEN starts_with(trim(raw), '[') THEN trim(raw) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS section FROM l WHERE service IS NOT NULL)
SELECT DISTINCT s.id, s.service, r.k AS key, CASE WHEN r.k IN ('psk_present', 'private_key_present') THEN 'true' ELSE trim(regexp_extract(line, r.p, 1)) END AS value
FROM s JOIN {values_sql(configs.RULES)} r(s, k, p) ON r.s = s.service AND regexp_matches(line, r.p) WHERE s.service <> 'mysql' OR starts_with(section, '[mysqld]')""")
def f46_service_facts(spark, sf_dir):
    return configs.service_facts(files(spark, sf_dir))


MOBILE_FILES = (
    ("res/xml/network_security_config.xml", '<network-security-config><base-config cleartextTrafficPermitted="false"><trust-anchors/></base-config></network-security-config>'),
    ("AndroidManifest.xml", '<manifest><application android:usesCleartextTraffic = "true"/></manifest>'),
    ("Info.plist", "<key>NSAppTransportSecurity</key><key>NSAllowsArbitraryLoads</key><true/>"),
    ("Info.plist", "<plist/>"),
)
M_SQL = f"m AS (SELECT p_partkey AS id, split_part({picked_sql('p_partkey', [p for p, _ in MOBILE_FILES])}, '/', -1) AS name, {picked_sql('p_partkey', [t for _, t in MOBILE_FILES])} AS text FROM part)"


@query("f50_mobile_facts", f"""WITH {M_SQL}
SELECT id, 'FileType' AS key, CASE name WHEN 'AndroidManifest.xml' THEN 'manifest' WHEN 'Info.plist' THEN 'apple-ats' ELSE 'network-security-config' END AS value FROM m WHERE contains(text, CASE name WHEN 'AndroidManifest.xml' THEN '<manifest' WHEN 'Info.plist' THEN 'NSAppTransportSecurity' ELSE '<network-security-config' END)
UNION ALL SELECT id, 'cleartext_allowed', regexp_extract(text, 'cleartextTrafficPermitted\\s*=\\s*"(true|false)"', 1) FROM m WHERE name = 'network_security_config.xml' AND contains(text, 'cleartextTrafficPermitted')
UNION ALL SELECT id, 'custom_ca', 'true' FROM m WHERE name = 'network_security_config.xml' AND contains(text, '<trust-anchors')
UNION ALL SELECT id, 'manifest_cleartext', regexp_extract(text, 'usesCleartextTraffic\\s*=\\s*"(true|false)"', 1) FROM m WHERE name = 'AndroidManifest.xml'
UNION ALL SELECT id, 'ats_arbitrary_loads', 'true' FROM m WHERE name = 'Info.plist' AND contains(text, 'NSAllowsArbitraryLoads')""")
def f50_mobile_facts(spark, sf_dir):
    return configs.mobile_facts(files(spark, sf_dir, MOBILE_FILES))


@query("p12_leak_filter", "SELECT doc_id AS id, k AS key, text AS value FROM documents, (VALUES ('Certificates:Serial'), ('Name')) v(k) WHERE NOT regexp_matches(text, 'PRIVATE KEY-----|openssh-key-v1') AND (k = 'Certificates:Serial' OR NOT regexp_matches(text, '[0-9a-f]{32,}'))")
def p12_leak_filter(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("Certificates:Serial"), F.lit("Name"))).alias("key"), F.col("text").alias("value"))
    return configs.without_leaks(own)


TOKENS = ("x eyJhbGciOiJSUzI1NiJ9.e30.sig y eyJhbGciOiJub25lIn0.e30. z", "none", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJhIjoxfQ.abc", "eyJub3QganNvbg.a")


@query("f28_jwt_algorithms", f"SELECT p_partkey AS id, {picked_sql('p_partkey', ('RS256,none', '', 'HS256', ''))} AS algorithms FROM part")
def f28_jwt_algorithms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(tokens.jwt_algorithms(picked("p_partkey", TOKENS)), ",").alias("algorithms"))


MANIFESTS = ("Manifest-Version: 1.0\r\nBundle-Name: A long\r\n  name\r\nX: 1\r\nx: 2\r\n", "no header", "Main-Class: a.B")


@query("f43_manifests", """SELECT p_partkey AS id, v.k AS key, v.v AS value FROM part JOIN (VALUES (0, 'manifest-version', '1.0'), (0, 'bundle-name', 'A long name'), (0, 'x', '1'), (2, 'main-class', 'a.B')) v(i, k, v) ON p_partkey % 3 = v.i""")
def f43_manifests(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(tokens.manifest(picked("p_partkey", MANIFESTS))))


CONFIGS = ('{"os":"linux","architecture":"arm64","config":{"Env":["A=1","B=2"],"Labels":{"org.label-schema.name":"n"}},"history":[{"created_by":"a"},{"created_by":"b","empty_layer":true},{"created_by":"c"},{"created_by":"d"},{"created_by":"e"}],"rootfs":{"diff_ids":["x"]}}', "{}")


@query("f55_image_facts", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'linux/arm64' ELSE '' END AS platform, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS env_count, CASE WHEN p_partkey % 2 = 0 THEN 'c,d,e' END AS history, CASE WHEN p_partkey % 2 = 0 THEN 'n' END AS title FROM part")
def f55_image_facts(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tokens.image_facts(picked("p_partkey", CONFIGS)).alias("f"))
    return own.select("id", "f.platform", "f.env_count", F.array_join("f.history", ",").alias("history"), "f.title")


LOCKS = (
    ("cargo", 'version = 3\n\n[[package]]\nname = "ring"\nversion = "0.17"\n\n[[package]]\nname = "sha2"\nversion = "1.0"\ndependencies = ["a"]\n'),
    ("yarn", '# yarn\nleft-pad@^1.0.0:\n  version "1.3.0"\n  resolved "x"\n\n"bcryptjs@~2":\n  version "2.4"\n'),
    ("npm", '{"dependencies":{"tweetnacl":{"version":"1.0.3"},"x":{}},"packages":{"":{"version":"9"},"node_modules/node-forge":{"version":"1.3"}}}'),
    ("none", "nothing"),
)


@query("f45_lockfiles", """SELECT p_partkey AS id, v.n AS name, v.v AS version FROM part JOIN (VALUES (0, 'ring', '0.17'), (0, 'sha2', '1.0'), (1, 'left-pad', '1.3.0'), (1, 'bcryptjs', '2.4'), (2, 'tweetnacl', '1.0.3'), (2, '', '9'), (2, 'node-forge', '1.3')) v(i, n, v) ON p_partkey % 4 = v.i""")
def f45_lockfiles(spark, sf_dir):
    from ..functions import textual

    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), picked("p_partkey", [k for k, _ in LOCKS]).alias("kind"), picked("p_partkey", [t for _, t in LOCKS]).alias("text"))
    found = F.when(F.col("kind") == "cargo", textual.cargo_lock(F.col("text"))).when(F.col("kind") == "yarn", textual.yarn_lock(F.col("text"))).when(F.col("kind") == "npm", textual.npm_lock(F.col("text")))
    return own.select("id", F.explode(found).alias("p")).select("id", "p.name", "p.version")


@query("p07_families", f"""WITH t AS (SELECT p_brand AS id, {picked_sql('p_partkey', ('JWT:alg', 'maven:x', 'SSH:KeyType', 'Kerberos:enctypes', 'Certificates:Serial', 'MobileTls:FileType'))} AS k FROM part WHERE p_size < 6),
r AS (SELECT id, min(CASE WHEN starts_with(k, 'Certificates:') THEN 0 WHEN starts_with(k, 'SSH:') THEN 5 WHEN starts_with(k, 'Kerberos:') THEN 9 WHEN starts_with(k, 'JWT:') THEN 10 WHEN starts_with(k, 'MobileTls:') THEN 15 END) AS p FROM t GROUP BY id)
SELECT id, CASE p WHEN 0 THEN 'certificate' WHEN 5 THEN 'ssh' WHEN 9 THEN 'kerberos' WHEN 10 THEN 'token' WHEN 15 THEN 'mobile' END AS family FROM r WHERE p IS NOT NULL""")
def p07_families(spark, sf_dir):
    from ..operators import cbom

    own = table(spark, sf_dir, "part").filter("p_size < 6")
    keys = ("JWT:alg", "maven:x", "SSH:KeyType", "Kerberos:enctypes", "Certificates:Serial", "MobileTls:FileType")
    return cbom.families(own.select(F.col("p_brand").alias("id"), picked("p_partkey", keys).alias("key")))


@query("o06_capped_list", "SELECT o_custkey AS id, count(*) AS revoked, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS serials, count(*) > 3 AS truncated FROM orders GROUP BY o_custkey")
def o06_capped_list(spark, sf_dir):
    """The first serials of a list, its whole size, and whether some are left out; the cap is the feature."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("s"))
    return own.select("id", F.size("s").cast("long").alias("revoked"), F.array_join(F.slice("s", 1, 3), ",").alias("serials"), (F.size("s") > 3).alias("truncated"))
