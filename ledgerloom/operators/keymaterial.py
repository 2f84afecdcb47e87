"""What certificates, revocation lists, key rings, SSH certificates and key stores tell.

Inputs are rows of ``sources.records``; each result is a long table (id, key, value).  A list's or a ring's rows are
aggregated by its id with combining functions; the serial numbers of a revocation list, which may be millions,
are filtered to the first ``MOST`` before they are collected, and counted without being collected.

Defined results: what is missing has no row; of equal extensions all count; serial numbers are those of the file's order;
elements behind a cut are not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import lookup
from ..functions.tokens import certificate_facts
from ..sources.records import BROKEN, CERTIFICATE, CHAIN, KEY, SUBPACKET

#: So many serial numbers of a revocation list are listed.
MOST = 10_000
# Names of the bits of a key's usage, in order, and of extended usages.
USAGES = ("digital-signature", "non-repudiation", "key-encipherment", "data-encipherment", "key-agreement", "key-cert-sign", "crl-sign", "encipher-only", "decipher-only")
EXTENDED = {"1.3.6.1.5.5.7.3.1": "server-auth", "1.3.6.1.5.5.7.3.2": "client-auth", "1.3.6.1.5.5.7.3.3": "code-signing", "1.3.6.1.5.5.7.3.4": "email-protection", "1.3.6.1.5.5.7.3.8": "time-stamping", "1.3.6.1.5.5.7.3.9": "ocsp-signing"}
# Labels of alternative names by tag; those without a value of their own.
NAMES = {0x81: "email:", 0x82: "DNS:", 0x86: "URI:", 0x87: "IP:"}
OTHERS = {0xA0: "OTHER:OtherName", 0xA3: "OTHER:X400Address", 0xA4: "OTHER:DirectoryName", 0xA5: "OTHER:EDIPartyName", 0x88: "OTHER:RegisteredID"}
# Parts of names by identifier.
PARTS = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.9": "STREET", "2.5.4.10": "O", "2.5.4.11": "OU", "0.9.2342.19200300.100.1.25": "DC", "0.9.2342.19200300.100.1.1": "UID", "1.2.840.113549.1.9.1": "emailAddress"}
# OpenPGP algorithms and curves.
PGP_ALGORITHMS = {"1": "rsa", "2": "rsa", "3": "rsa", "16": "elgamal", "17": "dsa", "18": "ec", "19": "ec", "20": "elgamal", "22": "ed25519", "25": "x25519", "26": "x448", "27": "ed25519", "28": "ed448"}
PGP_CURVES = {"1.2.840.10045.3.1.7": "p-256", "1.3.132.0.34": "p-384", "1.3.132.0.35": "p-521", "1.3.36.3.3.2.8.1.1.7": "brainpoolp256r1", "1.3.36.3.3.2.8.1.1.11": "brainpoolp384r1", "1.3.36.3.3.2.8.1.1.13": "brainpoolp512r1", "1.3.6.1.4.1.3029.1.5.1": "curve25519", "1.3.6.1.4.1.11591.15.1": "ed25519"}
# What SSH types of keys stand for, with a size or curve that follows from the type.
SSH_ALGORITHMS = {"ssh-rsa": "rsa", "ssh-dss": "dsa", "ssh-ed25519": "ed25519", "ssh-ed448": "ed448", "ecdsa-sha2-nistp256": "ec", "ecdsa-sha2-nistp384": "ec", "ecdsa-sha2-nistp521": "ec"}
SSH_SIZES = {"ssh-dss": "1024"}
SSH_CURVES = {"ecdsa-sha2-nistp256": "p-256", "ecdsa-sha2-nistp384": "p-384", "ecdsa-sha2-nistp521": "p-521"}
STORE_TYPES = {"FEEDFEED": "jks", "CECECECE": "jceks"}


def number(value: Column) -> Column:
    """Up to 15 bytes as an unsigned decimal number."""
    digits = F.hex(value)
    part = lambda at: F.conv(F.substring(F.lpad(digits, 30, "0"), at, 10), 16, 10).cast("decimal(38,0)")
    wide = lambda n: F.lit(str(1 << n)).cast("decimal(38,0)")
    return F.when(F.length(value) <= 15, part(1) * wide(80).cast("decimal(25,0)") + part(11) * wide(40).cast("decimal(13,0)") + part(21)).cast("decimal(38,0)")


def bits_of(value: Column) -> Column:
    """How many bits an unsigned number has, however long it is."""
    digits = F.regexp_replace(F.hex(value), "^0+", "")
    return F.greatest(F.lit(0), F.length(digits) * 4 - 4 + F.length(F.conv(F.substring(digits, 1, 1), 16, 2)))


def identifier(value: Column) -> Column:
    """An object identifier's bytes in dotted form."""
    each = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.conv(F.hex(F.substring(value, i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("text"))

    def step(acc: Column, b: Column) -> Column:
        n = F.shiftleft(acc["n"], 7) + b % 128
        first = F.least(F.floor(n / 40), F.lit(2)).cast("long")
        text = F.when(acc["text"] == "", F.concat(first.cast("string"), F.lit("."), (n - first * 40).cast("string"))).otherwise(F.concat(acc["text"], F.lit("."), n.cast("string")))
        return F.struct(F.when(b < 128, 0).otherwise(n).cast("long").alias("n"), F.when(b < 128, text).otherwise(acc["text"]).alias("text"))

    return F.when(F.length(value) > 0, F.aggregate(each, start, step)["text"])


def written(value: Column, tag: Column) -> Column:
    """A string element as text."""
    return F.when(tag == 0x1E, F.decode(value, "UTF-16BE")).otherwise(F.try_validate_utf8(value))


def moment(value: Column, tag: Column) -> Column:
    """A time element as ISO-8601 in UTC."""
    text = F.try_validate_utf8(value)
    whole = F.when(tag == 0x17, F.concat(F.when(F.substring(text, 1, 2) >= "50", "19").otherwise("20"), text)).otherwise(text)
    return F.nullif(F.regexp_replace(F.regexp_extract(whole, r"^([0-9]{14})", 1), "^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z"), F.lit(""))


def seconds(value: Column) -> Column:
    """Seconds since 1970 as ISO-8601 in UTC."""
    return F.date_format(F.timestamp_seconds(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def place(n: int) -> Column:
    return F.get("path", F.lit(n))


def tag(n: int) -> Column:
    return F.get("tags", F.lit(n))


def last_tag() -> Column:
    return F.element_at("tags", -1)


def mapped(table: dict, key: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup(table), key), key)


def long_form(df: DataFrame, facts: dict[str, Column]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()))
    return df.select("id", F.explode(each).alias("f")).select("id", "f.key", "f.value").filter("value is not null and value <> ''")


def extensions(rows: DataFrame, list_tag: int = 0xA3) -> DataFrame:
    """id, number, oid and items (path, tag, value, in order) of each extension; 0xA0 is the tag of those of revocation lists."""
    own = rows.filter((F.size("path") >= 6) & (tag(2) == list_tag) & (place(2) > 0))
    item = F.struct("path", last_tag().alias("tag"), "value")
    name = F.max(F.when((F.size("path") == 6) & (place(5) == 0) & (tag(5) == 6), F.col("value")))
    found = own.groupBy("id", place(4).alias("number")).agg(name.alias("name"), F.array_sort(F.collect_list(F.when(F.size("path") >= 7, item))).alias("items"))
    return found.select("id", "number", identifier(F.col("name")).alias("oid"), "items")


def address(value: Column) -> Column:
    """Four bytes with dots, sixteen as groups with colons."""
    at = lambda i, n: F.conv(F.hex(F.substring(value, i, n)), 16, 10)
    groups = [F.lower(F.conv(F.hex(F.substring(value, 2 * i + 1, 2)), 16, 16)) for i in range(8)]
    return F.when(F.length(value) == 4, F.concat_ws(".", *(at(i, 1) for i in range(1, 5)))).when(F.length(value) == 16, F.concat_ws(":", *groups)).otherwise(F.hex(value))


def extension_facts(found: DataFrame) -> DataFrame:
    """(id, key, value) of the extensions of certificates, one row for each kind."""
    items = F.col("items")
    of = lambda oid, value: F.when(F.col("oid") == oid, F.nullif(value, F.lit("")))
    depth = lambda x: F.size(x["path"])
    text = lambda x: F.try_validate_utf8(x["value"])
    joined = lambda keep, show: F.array_join(F.filter(F.transform(F.filter(items, keep), show), lambda s: s.isNotNull()), ",")
    bits = lambda v: F.lpad(F.conv(F.hex(F.substring(v, 2, 1)), 16, 2), 8, "0")
    second = lambda v: F.when(F.length(v) > 2, F.lpad(F.conv(F.hex(F.substring(v, 3, 1)), 16, 2), 8, "0")).otherwise("")
    usage = F.transform(F.filter(items, lambda x: x["tag"] == 3), lambda x: F.concat(bits(x["value"]), second(x["value"])))
    used = F.array_join(F.filter(F.array(*(F.when(F.substring(F.get(usage, F.lit(0)), n + 1, 1) == "1", u) for n, u in enumerate(USAGES))), lambda u: u.isNotNull()), ",")

    def alternative(x: Column) -> Column:
        out = F
        for t, label in NAMES.items():
            out = out.when(x["tag"] == t, F.concat(F.lit(label), address(x["value"]) if t == 0x87 else text(x)))
        for t, label in OTHERS.items():
            out = out.when(x["tag"] == t, F.lit(label))
        return out.otherwise(F.concat(F.lit("OTHER-"), (x["tag"] % 32).cast("string")))

    responders = F.transform(F.filter(items, lambda x: (x["tag"] == 6) & (F.hex(x["value"]) == "2B06010505073001")), lambda x: F.slice(x["path"], 1, 8))
    facts = {
        "IsCA": of("2.5.29.19", F.exists(items, lambda x: (x["tag"] == 1) & (F.hex(x["value"]) != "00")).cast("string")),
        "KeyUsage": of("2.5.29.15", used),
        "ExtendedKeyUsage": of("2.5.29.37", joined(lambda x: x["tag"] == 6, lambda x: mapped(EXTENDED, identifier(x["value"])))),
        "SAN": of("2.5.29.17", joined(lambda x: depth(x) == 8, alternative)),
        "OcspUrl": of("1.3.6.1.5.5.7.1.1", joined(lambda x: (x["tag"] == 0x86) & F.array_contains(responders, F.slice(x["path"], 1, 8)), text)),
        "CrlDistributionPoints": of("2.5.29.31", joined(lambda x: x["tag"] == 0x86, text)),
        "SubjectKeyIdentifier": of("2.5.29.14", F.lower(joined(lambda x: x["tag"] == 4, lambda x: F.hex(x["value"])))),
        "CertificatePolicies": of("2.5.29.32", joined(lambda x: (x["tag"] == 6) & (depth(x) == 9) & (F.element_at(x["path"], 9) == 0), lambda x: identifier(x["value"]))),
    }
    return long_form(found, facts).distinct()


def distinguished(rows: DataFrame) -> DataFrame:
    """id, field and name of each distinguished name in the rows of a certificate or list, most specific part first.

    ``field`` is the name's place among the signed fields.
    """
    own = rows.filter((F.size("path") == 6) & (tag(2) == 0x30) & (tag(3) == 0x31) & (tag(4) == 0x30))
    pair = own.groupBy("id", place(2).alias("field"), place(3).alias("part"), place(4).alias("n")).agg(
        F.max(F.when(place(5) == 0, F.col("value"))).alias("kind"), F.max(F.when(place(5) == 1, written(F.col("value"), last_tag()))).alias("text"))
    shown = F.concat(mapped(PARTS, identifier(F.col("kind"))), F.lit("="), F.regexp_replace("text", r'([,+"\\<>;])', r"\\$1"))
    ordered = F.sort_array(F.collect_list(F.struct("part", (-F.col("n")).alias("n"), shown.alias("s"))), asc=False)
    joined = F.aggregate("parts", F.lit(""), lambda a, p: F.concat(a, F.when(a == "", "").when(p["n"] < 0, "+").otherwise(","), p["s"]))
    # Parts of one set go by falling place from the first pair on, so all but the last begin with a plus.
    return pair.groupBy("id", "field").agg(ordered.alias("parts")).select("id", "field", joined.alias("name"))


def revocation_facts(rows: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """(id, key, value) of revocation lists: names, times, number, and the first ``MOST`` serial numbers with the full count.

    ``contents`` (id, content), if given, adds the lists' digests.
    """
    signed = (F.size("path") >= 3) & (place(0) == 0) & (place(1) == 0)
    at = lambda condition, value: F.max(F.when(condition, value))
    listed = (F.size("path") == 5) & (tag(3) == 0x30) & (tag(4) == 2) & (place(4) == 0)
    times = F.array_sort(F.collect_list(F.when(signed & (F.size("path") == 3) & last_tag().isin(0x17, 0x18), F.struct(place(2).alias("n"), moment(F.col("value"), last_tag()).alias("t")))))
    serial = F.nullif(F.lower(F.regexp_replace(F.hex("value"), "^0+(?=.)", "")), F.lit(""))
    some = rows.groupBy("id").agg(
        F.count(F.when(signed & listed, 1)).alias("revoked"), times.alias("times"), F.max(F.when(signed & listed, place(2))).alias("list"),
        F.array_sort(F.collect_list(F.when(signed & listed & (place(3) < MOST), F.struct(place(3).alias("n"), serial.alias("s"))))).alias("serials"),
        at((F.size("path") == 3) & (place(1) == 1) & (place(2) == 0) & (tag(2) == 6), F.col("value")).alias("algorithm"),
    ).filter(F.size("times") > 0)
    issuers = distinguished(rows).groupBy("id").agg(F.min_by("name", "field").alias("issuer"))
    numbers = extensions(rows, 0xA0).filter("oid = '2.5.29.20'").groupBy("id").agg(F.max(F.get("items", F.lit(0))["value"]).alias("number"))
    known = some.join(issuers, "id", "left").join(numbers, "id", "left")
    if contents is not None:
        known = known.join(contents.select("id", F.sha2("content", 256).alias("digest")), "id", "left")
    from ..functions.tokens import OIDS

    name = identifier(F.col("algorithm"))
    return long_form(known, {
        "IssuerDN": F.col("issuer"), "ThisUpdate": F.get("times", F.lit(0))["t"], "NextUpdate": F.get("times", F.lit(1))["t"],
        "SigAlgorithm": F.coalesce(F.try_element_at(lookup(OIDS), name), F.concat(F.lit("<unknown-sig-oid-"), name, F.lit(">"))),
        "CrlSha256": F.col("digest") if contents is not None else F.lit(None), "CrlNumber": number(F.col("number")), "RevokedCount": F.col("revoked"),
        "RevokedSerials": F.array_join(F.transform("serials", lambda s: s["s"]), ","), "RevokedTruncated": F.when(F.col("revoked") > MOST, "true"),
    })


def ssh_certificate_facts(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, key, value) of certificates in OpenSSH's wire format; ``contents`` (id, content) gives their digest."""
    one = lambda n: F.max(F.when((F.size("path") == 1) & (place(0) == n), F.col("value")))
    many = lambda n, keep: F.array_sort(F.collect_list(F.when((F.size("path") == 2) & (place(0) == n) & keep, F.struct(place(1).alias("n"), F.col("value").alias("v")))))
    even = place(1) % 2 == 0
    own = rows.groupBy("id").agg(
        one(0).alias("kind"), one(3).alias("serial"), one(4).alias("use"), one(5).alias("key_id"), one(7).alias("after"), one(8).alias("before"), one(12).alias("authority"),
        many(2, F.lit(True)).alias("key"), many(6, F.lit(True)).alias("principals"), many(9, even).alias("options"), many(10, even).alias("extensions"), many(13, place(1) == 0).alias("signature"),
        F.max(F.when(last_tag() == BROKEN, 1)).alias("broken"),
    ).filter("broken is null and authority is not null and size(signature) > 0").join(contents.select("id", F.sha2("content", 256).alias("digest")), "id")
    signed = F.regexp_replace(F.decode("kind", "UTF-8"), "-cert-v01@openssh.com$", "")
    wire = lambda b: F.concat(F.unhex(F.lpad(F.hex(F.length(b)), 8, "0")), b)
    blob = F.aggregate("key", wire(F.encode(signed, "UTF-8")), lambda a, f: F.concat(a, wire(f["v"])))
    printed = lambda b: F.concat(F.lit("SHA-256:"), F.regexp_replace(F.base64(F.unhex(F.sha2(b, 256))), "[=\\s]+", ""))
    texts = lambda c: F.array_join(F.transform(c, lambda x: F.try_validate_utf8(x["v"])), ",")
    unsigned = lambda c: number(F.col(c))
    use = unsigned("use").cast("long")
    limit = lambda c, word: F.when(F.hex(c).isin("0" * 16, "F" * 16), word).otherwise(seconds(unsigned(c).cast("long")))
    size = F.coalesce(F.when(signed == "ssh-rsa", bits_of(F.get("key", F.lit(1))["v"])).cast("string"), F.try_element_at(lookup(SSH_SIZES), signed))
    return long_form(own, {
        "KeyAlgorithm": F.try_element_at(lookup(SSH_ALGORITHMS), signed), "KeySize": size, "Curve": F.try_element_at(lookup(SSH_CURVES), signed),
        "SshFingerprintSha256": printed(blob), "SshCertSha256": F.col("digest"), "SshCertType": F.when(use == 1, "user").when(use == 2, "host").otherwise(F.concat(F.lit("unknown-"), use.cast("string"))),
        "SshCertSerial": unsigned("serial"), "SshCertKeyId": F.try_validate_utf8("key_id"), "SshCertPrincipals": texts("principals"), "SshCertValidAfter": limit("after", "always"), "SshCertValidBefore": limit("before", "forever"),
        "SshCertCriticalOptions": texts("options"), "SshCertExtensions": texts("extensions"), "SshCertCaFingerprint": printed(F.col("authority")), "SshCertSigAlgorithm": F.try_validate_utf8(F.get("signature", F.lit(0))["v"]),
    })


def key_ring_facts(rows: DataFrame) -> DataFrame:
    """(id, key, value) of OpenPGP keys, by the first eight digits of their fingerprints.

    User names and signatures belong to the key before them: a running maximum over the packets of one ring.
    """
    from pyspark.sql import Window

    kind = tag(0)
    key = (F.size("path") == 1) & kind.isin(5, 6, 7, 14)
    wanted = rows.filter(key | ((F.size("path") == 1) & (kind == 13)) | ((F.size("path") == 2) & tag(1).isin(SUBPACKET + 9)))
    before = Window.partitionBy("id").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = wanted.withColumn("owner", F.max(F.when(key, place(0))).over(before)).filter("owner is not null")
    names = F.array_sort(F.collect_list(F.when((F.size("path") == 1) & (kind == 13), F.struct(place(0).alias("n"), F.try_validate_utf8("value").alias("t")))))
    own = placed.groupBy("id", "owner").agg(F.max(F.when(key, F.struct(kind.alias("tag"), F.col("value").alias("body")))).alias("k"), names.alias("names"), F.max(F.when(F.size("path") == 2, number(F.col("value")).cast("long"))).alias("valid"))
    body = F.col("k.body")
    byte = lambda at, n=1: F.substring(body, at, n)
    whole = lambda at, n=1: F.conv(F.hex(byte(at, n)), 16, 10).cast("long")
    version = whole(1)
    start = F.when(version == 6, 11).when(version == 4, 7).otherwise(9)
    sized = lambda mark, digits: F.concat(F.unhex(F.lit(mark)), F.unhex(F.lpad(F.hex(F.length(body)), digits, "0")), body)
    print_ = F.when(version == 4, F.sha1(sized("99", 4))).when(version == 6, F.sha2(sized("9B", 8), 256))
    code = F.when(version.isin(4, 6), whole(6)).otherwise(whole(8))
    name = F.coalesce(F.try_element_at(lookup(PGP_ALGORITHMS), code.cast("string")), F.lit("unknown"))
    at = lambda i, n: F.conv(F.hex(body.substr(i, F.lit(n))), 16, 10).cast("int")
    size = F.when(name.isin("rsa", "dsa", "elgamal"), at(start, 2))
    curve = F.when(code.isin(18, 19, 22), mapped(PGP_CURVES, identifier(body.substr(start + 1, at(start, 1)))))
    created = whole(2, 4)
    own = own.withColumns({"fingerprint": print_, "version": version, "algorithm": name, "size": size, "curve": curve, "created": created}).filter("fingerprint is not null")
    facts = {
        "Fingerprint": F.col("fingerprint"), "Version": F.col("version"), "KeyAlgorithm": F.col("algorithm"), "KeySize": F.when(F.col("size") > 0, F.col("size")), "Curve": F.col("curve"),
        "IsPrimary": F.col("k.tag").isin(5, 6), "CreationTime": seconds(F.col("created")), "ExpirationTime": F.when(F.col("valid") > 0, seconds(F.col("created") + F.col("valid"))),
        "UserIds": F.when(F.col("k.tag").isin(5, 6), F.array_join(F.transform("names", lambda n: n["t"]), ",")),
    }
    each = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()))
    long = own.select("id", "fingerprint", F.explode(each).alias("f")).filter("f.value is not null and f.value <> ''")
    prefixed = long.select("id", F.concat(F.lit("Key:"), F.substring("fingerprint", 1, 8), F.lit(":"), "f.key").alias("key"), "f.value")
    return prefixed.unionByName(own.groupBy("id").agg(F.count("*").cast("string").alias("value")).select("id", F.lit("PgpKeyCount").alias("key"), "value"))


def store_certificates(rows: DataFrame) -> DataFrame:
    """id, prefix, chain, and content of each certificate in key stores; ``prefix`` names its entry, ``chain`` its place if it is a key's."""
    alias = rows.filter((F.size("path") == 1) & tag(0).isin(KEY, CERTIFICATE)).select("id", place(0).alias("entry"), tag(0).alias("kind"), F.url_encode(F.try_validate_utf8("value")).alias("alias"))
    own = rows.filter((F.size("path") == 2) & (last_tag() == CHAIN)).select("id", place(0).alias("entry"), place(1).alias("n"), F.col("value").alias("content"))
    return own.join(alias, ["id", "entry"]).select("id", F.concat(F.lit("Entry:"), "alias", F.lit(":")).alias("prefix"), F.when(F.col("kind") == KEY, F.col("n")).alias("chain"), "content")


def store_facts(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, key, value) of key stores: type, counts and what the certificates in them tell.

    A store that cannot be read to its end without a password is marked encrypted, and tells no more.
    """
    whole = contents.select("id", F.hex(F.substring("content", 1, 4)).alias("magic"), F.conv(F.hex(F.substring("content", 9, 4)), 16, 10).alias("n"))
    entry = F.size("path") == 1
    own = rows.groupBy("id").agg(F.count(F.when(entry & tag(0).isin(KEY, CERTIFICATE), 1)).alias("entries"), F.count(F.when(entry & (tag(0) == KEY), 1)).alias("keys"), F.count(F.when(last_tag() == CHAIN, 1)).alias("certificates"), F.max(F.when(last_tag() == BROKEN, 1)).alias("broken"))
    known = whole.join(own, "id", "left").withColumn("readable", F.col("magic").isin(*STORE_TYPES) & F.col("broken").isNull() & (F.coalesce("entries", F.lit(0)) == F.col("n")))
    counted = lambda c: F.when(F.col("readable"), F.coalesce(c, F.lit(0)))
    facts = long_form(known, {"KeystoreType": F.coalesce(F.try_element_at(lookup(STORE_TYPES), F.col("magic")), F.lit("pkcs12")), "KeystoreEncrypted": F.when(~F.col("readable"), "true"), "EntryCount": counted("entries"), "KeyEntryCount": counted("keys"), "CertCount": counted("certificates")})
    held = store_certificates(rows).join(known.filter("readable").select("id"), "id", "left_semi")
    described = held.select("id", "chain", F.concat("prefix", F.when(F.col("chain").isNotNull(), F.concat(F.lit("Chain:"), "chain", F.lit(":"))).otherwise("")).alias("at"), "prefix", certificate_facts("content").alias("c")).filter("c.subject is not null")
    each = F.array(*(F.struct(F.concat("at", F.lit(k)).alias("key"), F.col(f"c.{v}").cast("string").alias("value")) for k, v in CERTIFICATE_FACTS.items()))
    head = F.when(F.col("chain") == 0, F.array(*(F.struct(F.concat("prefix", F.lit(k)).alias("key"), F.col(f"c.{v}").cast("string").alias("value")) for k, v in (("KeyAlgorithm", "key_algorithm"), ("KeySize", "key_size"), ("Curve", "curve")))))
    long = described.select("id", F.explode(F.concat(each, F.coalesce(head, F.array().cast("array<struct<key:string,value:string>>")))).alias("f")).select("id", "f.key", "f.value").filter("value is not null")
    return facts.unionByName(long)


#: Facts of a certificate and the fields of ``certificate_facts``.
CERTIFICATE_FACTS = {"SubjectDN": "subject", "IssuerDN": "issuer", "Serial": "serial", "NotBefore": "not_before", "NotAfter": "not_after", "KeyAlgorithm": "key_algorithm", "SigAlgorithm": "sig_algorithm", "SpkiSha256": "spki_sha256", "CertSha256": "cert_sha256", "SelfSigned": "self_signed", "Version": "version", "KeySize": "key_size", "Curve": "curve"}


def _numbered(df: DataFrame, parts: Column) -> DataFrame:
    """id, n, total and content of the parts of each row."""
    return df.withColumn("parts", parts).select("id", F.size("parts").alias("total"), F.posexplode("parts").alias("n", "content"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.concat("id", F.lit("#"), F.col("n").cast("string")).alias("id"), "content")


def _unkeyed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("id", F.regexp_replace("id", "#[0-9]+$", ""))


def bodies(text: Column, label: str) -> Column:
    """The bytes of a text's PEM blocks of one label."""
    found = F.regexp_extract_all(text, F.lit(f"-----BEGIN {label}-----([A-Za-z0-9+/=\\s]+)-----END {label}-----"), 1)
    return F.filter(F.transform(found, lambda b: F.try_to_binary(F.regexp_replace(b, r"\s+", ""), F.lit("base64"))), lambda b: b.isNotNull())


def certificate_rows(certificates: DataFrame) -> DataFrame:
    """(id, key, value) of certificates (id, n, total, content); those of a bundle are numbered."""
    from ..sources.records import records

    keyed = certificates.withColumn("part", F.concat("id", F.lit("#"), F.col("n").cast("string")))
    prefix = F.when(F.col("total") > 1, F.concat(F.lit("Cert:"), "n", F.lit(":"))).otherwise("")
    named = keyed.select("id", "part", prefix.alias("prefix"), certificate_facts("content").alias("c")).filter("c.subject is not null")
    base = long_form(named.select(F.col("part").alias("id"), "c"), {k: F.col(f"c.{v}") for k, v in CERTIFICATE_FACTS.items()})
    more = extension_facts(extensions(records(keyed.select(F.col("part").alias("id"), "content"), "der")))
    both = base.unionByName(more).withColumnRenamed("id", "part")
    counted = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").withColumn("n", F.col("n").cast("string"))
    whole = [("KeystoreType", F.lit("pem-bundle")), ("EntryCount", F.col("n")), ("CertCount", F.col("n")), ("KeyEntryCount", F.lit("0"))]
    bundle = counted.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in whole))).alias("f")).select("id", "f.key", "f.value")
    return both.join(named.select("id", "part", "prefix"), "part").select("id", F.concat("prefix", "key").alias("key"), "value").unionByName(bundle)


def material_rows(texts: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, key, value) of all but certificates alone: lists, rings, SSH certificates and stores.

    texts: id and text.  contents: id, path and content of what is no text.
    """
    from ..sources.records import CERTIFIED, records

    name = F.lower("path")
    armored = texts.filter(F.col("text").contains("-----BEGIN PGP PUBLIC KEY BLOCK-----"))
    rings = armored.select("id", F.encode("text", "UTF-8").alias("content")).unionByName(contents.filter(name.rlike(r"\.(pgp|gpg|asc)$")).select("id", "content"))
    lists = _keyed(_numbered(texts.filter(F.col("text").contains("-----BEGIN X509 CRL-----")), bodies(F.col("text"), "X509 CRL"))).unionByName(contents.filter(name.endswith(".crl")).select("id", "content"))
    certified = F.regexp_extract_all("text", F.lit(r"(?m)^[a-z0-9-]+" + CERTIFIED.replace(".", r"\.") + r" (AAAA[A-Za-z0-9+/=]+)"), 1)
    decoded = F.filter(F.transform(certified, lambda b: F.try_to_binary(b, F.lit("base64"))), lambda b: b.isNotNull())
    ssh = _keyed(_numbered(texts.filter(F.col("text").contains(CERTIFIED)), decoded))
    stores = contents.filter(F.hex(F.substring("content", 1, 4)).isin(*STORE_TYPES) | name.rlike(r"\.(p12|pfx)$")).select("id", "content")
    found = [revocation_facts(records(lists, "der"), lists), key_ring_facts(records(rings, "pgp")), ssh_certificate_facts(records(ssh, "ssh"), ssh), store_facts(records(stores, "store"), stores)]
    whole = _unkeyed(found[0])
    for more in (found[1], _unkeyed(found[2]), found[3]):
        whole = whole.unionByName(more)
    return whole
