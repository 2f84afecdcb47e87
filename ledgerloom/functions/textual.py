"""Dates, properties, lockfiles and service files, line by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats, in the order in which they are tried.
DATES = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy", "d MMM, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d MMMM, yyyy")
BUILD_DATES = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "yyyyMMdd-HHmm")


def date(text: Column) -> Column:
    """the first format that fits, months before days; relative words count from the current time."""
    own = F.trim(text)
    tried = F.coalesce(*(F.try_to_timestamp(own, F.lit(f)) for f in DATES))
    now = F.when(F.lower(own).isin("now", "today"), F.current_timestamp()).when(F.lower(own) == "yesterday", F.current_timestamp() - F.expr("INTERVAL 1 DAY"))
    return F.coalesce(now, tried)


def build_date(text: Column) -> Column:
    """digits are milliseconds, else the first format that fits."""
    own = F.trim(text)
    return F.when(own.rlike("^[0-9]+$"), F.timestamp_millis(own.try_cast("long"))).otherwise(F.coalesce(*(F.try_to_timestamp(own, F.lit(f)) for f in BUILD_DATES)))


def lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))


def properties(text: Column) -> Column:
    """key and value of each ``key=value`` line that is no comment, keys in lower case; the last of a key counts."""
    kept = F.filter(lines(text), lambda x: x.contains("=") & ~x.startswith("#"))
    pair = F.transform(kept, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    # Building the map from the last entry of each key: fold the entries in order.
    empty = F.create_map().cast("map<string,string>")
    put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"]))
    return F.aggregate(pair, empty, put)


def requirement(line: Column) -> Column:
    """name and version of a requirements line; operators are tried in a fixed order."""
    own = F.trim(line)
    out = F
    for op in ("==", ">=", "<=", "~=", "!="):
        at = F.instr(own, op)
        out = out.when(at > 0, F.struct(F.trim(F.substring(own, F.lit(1), at - 1)).alias("name"), F.trim(F.substring(own, at + 2, F.length(own))).alias("version")))
    out = out.otherwise(F.struct(own.alias("name"), F.lit("").alias("version")))
    return F.when((own != "") & ~own.startswith("#") & ~own.startswith("-") & (out["name"] != ""), out)


def gradle_dependency(line: Column) -> Column:
    """group, artifact, version and configurations of a lockfile line; null for other lines."""
    own = F.trim(line)
    part = lambda i: F.regexp_extract(own, r"^([^:=#]+):([^:=]+):([^:=]+)(?:=(.*))?$", i)
    return F.when(part(3) != "", F.struct(part(1).alias("group_id"), part(2).alias("artifact_id"), part(3).alias("version"), F.filter(F.split(part(4), ","), lambda c: c != "").alias("configurations")))


def checksum_line(line: Column) -> Column:
    """module and version, the first two words of a line with two or more."""
    words = F.split(F.trim(line), r"\s+")
    return F.when(F.size(words) >= 2, F.struct(F.element_at(words, 1).alias("name"), F.element_at(words, 2).alias("version")))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), '^"(.*)"$', "$1")


def vendor(implementor: Column, path: Column) -> Column:
    """vendor and product of a Java runtime."""
    own, where = F.lower(F.coalesce(implementor, F.lit(""))), F.lower(path)
    pick = lambda v, p: F.struct(F.lit(v).alias("vendor"), F.lit(p).alias("product"))
    return (
        F.when(own.contains("azul") | where.contains("zulu"), pick("azul", "zulu"))
        .when(own.rlike("eclipse|adoptium|temurin"), pick("eclipse", "temurin"))
        .when(own.rlike("amazon|corretto"), pick("amazon", "corretto"))
        .when(own.contains("oracle"), pick("oracle", "jdk"))
        .when(own.contains("ibm"), pick("ibm", "jdk"))
        .when(own.contains("microsoft"), pick("microsoft", "jdk"))
        .otherwise(pick("openjdk", "jdk"))
    )


def bundle_header(text: Column) -> Column:
    """a module header as maps: clauses at commas, parts at semicolons, values behind the first equals sign."""
    def clause(c: Column) -> Column:
        parts = F.transform(F.split(c, ";"), lambda p: F.trim(p))
        named = F.filter(F.slice(parts, 2, 1000), lambda p: p.contains("="))
        return F.struct(F.element_at(parts, 1).alias("name"), F.transform(named, lambda p: F.concat_ws("=", F.trim(F.regexp_replace(F.substring_index(p, "=", 1), ":$", "")), unquoted(F.regexp_replace(p, "^[^=]*=", "")))).alias("attributes"))
    return F.transform(F.split(text, ","), clause)


def keystore_type(name: Column) -> Column:
    """the type that a key store's file name tells."""
    own = F.lower(F.substring_index(name, "/", -1))
    return (
        F.when(own.isin("cacerts", "jssecacerts", "keystore") | own.endswith(".jks"), "application/x-java-keystore")
        .when(own.endswith(".jceks"), "application/x-java-jce-keystore").when(own.endswith(".bks"), "application/x-bks-keystore")
        .when(own.rlike(r"\.(p12|pfx)$"), "application/x-pkcs12").when(own.endswith(".kbx"), "application/x-gnupg-keybox")
    )


def is_binary(text: Column) -> Column:
    """More than a tenth of the characters are control characters other than white space."""
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f]", ""))
    return (F.length(text) > 0) & (controls / F.length(text) > 0.1)


def _pairs(text: Column, pattern: str) -> Column:
    """Name and version of every match of a pattern with two groups."""
    names, versions = (F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2))
    return F.zip_with(names, versions, lambda n, v: F.struct(n.alias("name"), v.alias("version")))


def cargo_lock(text: Column) -> Column:
    """packages of a Cargo lockfile that have a name and a version."""
    return _pairs(text, r'\[\[package\]\]\s+name = "([^"]*)"\s+version = "([^"]*)"')


def yarn_lock(text: Column) -> Column:
    """entries of a yarn or pnpm lockfile: the name without its range, and the version below it."""
    return _pairs(text, r'(?m)^\s{0,2}"?(@?[^"@:\s]+)(?:@[^:\n]*)?"?\s*:\s*\n\s+version:? "?([^"\s]+)"?')


def npm_lock(text: Column) -> Column:
    """packages of an npm lockfile: those of ``dependencies``, then those of ``packages`` by their first path part."""
    own = F.from_json(text, "struct<dependencies:map<string,struct<version:string>>,packages:map<string,struct<version:string>>>")
    pairs = lambda m, name: F.transform(F.coalesce(F.map_entries(m), F.array()), lambda e: F.struct(name(e["key"]).alias("name"), e["value"]["version"].alias("version")))
    first = lambda k: F.element_at(F.split(F.regexp_replace(k, "^node_modules/", ""), "/"), 1)
    both = F.concat(pairs(own["dependencies"], lambda k: k), pairs(own["packages"], first))
    return F.filter(both, lambda p: p["version"].isNotNull())
