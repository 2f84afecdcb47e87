"""What the manifests of language and operating-system packages tell, about the package that holds them.

A manifest is one file in an archive.  Its facts belong to the archive, one or two containers up, or to the
file itself where it lies in none.  Every ecosystem is one row of expressions, evaluated in one pass
over the manifests; RPM headers are rows of ``sources.records``.

Defined results: a manifest without a name tells nothing; a missing version leaves the package URL without one;
of several manifests in one package each tells its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packages
from .keymaterial import number, place, tag

# Tags of RPM headers.
RPM = {1000: "name", 1001: "version", 1002: "release", 1003: "epoch", 1004: "summary", 1005: "description", 1006: "built", 1009: "size", 1011: "vendor", 1014: "license", 1015: "packager", 1016: "group", 1020: "url", 1022: "arch"}
FIELDS = ("name", "version", "description", "license", "publisher", "arch", "maintainer", "size", "url", "release", "epoch", "group", "summary")


def _json(path: str) -> Column:
    return F.get_json_object("text", path)


def _first(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def _listed(path: str) -> Column:
    """A JSON string, or a list of them joined by commas."""
    value = _json(path)
    return F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(value)


def _line(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))


def _header(name: str) -> Column:
    """A header of the form ``Name: value``."""
    return _line(rf"(?im)^{name}:[ \t]*(.+?)\s*$")


def _setting(name: str) -> Column:
    """A setting of the form ``name = value``, quoted or not."""
    return _line(rf"(?m)^\s*{name}\s*=\s*[\"']?([^\"'\r\n]+?)[\"']?\s*$")


def _package(name: str) -> Column:
    """A setting of a TOML file's package section."""
    return F.nullif(F.regexp_extract("text", rf"(?ms)^\[package\]\s*$(?:(?!^\[).)*?^\s*{name}\s*=\s*\[?\s*\"([^\"]*)\"", 1), F.lit(""))


def _term(name: str) -> Column:
    return _line(rf'(?s)<<"{name}"(?:/utf8)?>>\s*,\s*(?:\[\s*)?<<"([^"]*)"')


def _gem(name: str) -> Column:
    return _line(rf"(?m)^{name}:[ \t]+[\"']?([^\"'\r\n]+?)[\"']?\s*$")


def _language() -> list[tuple]:
    """name, type of package URL, path, containers up, and columns of each ecosystem."""
    module = _line(r"(?m)^module\s+(\S+)")
    return [
        ("Npm", "npm", r"(^|/)package\.json$", 1, {"name": _json("$.name"), "version": _json("$.version"), "description": _json("$.description"), "license": F.coalesce(_json("$.license.type"), _json("$.license")), "publisher": F.coalesce(_json("$.author.name"), _json("$.author"))}),
        ("PyPi", "pypi", r"(^|/)PKG-INFO$|\.dist-info/METADATA$", 1, {"name": _header("Name"), "version": _header("Version"), "description": _header("Summary"), "license": _header("License"), "publisher": _header("Author")}),
        ("Crates", "cargo", r"(^|/)Cargo\.toml$", 1, {"name": _package("name"), "version": _package("version"), "description": _package("description"), "license": _package("license"), "publisher": _package("authors")}),
        ("Go", "golang", r"(^|/)go\.mod$", 1, {"name": module, "version": F.nullif(F.regexp_extract("path", r"@(v[^/]+)/", 1), F.lit(""))}),
        ("Packagist", "composer", r"(^|/)composer\.json$", 1, {"name": _json("$.name"), "version": _json("$.version"), "description": _json("$.description"), "license": _listed("$.license"), "publisher": _json("$.authors[0].name")}),
        ("Cpan", "cpan", r"(^|/)META\.json$", 1, {"name": _json("$.name"), "version": _json("$.version"), "description": _json("$.abstract"), "license": _listed("$.license"), "publisher": _json("$.author[0]")}),
        ("Conda", "conda", r"(^|/)info/index\.json$", 1, {"name": _json("$.name"), "version": _json("$.version"), "license": _json("$.license")}),
        ("Hex", "hex", r"(^|/)metadata\.config$", 1, {"name": _term("name"), "version": _term("version"), "description": _term("description"), "license": _term("licenses")}),
        ("CocoaPods", "cocoapods", r"\.podspec\.json$", 1, {"name": _json("$.name"), "version": _json("$.version"), "description": _json("$.summary"), "license": F.coalesce(_json("$.license.type"), _json("$.license"))}),
        ("LuaRocks", "luarocks", r"\.rockspec$", 1, {"name": _setting("package"), "version": _setting("version"), "description": _line(r"summary\s*=\s*[\"']([^\"']+)"), "license": _line(r"license\s*=\s*[\"']([^\"']+)")}),
        ("RubyGems", "gem", r"(^|/)metadata\.gz$", 2, {"name": _gem("name"), "version": _line(r"(?m)^version:.*\r?\n\s+version:\s*[\"']?([^\"'\s]+)"), "description": _gem("summary"), "license": _line(r"(?m)^licenses:\s*\r?\n\s*-\s*[\"']?([^\"'\r\n]+)"), "publisher": _line(r"(?m)^authors:\s*\r?\n\s*-\s*[\"']?([^\"'\r\n]+)")}),
    ]


def _system() -> list[tuple]:
    info = {"name": _setting("pkgname"), "version": _setting("pkgver"), "description": _setting("pkgdesc"), "license": _setting("license"), "publisher": _setting("origin"), "arch": _setting("arch"), "maintainer": F.coalesce(_setting("packager"), _setting("maintainer")), "size": _setting("size"), "url": _setting("url")}
    return [
        ("deb", "deb/debian", r"(^|/)control$", 2, {"name": _header("Package"), "version": _header("Version"), "description": _header("Description"), "arch": _header("Architecture"), "maintainer": _header("Maintainer"), "size": _header("Installed-Size"), "url": _header("Homepage")}),
        ("apk", "apk/alpine", r"(^|/)\.PKGINFO$", 1, info),
        ("alpm", "alpm/arch", r"(^|/)\.PKGINFO$", 1, info),
        ("freebsd", "generic/freebsd", r"(^|/)\+(COMPACT_)?MANIFEST$", 1, {"name": _json("$.name"), "version": _json("$.version"), "description": _json("$.comment"), "license": _listed("$.licenses"), "arch": _json("$.arch"), "maintainer": _json("$.maintainer"), "size": _json("$.flatsize"), "url": _json("$.www")}),
    ]


def is_language_manifest(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for _, _, p, _, _ in _language()))


def is_system_manifest(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{p})" for _, _, p, _, _ in _system()))


def _told(files: DataFrame, kinds: list[tuple]) -> DataFrame:
    """id, ecosystem, type, up and fields of the manifests among files (id, path, text)."""
    all_ = FIELDS[:9]
    one = lambda name, type_, up, own: F.struct(F.lit(name).alias("ecosystem"), F.lit(type_).alias("type"), F.lit(up).alias("up"), *(_first(own[f]).alias(f) if f in own else F.lit(None).cast("string").alias(f) for f in all_))
    found = F.array(*(F.when(F.col("path").rlike(pattern), one(name, type_, up, own)) for name, type_, pattern, up, own in kinds))
    return files.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m")).select("id", "m.*").filter("name is not null")


def held_by(found: DataFrame, places: DataFrame) -> DataFrame:
    """``found`` with the id of the package in the place of the manifest's: ``places`` (scope, path, id) tells what holds what."""
    up = places.filter("scope <> ''").select("id", F.col("scope").alias("holder")).distinct()
    two = up.join(up.select(F.col("id").alias("holder"), F.col("holder").alias("above")), "holder", "left").select("id", "holder", "above").distinct()
    own = found.join(two, "id", "left")
    return own.withColumn("id", F.coalesce(F.when(F.col("up") == 2, F.col("above")), "holder", "id")).drop("holder", "above", "up").distinct()


def rpm_rows(rows: DataFrame) -> DataFrame:
    """The same fields from the rows of RPM headers."""
    text = lambda t: F.max(F.when(tag(0) == t, F.try_validate_utf8("value")))
    whole = lambda t: F.max(F.when(tag(0) == t, number(F.col("value")))).cast("string")
    own = rows.filter((F.size("path") == 1) & (place(0) >= 0)).groupBy("id").agg(*((whole(t) if name in ("epoch", "size", "built") else text(t)).alias(name) for t, name in RPM.items()))
    return own.filter("name is not null").select("id", F.lit("rpm").alias("ecosystem"), F.lit("rpm").alias("type"), "name", "version", "description", "license", F.col("vendor").alias("publisher"), "arch", F.col("packager").alias("maintainer"), "size", "url", "release", "epoch", "group", "summary")


def facts(found: DataFrame, language: bool) -> tuple[DataFrame, DataFrame]:
    """Metadata (id, key, value) and package URLs (id, purl) of packages."""
    found = found.select("id", "ecosystem", "type", *(F.col(f) if f in found.columns else F.lit(None).cast("string").alias(f) for f in FIELDS))
    named = {"Name": "name", "Version": "version", "Description": "description", "License": "license", "Publisher": "publisher"}
    named |= {"Annatto:Ecosystem": "ecosystem"} if language else {"Url": "url", "Baharat:Arch": "arch", "Baharat:Maintainer": "maintainer", "Baharat:Installed_size": "size", "Baharat:Release": "release", "Baharat:Epoch": "epoch", "Baharat:Group": "group", "Baharat:Summary": "summary"}
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in named.items()))
    long = found.select("id", F.explode(each).alias("f")).select("id", "f.key", "f.value").filter("value is not null")
    # A name's path is the namespace; names of Python packages have one spelling.
    name = F.when(F.col("type") == "pypi", F.regexp_replace(F.lower("name"), "[-_.]+", "-")).otherwise(F.col("name"))
    path = F.array_join(F.transform(F.split(name, "/"), packages.percent_encoded), "/")
    version = F.concat("version", F.coalesce(F.concat(F.lit("-"), "release"), F.lit("")))
    query = F.array_join(F.filter(F.array(F.concat(F.lit("arch="), "arch"), F.concat(F.lit("epoch="), "epoch")), lambda q: q.isNotNull()), "&")
    purl = F.concat(F.lit("pkg:"), "type", F.lit("/"), path, F.coalesce(F.concat(F.lit("@"), packages.percent_encoded(version)), F.lit("")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return long, found.select("id", purl.alias("purl"))


def language_packages(files: DataFrame) -> DataFrame:
    """Manifests of eleven language ecosystems among files (id, path, text)."""
    return _told(files, _language())


def system_packages(files: DataFrame, places: DataFrame) -> DataFrame:
    """Manifests of Debian, Alpine, Arch and FreeBSD packages; what holds a ``.PKGINFO`` tells Alpine's from Arch's."""
    told = _told(files, _system())
    alpine = places.filter(F.lower("path").endswith(".apk")).select(F.col("id").alias("scope")).distinct().join(places.select("scope", "id"), "scope").select("id", F.lit(True).alias("alpine")).distinct()
    both = told.join(alpine, "id", "left")
    return both.filter((F.col("ecosystem") != "apk") | F.col("alpine")).filter((F.col("ecosystem") != "alpm") | F.col("alpine").isNull()).drop("alpine")
