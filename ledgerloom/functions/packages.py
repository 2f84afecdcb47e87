"""Package coordinates: sanitizers, package URLs, names and versions from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of Java archives.
ARCHIVES = ("jar", "war", "ear", "par", "sar", "nar", "jpi", "hpi", "kar", "far", "lpkg", "rar", "zap")


def sanitized(text: Column, illegal: str = r"[^A-Za-z0-9_\-.]") -> Column:
    """trimmed, legal characters only, runs of dots as one, no dots at the ends; null if nothing is left."""
    own = F.regexp_replace(F.trim(text), illegal, "")
    own = F.regexp_replace(F.regexp_replace(own, r"\.{2,}", "."), r"^\.+|\.+$", "")
    return F.nullif(own, F.lit(""))


def maven_id(text: Column) -> Column:
    """F08 for group and artifact ids: path separators count as dots."""
    return sanitized(F.translate(text, "/", "."))


def percent_encoded(text: Column) -> Column:
    """Percent-encoding as in package URLs: a space is %20, and the colon stays."""
    own = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%3A", ":"), ("%7E", "~")):
        own = F.replace(own, F.lit(coded), F.lit(plain))
    return F.replace(own, F.lit("*"), F.lit("%2A"))


def purl(kind: str, name: Column, version: Column, namespace: Column | None = None, qualifiers: Column | None = None) -> Column:
    """``pkg:kind/namespace/name@version?qualifiers``; a null part leaves out its separator too."""
    part = lambda before, c: F.coalesce(F.concat(F.lit(before), c), F.lit(""))
    out = [F.lit(f"pkg:{kind}/")]
    if namespace is not None:
        out.append(F.coalesce(F.concat(percent_encoded(namespace), F.lit("/")), F.lit("")))
    out += [percent_encoded(name), part("@", percent_encoded(version))]
    if qualifiers is not None:
        out.append(part("?", qualifiers))
    return F.concat(*out)


def classifier_qualifier(classifier: Column) -> Column:
    """the qualifier of a companion file."""
    return F.when(classifier == "pom", "type=pom").when(classifier == "sources", "packaging=sources").when(classifier == "javadoc", "classifier=javadoc")


def stem(file_name: Column) -> Column:
    """A name without its last extension; a leading dot starts none."""
    return F.regexp_replace(file_name, r"(?s)^(.+)\.[^.]*$", "$1")


def coordinates(file_name: Column) -> Column:
    """group, artifact and version told by a file name; all null if it tells no version."""
    own = stem(file_name)
    pattern = r"^([^-]*(?:-[^0-9-][^-]*|-(?=-)|-$)*)-([0-9].*)$"
    artifact, version = F.regexp_extract(own, pattern, 1), F.regexp_extract(own, pattern, 2)
    told = (version != "") & (artifact != "")
    last = F.substring_index(artifact, ".", -1)
    dotted = artifact.rlike(r"^.+\.") & ~last.rlike(r"^[0-9]+(\.[0-9]+)?$")
    group = F.when(dotted, F.regexp_replace(artifact, r"\.[^.]*$", ""))
    name = F.when(dotted, last).otherwise(artifact)
    return F.struct(F.when(told, maven_id(group)).alias("group_id"), F.when(told, maven_id(name)).alias("artifact_id"), F.when(told, sanitized(version, r"[^A-Za-z0-9_\-.+]")).alias("version"))


def group_of_package(path: Column) -> Column:
    """a package path without its last segment; null if there is but one."""
    own = F.trim(F.regexp_replace(path, r"\.\*$", ""))
    return F.when(own.contains("."), F.nullif(F.regexp_replace(own, r"\.[^.]*$", ""), F.lit("")))


def classifier(file_name: Column) -> Column:
    """F12."""
    own = F.lower(file_name)
    return F.when(own.endswith("-sources.jar"), "sources").when(own.rlike(r"-javadocs?\.jar$"), "javadoc")


def is_archive(file_name: Column) -> Column:
    """A Java archive that is no companion."""
    own = F.lower(file_name)
    return own.rlike(r"\.(" + "|".join(ARCHIVES) + ")$") & ~own.rlike(r"-(sources|javadoc)\.jar$")


def match_score(artifact: Column, name: Column) -> Column:
    """3 equal, 2 the name goes on after - or _, 1 the artifact does, 0 neither."""
    goes_on = lambda short, long: (F.length(short) > 2) & (long.startswith(F.concat(short, F.lit("-"))) | long.startswith(F.concat(short, F.lit("_"))))
    return F.when(F.length(name) < 2, 0).when(artifact == name, 3).when(goes_on(artifact, name), 2).when(goes_on(name, artifact), 1).otherwise(0)


def image_parts(tag: Column) -> Column:
    """namespace, name and version of an image tag; the first of three or more segments is the namespace."""
    name = F.regexp_replace(tag, ":[^:]*$", "")
    version = F.regexp_extract(tag, ":([^:]*)$", 1)
    many = F.size(F.split(name, "/")) >= 3
    return F.struct(
        F.when(many, F.substring_index(name, "/", 1)).alias("namespace"),
        F.when(many, F.regexp_replace(name, "^[^/]*/", "")).otherwise(name).alias("name"),
        F.nullif(version, F.lit("")).alias("version"),
    )


def short_name(name: Column) -> Column:
    """what stands after the last colon or slash."""
    return F.element_at(F.split(name, "[:/]"), -1)


def clean_path(path: Column) -> Column:
    """A path without leading ``./``, ``/`` and ``../``."""
    return F.regexp_replace(path, r"^(?:\./|/|\.\./)+", "")


def bom_name(identifier: Column) -> Column:
    """the file name of a root's bill of materials."""
    return F.concat(F.lit("cbom_"), F.translate(identifier, ":/", "__"), F.lit(".json"))


def dependency_ref(name: Column) -> Column:
    """the reference of a dependency."""
    return F.concat(F.lit("dep-"), F.translate(F.lower(name), "/ ", "--"))
