""".NET assemblies: names, versions, references and attributes, from the rows of ``sources.records``.

Defined results: a file that is no assembly tells nothing; attributes that the assembly's own code makes, and those without
a text, are left out; of equal attributes the least text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packages
from ..sources import records as rec
from .keymaterial import long_form, place

# Attributes and the names of their facts.
ATTRIBUTES = {"System.Reflection.CopyrightAttribute": "Copyright", "System.Reflection.TrademarkAttribute": "Trademark", "System.Reflection.AssemblyTrademarkAttribute": "Publisher", "System.Reflection.AssemblyDescriptionAttribute": "Description"}


def _field(first: int, j: int) -> Column:
    return F.max(F.when((place(0) == first) & (place(2) == j), F.col("value")))


def _text(value: Column) -> Column:
    return F.try_validate_utf8(value)


def version_text(value: Column, parts: int = 4) -> Column:
    """Eight bytes as numbers with dots."""
    return F.concat_ws(".", *(F.conv(F.hex(F.substring(value, 2 * i + 1, 2)), 16, 10) for i in range(parts)))


def key_token(key: Column, whole: Column) -> Column:
    """The token of a key: the last eight bytes of its digest, backwards; a token stays."""
    digest = F.sha1(key)
    of_key = F.concat(*(F.substring(digest, 39 - 2 * i, 2) for i in range(8)))
    return F.when(F.length(key) == 0, "").when(whole, of_key).otherwise(F.lower(F.hex(key)))


def facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata (id, key, value) and package URLs (id, purl)."""
    own = rows.filter(place(0) == rec.OWN).groupBy("id").agg(*(_field(rec.OWN, j).alias(n) for j, n in enumerate(("name", "version", "culture", "key", "flags"))))
    has_key = F.conv(F.hex("flags"), 16, 10).cast("long") % 2 == 1
    needed = rows.filter(place(0) == rec.NEEDED).groupBy("id", place(1).alias("n")).agg(*(_field(rec.NEEDED, j).alias(n) for j, n in enumerate(("name", "version", "culture", "key", "flags"))))
    reference = F.struct(
        _text(F.col("name")).alias("name"), F.col("n"), version_text(F.col("version")).alias("version"), key_token(F.col("key"), has_key).alias("public_key_token"), F.when(has_key, F.lower(F.hex("key"))).alias("public_key"),
    )
    listed = F.transform(F.array_sort(F.collect_list(reference)), lambda r: F.struct(*(r[c].alias(c) for c in ("name", "version", "public_key_token", "public_key"))))
    depends = needed.groupBy("id").agg(F.to_json(F.struct(listed.alias("dependencies"))).alias("dependencies"))
    noted = rows.filter(place(0) == rec.NOTED).groupBy("id", place(1).alias("n")).agg(F.max(F.when(place(2) == 0, _text(F.col("value")))).alias("type"), F.max(F.when(place(2) == 1, _text(F.col("value")))).alias("text"))
    told = noted.groupBy("id").agg(*(F.min(F.when(F.col("type") == t, F.col("text"))).alias(k) for t, k in ATTRIBUTES.items()))
    whole = own.join(depends, "id", "left").join(told, "id", "left")
    name, version = _text(F.col("name")), version_text(F.col("version"))
    culture = _text(F.col("culture"))
    token = F.coalesce(F.nullif(key_token(F.col("key"), F.lit(True)), F.lit("")), F.lit("null"))
    full = F.concat(name, F.lit(", Version="), version, F.lit(", Culture="), F.coalesce(F.nullif(culture, F.lit("")), F.lit("neutral")), F.lit(", PublicKeyToken="), token)
    long = long_form(whole, {"Name": full, "SimpleName": name, "Version": version, "Locale": culture, "PublicKey": F.lower(F.hex("key")), "Dependencies": F.col("dependencies")} | {k: F.col(k) for k in ATTRIBUTES.values()})
    short = F.when(F.hex(F.substring("version", 7, 2)) == "0000", version_text(F.col("version"), 3)).otherwise(version)
    return long, own.select("id", packages.purl("nuget", packages.sanitized(name), packages.sanitized(short, r"[^A-Za-z0-9_\-.+]")).alias("purl")).filter("purl is not null")
