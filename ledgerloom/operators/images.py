"""Container images from what archives hold (J03, J09): manifest, configuration and layers, joined by path.

An image archive names in ``manifest.json``, for each image, the path of its
configuration and those of its layers, in order.  ``parts`` resolves these paths among the files of
the same archive by equi-joins.  A path counts only where exactly one file of the archive has it.
No archive's files ever meet in one row: lists are exploded with their positions.

What is shuffled is small: a path that is a blob's digest goes as the digest's bytes (``coded``), and a manifest's lists move
once, after the configurations have been found by their paths alone.  These are written, so that their shuffles can go.

Defined results: a manifest that is no JSON array, or that several files of an archive claim to be, gives no
image; an entry without a configuration that is there, alone and JSON gives none either; a
layer that is missing or there twice is left out, others keep their positions; a layer named
twice is there twice; files without an archive, and nulls, match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packages
from ..functions.tokens import image_facts
from ..model import CONTAINED_BY, CONTAINS
from ..storage import materialised

MANIFEST, BLOBS = "manifest.json", "blobs/sha256/"
LAYER_TYPE = "application/vnd.oci.image.layer.v1.tar"
CONFIG_TYPES = ("application/vnd.oci.image.config.v1+json", "application/vnd.oci.image.manifest.v1+json")
# Facts, the label that tells each, and an older label that counts where the first is missing.
LABELS = (
    ("Source", "org.opencontainers.image.source", "org.label-schema.vcs-url"),
    ("Revision", "org.opencontainers.image.revision", "org.label-schema.vcs-ref"),
    ("License", "org.opencontainers.image.licenses", None),
    ("Title", "org.opencontainers.image.title", "org.label-schema.name"),
    ("Description", "org.opencontainers.image.description", "org.label-schema.description"),
    ("Url", "org.opencontainers.image.url", "org.label-schema.url"),
    ("Vendor", "org.opencontainers.image.vendor", "org.label-schema.vendor"),
    ("ImageLabelVersion", "org.opencontainers.image.version", "org.label-schema.version"),
    ("BaseImageRef", "org.opencontainers.image.base.name", None),
    ("BaseImageDigest", "org.opencontainers.image.base.digest", None),
    ("LabelCreated", "org.opencontainers.image.created", "org.label-schema.build-date"),
    ("BuildDate", "org.opencontainers.image.created", "org.label-schema.build-date"),
)


def _json(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def _list(column: str, path: str) -> Column:
    return F.from_json(_json(column, path), "array<string>")


def coded(path: Column) -> Column:
    """A path as bytes, half as many where it is a blob's hexadecimal digest; equal for equal paths alone."""
    digest = path.rlike(rf"^{BLOBS}(?:[0-9a-f]{{2}}){{1,64}}\z")
    return F.when(digest, F.concat(F.lit(b"\x01"), F.unhex(F.substring(path, len(BLOBS) + 1, 128)))).otherwise(F.concat(F.lit(b"\x00"), path.cast("binary")))


def decoded(code: Column) -> Column:
    """The path that ``coded`` made the bytes of."""
    rest = F.substring(code, 2, (1 << 31) - 1)
    return F.when(F.substring(code, 1, 1) == b"\x01", F.concat(F.lit(BLOBS), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


def single(files: DataFrame) -> DataFrame:
    """scope, code (of the path) and id of the files that are alone under their path in their archive."""
    found = files.filter("scope is not null").groupBy("scope", coded(F.col("path")).alias("code")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return found.filter("n = 1").drop("n")


def _entries(texts: DataFrame) -> DataFrame:
    """manifest, image, entry and config_path of the entries of texts that are arrays."""
    entries = texts.filter(F.col("json").rlike(r"^\s*\[")).select(F.col("id").alias("manifest"), F.posexplode(F.from_json("json", "array<string>")).alias("image", "entry"))
    return entries.withColumn("config_path", _json("entry", "$.Config")).filter(F.col("config_path").startswith(BLOBS))


def images(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Scope, manifest, image, entry, config_path, layers, config, config_json and oci_json of each image.

    files: scope, path, id, one row for each file of an archive.  texts: id and json, once for each file that is JSON.
    ``image`` is the place in the manifest's array; ``layers`` are the codes of the listed paths; ``oci_json`` is the manifest blob that names the configuration's digest.
    """
    read = texts.filter(F.try_parse_json("json").isNotNull())
    manifests = single(files.filter(F.col("path") == MANIFEST)).select("scope", F.col("id").alias("manifest"))
    # Without the entries, which are long: they meet the images that have a configuration.
    heads = manifests.join(_entries(read).select("manifest", "image", coded(F.col("config_path")).alias("code")), "manifest")
    blobs = single(files.filter(F.col("path").startswith(BLOBS)))
    found = heads.join(blobs.withColumnRenamed("id", "config"), ["scope", "code"])
    # No semi-join, which Spark would push below the one before it, to all files.
    found = materialised(found.join(read.select(F.col("id").alias("config")), "config"), "image_heads", release=True)
    # Of the manifests that are JSON.  The columns are made here, and outer joins have one row a key, so that who wants the layers alone moves no JSON.
    found = found.join(_entries(texts).withColumn("layers", F.transform(_list("entry", "$.Layers"), coded)), ["manifest", "image"])
    found = found.join(texts.groupBy(F.col("id").alias("config")).agg(F.min("json").alias("config_json")), "config", "left")
    kind, digest = _json("json", "$.mediaType"), _json("json", "$.config.digest")
    described = kind.contains("vnd.oci.image.manifest") | kind.contains("vnd.docker.distribution.manifest")
    told = read.filter(described & digest.startswith("sha256:") & _json("json", "$.schemaVersion").rlike("^-?[0-9]+$"))
    told = told.select("id", "json", coded(F.concat(F.lit(BLOBS), F.substring(digest, 8, 1 << 20))).alias("code"))
    oci = blobs.select("scope", "id").join(told, "id").groupBy("scope", "code").agg(F.min("json").alias("oci_json"))
    return found.join(oci, ["scope", "code"], "left").select("scope", "manifest", "image", "entry", "config_path", "layers", "config", "config_json", "oci_json")


def layers(found: DataFrame, files: DataFrame) -> DataFrame:
    """Scope, image, config, position, layer_path and layer of the layers of ``found``, in the order of the manifest."""
    listed = found.select("scope", "image", "config", F.posexplode("layers").alias("position", "code"))
    held = listed.join(single(files).withColumnRenamed("id", "layer"), ["scope", "code"])
    return held.select("scope", decoded(F.col("code")).alias("layer_path"), "image", "config", "position", "layer")


def layer_edges(found: DataFrame) -> DataFrame:
    """Each configuration contains its layers, once however often they are listed; both directions.

    Pairs are made distinct before each gives two edges, whose types differ.
    """
    pairs = found.select("config", "layer").distinct()
    both = F.array(F.struct(F.col("layer").alias("src"), F.lit(CONTAINED_BY).alias("edge_type"), F.col("config").alias("dst")), F.struct(F.col("config").alias("src"), F.lit(CONTAINS).alias("edge_type"), F.col("layer").alias("dst")))
    return pairs.select(F.explode(both).alias("e")).select("e.*")


def image_tags(found: DataFrame) -> DataFrame:
    """scope, image, config, position and tag of every tag that a manifest gives an image."""
    return found.select("scope", "image", "config", F.posexplode(_list("entry", "$.RepoTags")).alias("position", "tag"))


def tag_purl(tag: Column) -> Column:
    """The package URL of an image tag, null without name or version."""
    parts = packages.image_parts(tag)
    version = packages.sanitized(parts["version"], r"[^A-Za-z0-9_\-.+]")
    return F.when(version.isNotNull(), packages.purl("docker", packages.sanitized(parts["name"], r"[^A-Za-z0-9_\-. /]"), version, packages.sanitized(parts["namespace"])))


def purls(found: DataFrame) -> DataFrame:
    """id, purl and position of the package URLs of each configuration."""
    return image_tags(found).select(F.col("config").alias("id"), tag_purl(F.col("tag")).alias("purl"), "position").filter("purl is not null")


def metadata(found: DataFrame) -> DataFrame:
    """id, key, mime and value: what configurations and manifests tell, under the prefix ``docker:``."""
    own = found.withColumn("f", image_facts(F.col("config_json"))).withColumn("labels", F.map_filter(F.from_json(_json("config_json", "$.config.Labels"), "map<string,string>"), lambda _, v: v != ""))
    words = lambda path: F.array_join(_list("config_json", path), " ")
    parts = [_json("config_json", p) for p in ("$.os", "$.architecture", "$.variant")]
    sizes = F.map_values(F.from_json(_json("entry", "$.LayerSources"), "map<string,struct<size:long>>"))
    size = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["size"], F.lit(0)))
    listed = lambda path: F.size(_list("config_json", path))
    label = lambda *keys: F.coalesce(*(F.try_element_at("labels", F.lit(k)) for k in keys if k))
    facts = {
        "Platform": F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in parts)), "Created": F.col("f.created"), "Author": F.col("f.author"), "WorkingDir": F.col("f.working_dir"), "User": F.col("f.user"),
        "Entrypoint": words("$.config.Entrypoint"), "Cmd": words("$.config.Cmd"), "EnvCount": F.when(listed("$.config.Env") >= 0, listed("$.config.Env")), "LayerCount": F.when(listed("$.rootfs.diff_ids") >= 0, listed("$.rootfs.diff_ids")),
        "Size": F.when(size > 0, size), "RepoDigest": F.element_at(F.filter(F.concat(_list("entry", "$.RepoDigests"), F.array(F.lit(None).cast("string"))), lambda d: F.coalesce(d != "", F.lit(True))), 1),
        "ConfigMediaType": _json("oci_json", "$.config.mediaType"), "ConfigJson": _json("config_json", "$"), "ManifestJson": _json("entry", "$"),
    } | {name: label(first, second) for name, first, second in LABELS}
    known = sorted({k for _, *keys in LABELS for k in keys if k})
    env = F.transform(F.filter(_list("config_json", "$.config.Env"), lambda e: e != ""), lambda e: F.struct(F.concat(F.lit("Env:"), F.substring_index(e, "=", 1)).alias("key"), F.when(e.contains("="), F.regexp_replace(e, "^[^=]*=", "")).otherwise("").alias("value")))
    rest = F.transform(F.map_entries(F.map_filter("labels", lambda k, _: ~k.isin(known))), lambda e: F.struct(F.concat(F.lit("Label:"), e["key"]).alias("key"), e["value"].alias("value")))
    history = F.transform("f.history", lambda h: F.struct(F.lit("History").alias("key"), h.alias("value")))
    fixed = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()))
    none = F.array().cast("array<struct<key:string,value:string>>")
    told = F.filter(fixed, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    more = F.concat(told, *(F.coalesce(x, none) for x in (env, rest, history)))
    rows = own.select(F.col("config").alias("id"), F.explode(more).alias("p")).select("id", F.concat(F.lit("docker:"), "p.key").alias("key"), F.lit(None).cast("string").alias("mime"), "p.value")
    first = purls(found).groupBy("id").agg(F.min_by("purl", F.struct("position", "purl")).alias("value"))
    return rows.unionByName(first.select("id", F.lit("CanonicalPurl").alias("key"), F.lit(None).cast("string").alias("mime"), "value")).distinct()


def types(found: DataFrame, held: DataFrame) -> DataFrame:
    """id and mime_types that being part of an image gives."""
    configs = found.select(F.col("config").alias("id"), F.array(*map(F.lit, CONFIG_TYPES)).alias("mime_types"))
    return configs.unionByName(held.select(F.col("layer").alias("id"), F.array(F.lit(LAYER_TYPE)).alias("mime_types"))).distinct()


def members(found: DataFrame, held: DataFrame) -> DataFrame:
    """container and id of every file that belongs to an image: what other strategies need not look at."""
    own = [found.select(F.col("scope").alias("container"), F.col(c).alias("id")) for c in ("manifest", "config")]
    return own[0].unionByName(own[1]).unionByName(held.select(F.col("scope").alias("container"), F.col("layer").alias("id"))).distinct()
