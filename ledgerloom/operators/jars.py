"""Facts about a Java archive that its members tell (A09), in one aggregation by container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import manifest


def _listed(condition: Column, value: Column) -> Column:
    """The sorted distinct values of the members that meet a condition, null if there are none."""
    own = F.array_sort(F.collect_set(F.when(condition, value)))
    return F.when(F.size(own) > 0, F.array_join(own, ","))


def archive_facts(members: DataFrame) -> DataFrame:
    """(id, key, value) of containers from their members (container, path, text).

    Every fact is a combining aggregate, so members are reduced before they are
    shuffled, and an archive with many members is never one row but its facts.
    """
    path, name = F.col("path"), F.substring_index("path", "/", -1)
    head = F.when(path == "META-INF/MANIFEST.MF", manifest(F.col("text")))
    first = lambda k: F.max(F.try_element_at(head, F.lit(k)))
    any_ = lambda c: F.bool_or(c)
    facts = {
        "JarType": F.when(any_(path.startswith("BOOT-INF/")), "spring-boot").when(any_(path.startswith("WEB-INF/")), "war").when(any_(path == "META-INF/application.xml"), "ear").otherwise("jar"),
        "NestedJars": _listed(name.endswith(".jar"), path),
        "SpringBootMainClass": first("start-class"),
        "LayersIdx": F.when(any_(path == "BOOT-INF/layers.idx"), "true"),
        "ClasspathIdx": F.when(any_(path == "BOOT-INF/classpath.idx"), "true"),
        "WarLibJars": _listed(path.rlike(r"^WEB-INF/lib/[^/]+\.jar$"), name),
        "EarModules": _listed(path.rlike(r"^[^/]+\.(war|jar|rar)$"), path),
        "JarSigned": F.when(any_(path.rlike(r"^META-INF/[^/]+\.(RSA|DSA|EC)$")), "true"),
        "SignatureFiles": _listed(path.rlike(r"^META-INF/[^/]+\.(SF|RSA|DSA|EC)$"), name),
        "MultiReleaseVersions": _listed(path.rlike(r"^META-INF/versions/[0-9]+/"), F.regexp_extract(path, r"^META-INF/versions/([0-9]+)/", 1)),
        "ServiceProviders": _listed(path.rlike(r"^META-INF/services/[^/]+$"), name),
        "AutomaticModuleName": first("automatic-module-name"),
        "GraalNativeImage": F.when(any_(path.startswith("META-INF/native-image/")), "true"),
        "JenkinsPlugin": first("short-name"),
    }
    own = members.groupBy(F.col("container").alias("id")).agg(*(v.alias(k) for k, v in facts.items()))
    each = F.array(*(F.struct(F.lit("maven:" + k).alias("key"), F.col(k).alias("value")) for k in facts))
    long = own.select("id", F.explode(each).alias("f")).select("id", "f.key", "f.value").filter("value is not null")
    # Modules are listed for enterprise archives alone.
    ears = own.filter(F.col("JarType") == "ear").select("id")
    return long.filter("key <> 'maven:EarModules'").unionByName(long.filter("key = 'maven:EarModules'").join(ears, "id", "left_semi"))


#: Sources of an archive's coordinates, the most trusted first.
SOURCES = ("pom", "embedded", "filename", "manifest", "metadata")


def coordinates(told: DataFrame) -> DataFrame:
    """Id, field, value and source: each field (id, source, field, value) from the first source that tells it; of equal sources the least value."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    known = told.filter(F.col("value").isNotNull() & (F.col("value") != "") & (rank > 0))
    return known.groupBy("id", "field").agg(F.min(F.struct(rank.alias("rank"), "value", "source")).alias("best")).select("id", "field", "best.value", "best.source")
