"""A fluent builder of artifact graphs, and the steps it runs."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.textual import date
from .model import ALIAS_FROM, CONTAINS, METADATA_BODY
from .operators import bills, cbom, classes, graph, images, joins, merge, strategies
from .operators.configs import without_leaks
from .operators.jars import archive_facts
from .operators.tags import package_tags, run_tag, tagged
from .sources import clusters, files, scanners
from .storage import materialised
from .streaming.upsert import graph_of, with_aliases

Hook = Callable[[DataFrame, DataFrame], bool]
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
MANIFEST = "META-INF/MANIFEST.MF"


def elsewhere(claimed: DataFrame, held: DataFrame, taken: DataFrame) -> DataFrame:
    """Claimed artifacts (id, path) but those that occur only as parts of what took them: ``taken`` has container and id.

    Only the occurrences of taken contents are looked at.
    """
    own = held.join(taken.select("id").distinct(), "id", "left_semi").join(taken.select(F.col("container").alias("scope"), "id", F.lit(True).alias("took")), ["scope", "id"], "left")
    gone = own.groupBy("id", "path").agg(F.bool_and(F.coalesce("took", F.lit(False))).alias("all")).filter("all").select("id", "path")
    return claimed.join(gone, ["id", "path"], "left_anti")


class GraphBuilder:
    """Collects what to read and how; ``run`` builds one graph, whatever the number of artifacts.

    After ``run``, ``extra`` has the metadata (id, key, mime, value), ``purls``
    the package URLs (id, purl), and ``bills``, if asked for, one bill of
    materials for each root that holds cryptographic material.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []
        self.lists: list[str] = []
        self.exclude: str | None = None
        self.blocked: DataFrame | None = None
        self.cutoff: int | None = None
        self.tag: tuple[str, str] | None = None
        self.output: str | None = None
        self.hooks: list[Hook] = []
        self.package_tags = False
        self.changes: list[DataFrame] = []
        self.own: list[tuple[str, Column, Extractor]] = []
        self.types: list[tuple[str, Column]] = []
        self.bill_folder: str | None = None
        self.ingested: str | None = None
        self.extra: DataFrame | None = None
        self.purls: DataFrame | None = None
        self.bills: DataFrame | None = None

    def with_folder(self, *folders: str) -> GraphBuilder:
        self.folders += folders
        return self

    def with_file_list(self, *lists: str) -> GraphBuilder:
        self.lists += lists
        return self

    def with_exclude(self, pattern: str) -> GraphBuilder:
        """Names in which the pattern is found anywhere are left out."""
        self.exclude = pattern
        return self

    def with_block_list(self, path: str) -> GraphBuilder:
        """A text file of identifiers, one a line; a file that cannot be read is an error."""
        self.blocked = self.spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")
        return self

    def with_cutoff(self, when: str) -> GraphBuilder:
        """Milliseconds or a date (F42); anything else is an error, so that nothing is pruned by mistake."""
        own = when.strip()
        if own.isdigit():
            self.cutoff = int(own)
            return self
        parsed = self.spark.range(1).select(F.unix_millis(date(F.lit(own)).cast("timestamp")).alias("ms")).first().ms
        if parsed is None:
            raise ValueError(f"not a date: {when}")
        self.cutoff = parsed
        return self

    def with_tag(self, name: str, version: str | None = None, more: str | None = None) -> GraphBuilder:
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.tag = run_tag(name, now, version, more)
        return self

    def with_package_tags(self) -> GraphBuilder:
        """One tag for each package that a top-level artifact is, below the tag root."""
        self.package_tags = True
        return self

    def with_bills(self, folder: str) -> GraphBuilder:
        """Write the bills of materials to a folder."""
        self.bill_folder = folder
        return self

    def with_ingested_list(self, folder: str) -> GraphBuilder:
        """Append the paths of what was read to a text table."""
        self.ingested = folder
        return self

    def with_output(self, folder: str) -> GraphBuilder:
        self.output = folder
        return self

    def with_hook(self, hook: Hook) -> GraphBuilder:
        """Called with items and edges before writing; nothing is written unless all hooks return True."""
        self.hooks.append(hook)
        return self

    def with_augmentation(self, changes: DataFrame) -> GraphBuilder:
        """Metadata (hash, key, value) for whatever has the hash as its identifier or an alias; the key ``alias:from`` adds a package URL."""
        self.changes.append(changes.select("hash", "key", "value"))
        return self

    def with_scanner_reports(self, *paths: str) -> GraphBuilder:
        """What an external scanner has found, one JSON report a file."""
        return self.with_augmentation(scanners.changes(scanners.read_reports(self.spark, *paths)))

    def with_strategy(self, name: str, condition: Column, extractor: Extractor) -> GraphBuilder:
        """A strategy that takes artifacts (path, mime, text) before all others.

        ``extractor`` gets what it took (id, path, mime, text) and gives metadata (id, key, mime, value) and package URLs (id, purl).
        """
        self.own.append((name, condition, extractor))
        return self

    def with_type(self, name: str, condition: Column) -> GraphBuilder:
        """Adds a content type where a condition on path, mime and content holds; containers are opened by the built-in types alone."""
        self.types.append((name, condition))
        return self

    def artifacts(self) -> DataFrame:
        """All artifacts of the folders and lists, with what their containers hold."""
        found = [files.scan(self.spark, *self.folders, exclude=self.exclude)] if self.folders else []
        found += [files.listed(self.spark, path) for path in self.lists]
        if not found:
            raise ValueError("nothing to read: give a folder or a file list")
        own = found[0]
        for more in found[1:]:
            own = own.unionByName(more)
        whole = files.expand(own, self.blocked)
        if self.types:
            more = F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in self.types)), lambda t: t.isNotNull())
            whole = whole.withColumn("mime", F.array_union("mime", more))
        return whole

    def augmented(self, edges: DataFrame) -> DataFrame:
        """(id, key, value) of the given changes for the graph's items, found by their identifiers and aliases."""
        names = edges.filter(F.col("edge_type") == ALIAS_FROM).select(F.col("src").alias("id"), F.col("dst").alias("hash"))
        names = names.unionByName(names.select("id", F.col("id").alias("hash"))).distinct()
        changes = self.changes[0]
        for more in self.changes[1:]:
            changes = changes.unionByName(more)
        everywhere = F.lit("").alias("scope")
        return joins.augmented(names, names.select("id", everywhere).distinct(), changes.select(everywhere, "hash", "key", "value"))

    def described(self, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Metadata and package URLs of the artifacts, and the images among them with their layers.

        Facts come from what strategies extract, from what members tell of archives, and from images.
        """
        # Written once: every extractor reads the claims, and none the contents.
        claimed = materialised(strategies.needed(strategies.claims(strategies.with_text(own), [(name, condition) for name, condition, _ in self.own])), "claims")
        held = own.filter("container is not null").select(F.col("container").alias("scope"), "path", "id")
        jsons = claimed.filter(F.array_contains("mime", "application/json") & F.col("text").isNotNull()).select("id", F.col("text").alias("json")).dropDuplicates(["id"])
        found = materialised(images.images(held, jsons), "images")
        layers = materialised(images.layers(found, held), "layers")
        claimed = elsewhere(claimed, held, images.members(found, layers))
        wanted = claimed.filter("strategy in ('certificates', 'dotnet') and text is null or strategy = 'embedded-certificates' or array_contains(mime, 'application/x-rpm')").select("id", "path").distinct()
        contents = own.select("id", "path", "content").join(wanted, ["id", "path"], "left_semi").dropDuplicates(["id"])
        places = own.select(F.coalesce("container", F.lit("")).alias("scope"), "path", "id").distinct()
        extra, purls = strategies.extract(claimed, contents, places)
        for name, _, extractor in self.own:
            more_extra, more_purls = extractor(claimed.filter(F.col("strategy") == name).select("id", "path", "mime", "text"))
            extra, purls = extra.unionByName(without_leaks(more_extra.select("id", "key", "mime", "value"))), purls.unionByName(more_purls.select("id", "purl"))
        java = own.filter(F.array_contains("mime", "application/java-archive")).select(F.col("id").alias("container")).distinct()
        members = own.filter("container is not null").select("id", "path", "container").distinct().join(java, "container", "left_semi")
        heads = strategies.with_text(own.filter(F.col("path") == MANIFEST)).select("id", "text").dropDuplicates(["id"])
        of_path = members.join(heads, "id", "left").withColumn("text", F.when(F.col("path") == MANIFEST, F.col("text")))
        facts = archive_facts(of_path.select("container", "path", "text"))
        modules = materialised(classes.described_modules(own), "modules")
        named = modules.filter("key = 'maven:AutomaticModuleName'").select("id", "key")  # a descriptor's name counts, not the manifest's
        facts = facts.join(named, ["id", "key"], "left_anti").select(facts.columns).unionByName(modules)
        extra = extra.unionByName(facts.select("id", "key", F.lit(None).cast("string").alias("mime"), "value")).unionByName(without_leaks(images.metadata(found), long_hex=False)).distinct()
        return materialised(extra, "extra"), materialised(purls.unionByName(images.purls(found).select("id", "purl")).distinct(), "purls"), found, layers

    def billed(self, items: DataFrame, edges: DataFrame, extra: DataFrame) -> DataFrame:
        """(root, file_name, document) of every root that holds cryptographic material."""
        roots = graph.roots(items, edges).select(F.col("id").alias("root"), "id")
        down = edges.filter(F.col("edge_type") == CONTAINS)
        found = graph.reach(roots, down, cbom.DEPTH)
        items = materialised(bills.described(bills.item_maps(extra)), "described")
        own = bills.components(items, edges.filter(F.col("edge_type") == ALIAS_FROM).select(F.col("src").alias("id"), F.col("dst").alias("alias")))
        parts = bills.of_roots(found, own)
        return bills.documents(parts, datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Items and edges of the graph; written to the output folder if there is one."""
        own = self.artifacts()
        items, edges = graph_of(own)
        edges = with_aliases(own, edges)
        extra, purls, found, layers = self.described(own)
        if self.changes:
            told = materialised(self.augmented(edges), "augmented")
            extra = extra.unionByName(told.filter("key <> 'alias:from'").select("id", "key", F.lit(None).cast("string").alias("mime"), "value")).distinct()
            purls = purls.unionByName(told.filter("key = 'alias:from'").select("id", F.col("value").alias("purl"))).distinct()
        edges = edges.unionByName(images.layer_edges(layers)).unionByName(graph.with_reversed(classes.built_from(own)))
        typed = images.types(found, layers)
        none = F.array().cast("array<string>")
        items = items.unionByName(typed.select("id", F.lit(METADATA_BODY).alias("body_mime"), none.alias("file_names"), "mime_types", F.lit(None).cast("long").alias("file_size")))
        edges = edges.unionByName(graph.with_reversed(purls.select(F.col("id").alias("src"), F.lit(ALIAS_FROM).alias("edge_type"), F.col("purl").alias("dst")))).distinct()
        tops = own.filter("depth = 0").select("id").distinct()
        added = [tagged(self.spark, tops, self.tag)] if self.tag else []
        if self.package_tags:
            name, version = F.regexp_extract("purl", "^pkg:([^@?#]+)", 1), F.nullif(F.regexp_extract("purl", "@([^?#]+)", 1), F.lit(""))
            when = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            packaged = purls.join(tops, "id", "left_semi").select("id", name.alias("name"), version.alias("version"), F.lit(when).alias("date"))
            tagged_images = images.image_tags(found).filter("position = 0").select(F.col("config").alias("id"), F.col("tag").alias("name"), F.nullif(F.regexp_extract("tag", ":([^:]*)$", 1), F.lit("")).alias("version"), F.lit(when).alias("date"))
            added.append(package_tags(packaged.unionByName(tagged_images).distinct()))
        for more_items, more_edges in added:
            items = items.unionByName(more_items.select("id", "body_mime", none.alias("file_names"), none.alias("mime_types"), F.lit(None).cast("long").alias("file_size")))
            edges = edges.unionByName(graph.with_reversed(more_edges)).distinct()
        if self.cutoff is not None:
            mtimes = own.groupBy("id").agg(F.min("mtime").alias("mtime"))
            kept, edges = graph.pruned(items.join(mtimes, "id", "left"), edges, F.col("mtime") > self.cutoff)
            items = kept.drop("mtime")
            extra, purls = (df.join(items.select("id"), "id", "left_semi").select(df.columns) for df in (extra, purls))
        items = merge.merged_items(items)
        self.extra, self.purls = extra, purls
        if self.bill_folder:
            self.bills = materialised(self.billed(items, edges, extra), "bills")
        if all(hook(items, edges) for hook in self.hooks):
            if self.output:
                clusters.write_graph(items, edges, self.output, extra)
                purls.select("purl").distinct().orderBy("purl").write.mode("overwrite").text(f"{self.output}/purls")
            if self.bills is not None:
                cbom.write_documents(self.bills, self.bill_folder)
            if self.ingested:
                files.record_ingested(own, self.ingested)
        return items, edges
