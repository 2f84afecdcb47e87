"""Queries over documents as artifacts: identity, merging, roots, sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..model import ALIAS_FROM, CONTAINED_BY, METADATA_BODY
from ..operators import bills, filters, graph, joins, merge, tags
from .base import GITOID_SQL, query, table


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, container, text and size of each document."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(
        identity.gitoid(F.col("text")).alias("id"), path.alias("path"), F.concat(F.lit("source:"), "source").alias("container"), "text", "lang", "source", "doc_id", F.octet_length("text").cast("long").alias("size")
    )


ARTIFACTS_SQL = f"""artifacts AS (SELECT {GITOID_SQL} AS id, source || '/' || lang || '/' || doc_id || '.txt' AS path,
    'source:' || source AS container, text, lang, source, doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents)"""


def items_of(own: DataFrame) -> DataFrame:
    """Items of artifacts and of their containers."""
    body = F.lit(METADATA_BODY).alias("body_mime")
    files = own.select("id", body, F.array("path").alias("file_names"), F.array(F.lit("text/plain")).alias("mime_types"), F.col("size").alias("file_size"))
    held = own.select(F.col("container").alias("id"), body, F.array("source").alias("file_names"), F.array(F.lit("inode/directory")).alias("mime_types"), F.lit(0).cast("long").alias("file_size")).distinct()
    return merge.merged_items(files.unionByName(held))


def edges_of(own: DataFrame) -> DataFrame:
    """Containment and alias edges of artifacts, with their reverses."""
    out = F.array(
        F.struct("id", F.lit(CONTAINED_BY).alias("edge_type"), F.col("container").alias("dst")),
        F.struct("id", F.lit(ALIAS_FROM).alias("edge_type"), F.concat(F.lit("md5:"), F.md5("text")).alias("dst")),
        F.struct("id", F.lit(ALIAS_FROM).alias("edge_type"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("dst")),
    )
    return graph.with_reversed(own.select(F.explode(out).alias("e")).select(F.col("e.id").alias("src"), "e.edge_type", "e.dst"))


EDGES_SQL = ARTIFACTS_SQL + """, direct AS (
    SELECT DISTINCT id AS src, 'contained:up' AS edge_type, container AS dst FROM artifacts
    UNION SELECT id, 'alias:from', 'md5:' || md5(text) FROM artifacts
    UNION SELECT id, 'alias:from', 'sha256:' || sha256(text) FROM artifacts
), edges AS (SELECT src, edge_type, dst FROM direct
    UNION SELECT dst, CASE edge_type WHEN 'contained:up' THEN 'contained:down' ELSE 'alias:to' END, src FROM direct)"""


@query("m01_roots", f"""WITH {EDGES_SQL}
SELECT src AS root, count(DISTINCT dst) AS n_items FROM edges
WHERE edge_type = 'contained:down' AND src NOT IN (SELECT src FROM edges WHERE edge_type IN ('alias:to', 'contained:up'))
GROUP BY src""")
def m01_roots(spark, sf_dir):
    """The flagship: artifacts to items and edges to roots, with the number of items in each."""
    own = artifacts(spark, sf_dir)
    edges = edges_of(own)
    found = graph.roots(items_of(own), edges)
    return graph.contained(edges).join(found.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("root")).agg(F.count("*").alias("n_items"))


@query("a01_item_merge", f"""WITH {ARTIFACTS_SQL}
SELECT id, max(size) AS file_size, count(DISTINCT path) AS n_names, array_to_string(list_sort(list(DISTINCT path)), ' ') AS names FROM artifacts GROUP BY id""")
def a01_item_merge(spark, sf_dir):
    own = items_of(artifacts(spark, sf_dir)).filter(identity.is_blob(F.col("id")))
    return own.select("id", "file_size", F.size("file_names").cast("long").alias("n_names"), F.array_join("file_names", " ").alias("names"))


@query("a03_reverse_edges", f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n, count(DISTINCT src) AS n_src FROM edges GROUP BY edge_type")
def a03_reverse_edges(spark, sf_dir):
    return edges_of(artifacts(spark, sf_dir)).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))


@query("u01_edge_union", f"WITH {EDGES_SQL} SELECT src, edge_type, dst FROM edges")
def u01_edge_union(spark, sf_dir):
    return edges_of(artifacts(spark, sf_dir))


@query("a03_stubs", f"WITH {EDGES_SQL} SELECT DISTINCT dst AS id FROM edges WHERE dst NOT IN (SELECT id FROM artifacts UNION SELECT container FROM artifacts)")
def a03_stubs(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    return graph.stubs(edges_of(own), items_of(own))


@query("g09_coherence", f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n FROM edges WHERE dst NOT IN (SELECT id FROM artifacts UNION SELECT container FROM artifacts) GROUP BY edge_type")
def g09_coherence(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    return graph.dangling(edges_of(own), items_of(own)).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("j06_alias_resolution", f"WITH {EDGES_SQL} SELECT 'md5:' || md5(text) AS name, id FROM artifacts GROUP BY ALL")
def j06_alias_resolution(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    return joins.resolved(own.select(F.concat(F.lit("md5:"), F.md5("text")).alias("name")).distinct(), edges_of(own))


@query("f01_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def f01_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("f02_sha512")
def f02_sha512(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 512).alias("sha512"))


@query("f03_gitoid", """SELECT doc_id, """ + ", ".join(f"'gitoid:{k}:{d}:' || {d}('{k} ' || strlen(text) || chr(0) || text) AS {k}_{d}" for k in ("blob", "tree", "commit", "tag") for d in ("sha1", "sha256")) + " FROM documents")
def f03_gitoid(spark, sf_dir):
    own = [identity.gitoid(F.col("text"), k, d).alias(f"{k}_{d}") for k in ("blob", "tree", "commit", "tag") for d in ("sha1", "sha256")]
    return table(spark, sf_dir, "documents").select("doc_id", *own)


@query("f04_all_hashes", "SELECT doc_id, 'gitoid:blob:sha1:' || sha1('blob ' || strlen(text) || chr(0) || text) || ' sha1:' || sha1(text) || ' sha256:' || sha256(text) || ' md5:' || md5(text) AS aliases FROM documents")
def f04_all_hashes(spark, sf_dir):
    own = F.filter(identity.aliases(F.col("text")), lambda a: ~a.startswith("sha512:"))  # SQL has no sha512
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(own, " ").alias("aliases"))


@query("f05_gitoid_path", f"WITH g AS (SELECT doc_id, split_part({GITOID_SQL}, ':', 4) AS h FROM documents) SELECT doc_id, h[1:3] || '/' || h[4:6] || '/' || h[7:] AS path FROM g")
def f05_gitoid_path(spark, sf_dir):
    return artifacts(spark, sf_dir).select("doc_id", F.array_join(identity.path_parts(F.col("id")), "/").alias("path"))


@query("f06_hex16", "SELECT doc_id, lpad(to_hex(doc_id * 1000003), 16, '0') AS hex FROM (SELECT doc_id FROM documents) t".replace("to_hex(doc_id * 1000003)", "lower(to_hex(doc_id * 1000003))"))
def f06_hex16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.hex16(F.col("doc_id") * 1000003).alias("hex"))


@query("f07_positive_long", "SELECT doc_id, CAST(('0x' || (CAST(('0x' || sha256(text)[1]) AS INTEGER) & 7) || sha256(text)[2:16]) AS BIGINT) AS n FROM documents")
def f07_positive_long(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.positive_long(F.sha2("text", 256)).alias("n"))


@query("f16_swhid", "SELECT doc_id, 'swh:1:cnt:' || sha1('blob ' || strlen(text) || chr(0) || text) AS swhid FROM documents")
def f16_swhid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.swhid(identity.gitoid(F.col("text"), "blob", "sha1")).alias("swhid"))


@query("f18_name_uuid")
def f18_name_uuid(spark, sf_dir):
    return artifacts(spark, sf_dir).select("doc_id", identity.name_uuid(F.col("id")).alias("uuid"))


@query("p04_blob_ids", f"WITH {EDGES_SQL} SELECT DISTINCT src AS id FROM edges WHERE src LIKE 'gitoid:blob:sha256:%'")
def p04_blob_ids(spark, sf_dir):
    return edges_of(artifacts(spark, sf_dir)).filter(identity.is_blob(F.col("src"))).select(F.col("src").alias("id")).distinct()


@query("p05_list_contains", f"WITH {EDGES_SQL} SELECT src, dst FROM edges WHERE edge_type = 'contained:down'")
def p05_list_contains(spark, sf_dir):
    return graph.contained(edges_of(artifacts(spark, sf_dir)))


@query("p02_edge_predicates", f"WITH {EDGES_SQL} SELECT edge_type LIKE '%:down' AS is_down, edge_type LIKE 'alias:%' AS is_alias, count(*) AS n FROM edges GROUP BY ALL")
def p02_edge_predicates(spark, sf_dir):
    own = edges_of(artifacts(spark, sf_dir))
    return own.groupBy(F.col("edge_type").endswith(":down").alias("is_down"), F.col("edge_type").startswith("alias:").alias("is_alias")).agg(F.count("*").alias("n"))


@query("p09_block_list", f"""WITH {ARTIFACTS_SQL}, blocked AS (SELECT 'gitoid:blob:sha256:' || sha256('blob ' || strlen(text) || chr(0) || text) AS id FROM documents WHERE lang = 'fr')
SELECT doc_id, id FROM artifacts WHERE id NOT IN (SELECT id FROM blocked)""")
def p09_block_list(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    return filters.unblocked(own, own.filter("lang = 'fr'")).select("doc_id", "id")


@query("p10_expand_once", f"WITH {ARTIFACTS_SQL} SELECT id, min(path) AS path FROM artifacts GROUP BY id")
def p10_expand_once(spark, sf_dir):
    """P10: of equal contents one is opened; the choice is the least path."""
    return artifacts(spark, sf_dir).groupBy("id").agg(F.min("path").alias("path"))


@query("a06_name_map", f"WITH {ARTIFACTS_SQL} SELECT source || '/' || lang AS name, min(id) AS id FROM artifacts WHERE path LIKE '%.txt' GROUP BY 1")
def a06_name_map(spark, sf_dir):
    own = artifacts(spark, sf_dir).filter(F.col("path").endswith(".txt"))
    named = own.select(F.lit("").alias("scope"), F.concat_ws("/", "source", "lang").alias("path"), "id")
    return merge.name_map(named).select(F.col("path").alias("name"), "id")


@query("a08_merkle", """WITH g AS (SELECT DISTINCT conv_id, 'gitoid:blob:sha256:' || sha256('blob ' || strlen(text) || chr(0) || text) AS id FROM conversations),
h AS (SELECT conv_id, unhex(string_agg(split_part(id, ':', 4), '' ORDER BY id)) AS b, count(*) AS n FROM g GROUP BY conv_id)
SELECT conv_id, n, 'gitoid:tree:sha256:' || sha256(encode('tree ' || octet_length(b)) || '\\x00'::BLOB || b) AS tree FROM h""")
def a08_merkle(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", identity.gitoid(F.col("text")).alias("id"))
    return turns.groupBy("conv_id").agg(F.collect_set("id").alias("ids")).select("conv_id", F.size("ids").cast("long").alias("n"), identity.tree_gitoid(F.col("ids")).alias("tree"))


@query("j05_augmentation", f"""WITH {ARTIFACTS_SQL} SELECT DISTINCT a.id, 'quality' AS key, CAST(l.quality AS VARCHAR) AS value
FROM artifacts a JOIN artifacts b ON a.id = b.id AND a.container = b.container JOIN labels l ON l.doc_id = b.doc_id""")
def j05_augmentation(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    changes = own.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("container").alias("scope"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"), F.lit("quality").alias("key"), F.col("quality").cast("string").alias("value"))
    aliases = own.select("id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash")).distinct()
    return joins.augmented(aliases, own.select("id", F.col("container").alias("scope")).distinct(), changes)


@query("a16_augment_merge", f"WITH {ARTIFACTS_SQL} SELECT id, array_to_string(list_sort(list(quality || ':' || toxic)), ',') AS changes FROM artifacts JOIN labels USING (doc_id) GROUP BY id")
def a16_augment_merge(spark, sf_dir):
    own = artifacts(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    found = merge.changes_by_hash(own.select(F.col("id").alias("hash"), F.col("quality").cast("string").alias("key"), F.col("toxic").cast("string").alias("value")))
    return found.select(F.col("hash").alias("id"), F.array_join("changes", ",").alias("changes"))


LINES_SQL = "lines AS (SELECT DISTINCT doc_id AS src, x AS dst FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) t WHERE length(x) > 20)"


def lines(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.explode(F.split("text", "\n")).alias("dst"))
    return own.filter(F.length("dst") > 20).distinct()


@query("j13_shared_lines", f"WITH {LINES_SQL} SELECT md5(dst) AS line, count(*) AS holders FROM lines GROUP BY dst HAVING count(*) >= 2")
def j13_shared_lines(spark, sf_dir):
    return joins.shared(lines(spark, sf_dir)).select(F.md5("dst").alias("line"), "holders")


@query("j14_markers", f"""WITH {LINES_SQL}, marks AS (SELECT min(src) AS src, dst FROM lines GROUP BY dst HAVING count(*) = 1),
size AS (SELECT src, count(*) AS size FROM marks GROUP BY src)
SELECT l.src AS holder, m.src AS of, count(*) AS found, count(*) / any_value(s.size) AS share FROM lines l JOIN marks m USING (dst) JOIN size s ON s.src = m.src GROUP BY l.src, m.src""")
def j14_markers(spark, sf_dir):
    own = lines(spark, sf_dir)
    return joins.overlap(own, joins.markers(own))


@query("j12_footprint", "SELECT d.doc_id AS id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j12_footprint(spark, sf_dir):
    """Documents that hold a benchmark text whole."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return joins.holding(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")))


@query("o01_md5_sort", f"WITH {EDGES_SQL} SELECT src AS id, md5(src) AS id_md5 FROM edges GROUP BY src")
def o01_md5_sort(spark, sf_dir):
    """The order of the written graph: ranges of the identifiers' digests, sorted within partitions."""
    own = edges_of(artifacts(spark, sf_dir)).select(F.col("src").alias("id")).distinct().withColumn("id_md5", F.md5("id"))
    return own.repartitionByRange("id_md5").sortWithinPartitions("id_md5")


@query("o02_key_sort", f"WITH {ARTIFACTS_SQL} SELECT DISTINCT id FROM artifacts ORDER BY id")
def o02_key_sort(spark, sf_dir):
    return artifacts(spark, sf_dir).select("id").distinct().orderBy("id")


@query("o05_shards", f"WITH {ARTIFACTS_SQL} SELECT md5(id)[1:2] AS shard, count(DISTINCT id) AS n FROM artifacts GROUP BY 1")
def o05_shards(spark, sf_dir):
    return artifacts(spark, sf_dir).select("id").distinct().groupBy(F.substring(F.md5("id"), 1, 2).alias("shard")).agg(F.count("*").alias("n"))


@query("k06_root_dump", "SELECT DISTINCT 'source:' || source AS id FROM documents")
def k06_root_dump(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    return graph.roots(items_of(own), edges_of(own)).select("id")


@query("t02_run_tag", f"WITH {ARTIFACTS_SQL} SELECT DISTINCT container AS src, 'tag:from' AS edge_type, 'tag:run-1' AS dst FROM artifacts UNION SELECT DISTINCT 'tag:run-1', 'tag:to', container FROM artifacts UNION SELECT 'tag:run-1', 'tag:from', 'tags' UNION SELECT 'tags', 'tag:to', 'tag:run-1'")
def t02_run_tag(spark, sf_dir):
    tops = artifacts(spark, sf_dir).select(F.col("container").alias("id")).distinct()
    _, edges = tags.tagged(spark, tops, ("tag:run-1", "{}"))
    return graph.with_reversed(edges)


@query("w04_first_of_name", f"WITH {ARTIFACTS_SQL} SELECT source, lang, min(path) AS path FROM artifacts GROUP BY source, lang")
def w04_first_of_name(spark, sf_dir):
    own = artifacts(spark, sf_dir).select(F.col("source").alias("scope"), F.col("lang").alias("path"), F.col("path").alias("id"))
    return merge.name_map(own).select(F.col("scope").alias("source"), F.col("path").alias("lang"), F.col("id").alias("path"))


@query("u04_cluster_merge", f"WITH {ARTIFACTS_SQL} SELECT id, max(size) AS file_size, count(DISTINCT path) AS n_names FROM artifacts GROUP BY id UNION ALL SELECT container, 0, 1 FROM artifacts GROUP BY container")
def u04_cluster_merge(spark, sf_dir):
    """Two halves built apart and merged equal the whole."""
    own = artifacts(spark, sf_dir)
    halves = [own.filter(F.col("doc_id") % 2 == i) for i in (0, 1)]
    items, _ = merge.merged_clusters(*((items_of(h), edges_of(h)) for h in halves))
    return items.select("id", "file_size", F.size("file_names").cast("long").alias("n_names"))


@query("p11_binary_text", "SELECT doc_id, length(text) > 0 AND (length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f\\x7f]', '', 'g'))) / length(text) > 0.1 AS is_binary FROM documents")
def p11_binary_text(spark, sf_dir):
    from ..functions.textual import is_binary

    return table(spark, sf_dir, "documents").select("doc_id", is_binary(F.col("text")).alias("is_binary"))


@query("a14_failures", "SELECT source || '/' || lang AS folder, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1 ORDER BY n DESC, folder LIMIT 10")
def a14_failures(spark, sf_dir):
    """The folders with most failures; low-quality documents stand for failures."""
    bad = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")
    return merge.failures(bad.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))


@query("w03_first_ref", f"WITH {ARTIFACTS_SQL} SELECT container, lang AS ref, min(doc_id) AS doc_id FROM artifacts GROUP BY container, lang")
def w03_first_ref(spark, sf_dir):
    own = artifacts(spark, sf_dir)
    found = own.select(F.col("container").alias("root"), F.col("doc_id").alias("id"), F.lit(0).alias("depth"))
    parts = own.select(F.col("doc_id").alias("id"), F.col("lang").alias("ref"), F.lit(0).alias("place"), F.col("doc_id").alias("component"))
    return bills.of_roots(found, parts).select(F.col("root").alias("container"), "ref", F.col("component").alias("doc_id"))
