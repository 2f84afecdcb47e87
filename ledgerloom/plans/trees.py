"""Queries over the tables as containment trees, packages and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, joins, merge, strategies
from ..operators.filters import IncludeExclude, not_archive, not_compressed, of_types, scan_filtered
from .base import TREE_SQL, picked, picked_sql, query, table, tree


def region_roots(spark, sf_dir):
    own = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("root"))
    return own.select("root", F.col("root").alias("id"))


@query("g02_crypto_bfs", f"""WITH RECURSIVE {TREE_SQL}, walk AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS id, 0 AS depth FROM region
UNION SELECT w.root, t.dst, w.depth + 1 FROM walk w JOIN tree t ON w.id = t.src WHERE w.depth < 32)
SELECT root, depth, count(*) AS n FROM walk WHERE NOT starts_with(id, 'L') OR id LIKE '%-1' GROUP BY ALL""")
def g02_crypto_bfs(spark, sf_dir):
    """Breadth-first search down to 32 levels from each root; first lines of orders stand for crypto items."""
    found = graph.reach(region_roots(spark, sf_dir), tree(spark, sf_dir), 32)
    return found.filter(~F.col("id").startswith("L") | F.col("id").endswith("-1")).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("g01_levels", f"""WITH RECURSIVE {TREE_SQL}, walk AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS id, 0 AS depth FROM region
UNION SELECT w.root, t.dst, w.depth + 1 FROM walk w JOIN tree t ON w.id = t.src) SELECT id, root, depth FROM walk""")
def g01_levels(spark, sf_dir):
    return graph.reach(region_roots(spark, sf_dir), tree(spark, sf_dir)).select("id", "root", "depth")


@query("g07_paths", f"""WITH RECURSIVE {TREE_SQL}, walk AS (SELECT 'R' || r_regionkey AS id, 'R' || r_regionkey AS path, 0 AS depth FROM region
UNION ALL SELECT t.dst, w.path || '>' || t.dst, w.depth + 1 FROM walk w JOIN tree t ON w.id = t.src WHERE w.depth < 4)
SELECT id, path FROM walk""")
def g07_paths(spark, sf_dir):
    return graph.paths(region_roots(spark, sf_dir).select("id"), tree(spark, sf_dir), 4)


@query("g08_scopes", f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT 'O' || o_orderkey AS id, 'O' || o_orderkey AS scope FROM orders
UNION SELECT u.id, t.src FROM up u JOIN tree t ON u.scope = t.dst) SELECT id, scope FROM up""")
def g08_scopes(spark, sf_dir):
    """The chain of containers that see each order."""
    up = tree(spark, sf_dir).filter(~F.col("dst").startswith("L")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("root"))
    return graph.reach(seeds.select("root", F.col("root").alias("id")), up).select(F.col("root").alias("id"), F.col("id").alias("scope"))


MTIME_SQL = "mtimes AS (SELECT 'L' || l_orderkey || '-' || l_linenumber AS id, min(epoch_ms(l_shipdate)) AS mtime FROM lineitem GROUP BY 1)"


@query("a07_earliest_mtime", f"WITH {MTIME_SQL} SELECT id, mtime FROM mtimes")
def a07_earliest_mtime(spark, sf_dir):
    return mtimes(spark, sf_dir)


def mtimes(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.lit("file_modified_epoch_millis").alias("key"), F.lit(None).cast("string").alias("mime"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("string").alias("value"))
    return merge.earliest(own)


@query("g03_cutoff_prune", f"""WITH RECURSIVE {TREE_SQL}, {MTIME_SQL}, gone AS (SELECT id FROM mtimes WHERE mtime > epoch_ms(TIMESTAMP '2001-11-02')
UNION SELECT t.src FROM gone g JOIN tree t ON g.id = t.dst), nodes AS (SELECT src AS id FROM tree UNION SELECT dst FROM tree)
SELECT left(id, 1) AS kind, count(*) AS kept FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1""")
def g03_cutoff_prune(spark, sf_dir):
    """Items later than the cutoff go, with all that contains them."""
    down = tree(spark, sf_dir)
    edges = down.select(F.col("dst").alias("src"), F.lit("contained:up").alias("edge_type"), F.col("src").alias("dst"))
    nodes = down.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(mtimes(spark, sf_dir), "id", "left")
    kept, _ = graph.pruned(nodes, edges, F.col("mtime") > F.unix_millis(F.lit("2001-11-02").cast("timestamp")))
    return kept.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("kept"))


@query("a13_in_degree", "SELECT 'P' || l_partkey AS id, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1 ORDER BY degree DESC, id LIMIT 50")
def a13_in_degree(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.lit("contained:up").alias("edge_type"), F.concat(F.lit("O"), "l_orderkey").alias("dst"))
    return graph.in_degree(own.distinct())


@query("j13_shared_parts", "SELECT 'P' || l_partkey AS dst, count(DISTINCT l_orderkey) AS holders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def j13_shared_parts(spark, sf_dir):
    return joins.shared(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")))


RULES = ("# event types that count", "-click", "/err.*", "+purchase", "*sign.*")


@query("p03_include_exclude", """WITH sets AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY user_id)
SELECT user_id FROM sets WHERE len(list_filter(types, lambda m: m = 'click' OR regexp_full_match(m, 'err.*'))) = 0 OR len(list_filter(types, lambda m: m = 'purchase' OR regexp_full_match(m, 'sign.*'))) > 0""")
def p03_include_exclude(spark, sf_dir):
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return sets.filter(IncludeExclude(RULES).passes(F.col("types"))).select("user_id")


TYPES = ("text/plain", "application/zip", "image/png", "application/java-vm", "application/x-rpm", "application/octet-stream", "application/vnd.android.package-archive")
TYPES_SQL = f"list_distinct([{picked_sql('p_partkey', TYPES)}, {picked_sql('p_size', TYPES[1:])}])"


def typed_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.array(picked("p_partkey", TYPES), picked("p_size", TYPES[1:]))).alias("types"))


@query("s12_not_archive", f"""WITH t AS (SELECT p_partkey, {TYPES_SQL} AS types FROM part)
SELECT p_partkey, len(list_filter(types, lambda m: starts_with(m, 'text/') OR starts_with(m, 'image/'))) > 0 OR len(list_filter(types, lambda m: m NOT IN ('text/plain', 'image/png', 'application/java-vm', 'application/octet-stream'))) = 0 AS not_archive FROM t""")
def s12_not_archive(spark, sf_dir):
    return typed_parts(spark, sf_dir).select("p_partkey", not_archive(F.col("types")).alias("not_archive"))


@query("s13_not_compressed", f"""WITH t AS (SELECT p_partkey, {TYPES_SQL} AS types FROM part)
SELECT p_partkey, len(list_filter(types, lambda m: starts_with(m, 'text/') OR starts_with(m, 'image/') OR m = 'application/vnd.android.package-archive')) > 0 AS not_compressed FROM t""")
def s13_not_compressed(spark, sf_dir):
    return typed_parts(spark, sf_dir).select("p_partkey", not_compressed(F.col("types")).alias("not_compressed"))


@query("u02_type_overlap", f"WITH t AS (SELECT p_partkey, {TYPES_SQL} AS types FROM part) SELECT p_partkey FROM t WHERE list_has_any(types, ['application/zip', 'application/x-rpm'])")
def u02_type_overlap(spark, sf_dir):
    return of_types(typed_parts(spark, sf_dir).withColumnRenamed("types", "mime"), "application/zip", "application/x-rpm").select("p_partkey")


@query("s03_scan_filter", """WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), i AS (SELECT path FROM p WHERE path LIKE '%.html')
SELECT path FROM p WHERE NOT starts_with(split_part(path, '/', -1), '.') AND NOT regexp_matches(split_part(path, '/', -1), 'page=2|[0-9]7') AND path NOT IN (SELECT path FROM i)""")
def s03_scan_filter(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    return scan_filtered(own, own.filter(F.col("path").endswith(".html")), "page=2|[0-9]7").select("path")


@query("s04_base_names", "SELECT page_id, split_part(url, '/', -1) AS name FROM pages")
def s04_base_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("name"))


DIRTY = ("./", "../", "/", ".././/", "", "a/")


@query("s05_clean_path", f"SELECT p_partkey, regexp_replace({picked_sql('p_partkey', DIRTY)} || p_name, '^(\\./|/|\\.\\./)+', '') AS path FROM part")
def s05_clean_path(spark, sf_dir):
    from ..functions.packages import clean_path

    return table(spark, sf_dir, "part").select("p_partkey", clean_path(F.concat(picked("p_partkey", DIRTY), "p_name")).alias("path"))


CLAIMED = ("repo/a-1.0.jar", "x/pom.xml", "etc/shadow", "home/.ssh/authorized_keys", "etc/nginx.conf", "etc/openvpn/a.conf", "requirements.txt", "gradle.lockfile", "n/package.json", "app/Info.plist", "readme.md")


@query("j01_claims", f"""SELECT event_id, CASE WHEN value > 50 AND regexp_matches(path, 'requirements|gradle|Info|readme') THEN 'crypto-footprint' WHEN regexp_matches(path, 'jar|pom') THEN 'maven' WHEN path = 'etc/shadow' THEN 'shadow' WHEN path LIKE '%keys' THEN 'ssh'
WHEN path LIKE '%nginx%' THEN 'service-tls' WHEN path LIKE '%openvpn%' THEN 'service-crypto' WHEN path LIKE 'req%' THEN 'crypto-dependency' WHEN path LIKE 'gradle%' THEN 'gradle' WHEN path LIKE '%json' THEN 'language-package' WHEN path LIKE '%plist' THEN 'mobile-tls' ELSE 'generic' END AS strategy
FROM (SELECT event_id, value, {picked_sql('event_id', CLAIMED)} AS path FROM events) t""")
def j01_claims(spark, sf_dir):
    """Events as files: the chain's first strategy takes each; texts that name a library's functions come before those behind it."""
    text = F.when(F.col("value") > 50, "return EVP_sha256();").otherwise(F.col("event_type"))
    files = table(spark, sf_dir, "events").select("event_id", picked("event_id", CLAIMED).alias("path"), F.array(F.lit("text/plain")).alias("mime"), text.alias("text"))
    return strategies.claims(files).select("event_id", "strategy")


@query("u03_residual", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def u03_residual(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return joins.residual(own, own.filter("event_id % 97 = 0"), "user_id").select("event_id")


NAMES = (".jar", ".pom", "-sources.jar", "-javadoc.jar", ".war", ".txt")
FILES_SQL = f"files AS (SELECT DISTINCT 'repo/' || p_brand || '/a' || (p_partkey // 6) || {picked_sql('p_partkey', NAMES)} AS path FROM part UNION SELECT DISTINCT 'repo/' || p_brand || '/maven-metadata.xml' FROM part WHERE p_partkey % 5 = 0)"


def part_files(spark, sf_dir):
    own = table(spark, sf_dir, "part")
    folder = F.concat(F.lit("repo/"), "p_brand")
    one = own.select(F.concat(folder, F.lit("/a"), F.floor(F.col("p_partkey") / 6), picked("p_partkey", NAMES)).alias("path"))
    return one.unionByName(own.filter("p_partkey % 5 = 0").select(F.concat(folder, F.lit("/maven-metadata.xml")).alias("path"))).distinct()


@query("j02_companions", f"""WITH {FILES_SQL}, a AS (SELECT path, regexp_replace(path, '[.][^.]*$', '') AS stem, regexp_replace(path, '[^/]*$', '') AS folder FROM files
WHERE regexp_matches(path, '[.](jar|war)$') AND NOT regexp_matches(path, '-(sources|javadoc)[.]jar$'))
SELECT a.path, p.path AS pom, s.path AS sources, j.path AS javadoc, m.path AS metadata FROM a
LEFT JOIN files p ON p.path = stem || '.pom' LEFT JOIN files s ON s.path = stem || '-sources.jar' LEFT JOIN files j ON j.path = stem || '-javadoc.jar' LEFT JOIN files m ON m.path = folder || 'maven-metadata.xml'""")
def j02_companions(spark, sf_dir):
    return joins.companions(part_files(spark, sf_dir)).select("path", "pom", "sources", "javadoc", "metadata")


@query("j07_include_resolution", f"""WITH {FILES_SQL}, w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'repo/' || p_brand || '/a' || (p_partkey // 6) || '.jar' ELSE 'a' || (p_partkey // 3) || '.pom' END AS reference FROM part)
SELECT w.id, w.reference, coalesce((SELECT f.path FROM files f WHERE f.path = w.reference), (SELECT min(f.path) FROM files f WHERE split_part(f.path, '/', -1) = split_part(w.reference, '/', -1))) AS path FROM w""")
def j07_include_resolution(spark, sf_dir):
    return joins.references(wanted(spark, sf_dir), part_files(spark, sf_dir)).select("id", "reference", "path")


def wanted(spark, sf_dir):
    exact = F.concat(F.lit("repo/"), "p_brand", F.lit("/a"), F.floor(F.col("p_partkey") / 6), F.lit(".jar"))
    base = F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 3), F.lit(".pom"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, exact).otherwise(base).alias("reference"))


@query("j08_reference_edges", f"""WITH {FILES_SQL}, w AS (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'repo/' || p_brand || '/a' || (p_partkey // 6) || '.jar' ELSE 'a' || (p_partkey // 3) || '.pom' END AS reference FROM part),
r AS (SELECT w.p_brand, coalesce((SELECT f.path FROM files f WHERE f.path = w.reference), (SELECT min(f.path) FROM files f WHERE split_part(f.path, '/', -1) = split_part(w.reference, '/', -1))) AS path FROM w)
SELECT p_brand AS container, array_to_string(list_sort(list(DISTINCT path)), ',') AS associated_files FROM r WHERE path IS NOT NULL GROUP BY p_brand""")
def j08_reference_edges(spark, sf_dir):
    named = wanted(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    found = joins.references(named, part_files(spark, sf_dir)).filter("path is not null")
    return found.groupBy(F.col("p_brand").alias("container")).agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("associated_files"))


@query("a02_extra_union", "SELECT user_id AS id, event_type AS key, json_extract_string(props, '$.k') AS value FROM events GROUP BY ALL")
def a02_extra_union(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("key"), F.lit(None).cast("string").alias("mime"), F.get_json_object("props", "$.k").alias("value"))
    return merge.merged_extra(own).select("id", "key", "value")


@query("a10_dependency_groups", "SELECT user_id, event_type AS name, array_to_string(list_sort(list(DISTINCT json_extract_string(props, '$.k'))), ',') AS versions, count(*) AS n FROM events GROUP BY ALL")
def a10_dependency_groups(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    found = merge.dependency_groups(own.select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("version")))
    return found.select(F.col("id").alias("user_id"), "name", F.array_join("versions", ",").alias("versions"), "n")


@query("a11_line_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT w)), ',') AS words FROM (SELECT source, unnest(regexp_extract_all(text, '(token|password|secret) ?[=:]', 1)) AS w FROM documents) t GROUP BY source")
def a11_line_sets(spark, sf_dir):
    found = merge.line_sets(table(spark, sf_dir, "documents").select(F.col("source").alias("id"), "text"), "(token|password|secret) ?[=:]")
    return found.select(F.col("id").alias("source"), F.array_join("values", ",").alias("words"))
