"""Queries of configuration files: parts written as sections and files, read by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inifiles
from .base import query, table

# Twenty parts are the sections of one file; some point to another section, which may lead back.
SECTIONS_SQL = """parts AS (SELECT p_partkey // 20 AS f, p_partkey % 20 AS n, p_size, p_brand FROM part),
steps AS (SELECT a.f, a.n AS src, b.n AS dst FROM parts a JOIN parts b ON a.f = b.f AND b.n = (a.n * 7 + 3) % 20 WHERE a.n % 3 <> 0)"""


def ini_files(spark, sf_dir):
    n, size = F.col("p_partkey") % 20, F.col("p_size")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("[ s"), n, F.lit(" ]")), F.lit("; note = 1"), F.when(n % 3 != 0, F.concat(F.lit("System_Default = s"), (n * 7 + 3) % 20)), F.when(n % 5 == 0, F.concat(F.lit("MinProtocol = TLSv1."), size % 4)),
        F.when(n % 7 == 0, F.lit("CIPHERSTRING = AES128-SHA:HIGH")), F.when(n % 4 == 1, F.concat(F.lit("Options = o"), size % 3, F.lit(" , x"))), F.when(n % 5 == 0, F.concat(F.lit(".include !/etc/"), n, F.lit(".cnf"))),
    )
    own = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).cast("string").alias("id"), F.struct(n.alias("n"), lines.alias("t")).alias("part"))
    return own.groupBy("id").agg(F.concat(F.lit("before = any\n"), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), "\r\n")).alias("text"))


@query("g04_section_pointers", f"""WITH RECURSIVE {SECTIONS_SQL}, walk AS (SELECT f, n AS root, n AS s, 0 AS d FROM parts UNION SELECT w.f, w.root, t.dst, w.d + 1 FROM walk w JOIN steps t ON w.f = t.f AND w.s = t.src WHERE w.d < 9)
SELECT DISTINCT CAST(f AS VARCHAR) AS id, 's' || root AS root, 's' || s AS section FROM walk""")
def g04_section_pointers(spark, sf_dir):
    """The sections that each section of a file leads to."""
    return inifiles.reached(inifiles.section_rows(ini_files(spark, sf_dir)))


@query("f48_openssl_facts", f"""WITH RECURSIVE {SECTIONS_SQL}, walk AS (SELECT f, n AS root, n AS s, 0 AS d FROM parts UNION SELECT w.f, w.root, t.dst, w.d + 1 FROM walk w JOIN steps t ON w.f = t.f AND w.s = t.src WHERE w.d < 9),
wanted AS (SELECT f, n FROM parts WHERE n % 5 = 0 OR n % 7 = 0 OR n % 4 = 1), starts AS (SELECT DISTINCT w.f, w.root FROM walk w JOIN wanted x ON w.f = x.f AND w.s = x.n),
live AS (SELECT DISTINCT w.f, w.s AS n FROM walk w JOIN starts USING (f, root)), own AS (SELECT parts.* FROM parts JOIN live USING (f, n))
SELECT CAST(f AS VARCHAR) AS id, 'sections' AS key, 's' || n AS value FROM own UNION SELECT CAST(f AS VARCHAR), 'min_protocol', 'TLSv1.' || arg_max(p_size % 4, n) FROM own WHERE n % 5 = 0 GROUP BY f
UNION SELECT CAST(f AS VARCHAR), 'cipher_string', 'AES128-SHA:HIGH' FROM own WHERE n % 7 = 0 UNION SELECT CAST(f AS VARCHAR), 'algorithms', 'aes-128-cbc' FROM own WHERE n % 7 = 0
UNION SELECT CAST(f AS VARCHAR), 'options', unnest(['o' || p_size % 3, 'x']) FROM own WHERE n % 4 = 1""")
def f48_openssl_facts(spark, sf_dir):
    rows = inifiles.section_rows(ini_files(spark, sf_dir))
    found = inifiles.security_facts(rows, inifiles.active(rows))
    return found.filter("key <> 'algorithms' or value = 'aes-128-cbc'")


def security_files(spark, sf_dir, circles: bool):
    """Parts as files of one scope for each forty: files (scope, path, id) and texts (id, text)."""
    k = F.col("p_partkey")
    n = k % 40
    targets = [(n * 7 + 3) % 40, (n * 3 + 1) % 40] if circles else [F.floor(n / 2), F.floor(n / 3)]
    text = F.concat_ws("\n", F.concat(F.lit("jdk.tls.disabledAlgorithms=A"), F.col("p_size") % 7, F.lit(", \\\n  B"), F.col("p_size") % 5), F.when(n % 4 == 0, F.concat(F.lit("jdk.tls.ephemeralDHKeySize = "), F.lit(1000) + n)),
        *(F.when(n > 0, F.concat(F.lit("include <file:/other/place/"), F.lpad(t.cast("string"), 2, "0"), F.lit(".security>"))) for t in targets))
    own = table(spark, sf_dir, "part").select(F.floor(k / 40).cast("string").alias("scope"), F.concat(F.lit("conf/"), F.lpad(n.cast("string"), 2, "0"), F.lit(".security")).alias("path"), k.cast("string").alias("id"), text.alias("text"))
    return own.select("scope", "path", "id"), own.select("id", "text")


@query("g05_include_layers", """WITH RECURSIVE p AS (SELECT p_partkey // 40 AS s, p_partkey % 40 AS n FROM part), steps AS (SELECT a.s, a.n AS src, b.n AS dst FROM p a JOIN p b ON a.s = b.s AND (b.n = a.n // 2 OR b.n = a.n // 3) WHERE a.n > 0 AND a.n <> b.n),
walk AS (SELECT s, n AS root, n AS at, 0 AS d FROM p UNION SELECT w.s, w.root, t.dst, w.d + 1 FROM walk w JOIN steps t ON w.s = t.s AND w.at = t.src)
SELECT CAST(s AS VARCHAR) AS scope, 'conf/' || lpad(CAST(root AS VARCHAR), 2, '0') || '.security' AS path, CAST(max(d) AS INTEGER) AS layer FROM walk GROUP BY s, root""")
def g05_include_layers(spark, sf_dir):
    """Files above all that they include."""
    files, texts = security_files(spark, sf_dir, circles=False)
    return inifiles.layers(files, inifiles.include_edges(files, inifiles.java_includes(texts)))


@query("a12_effective_config", """WITH p AS (SELECT p_partkey, p_partkey // 40 AS s, p_partkey % 40 AS n, p_size FROM part), e AS (SELECT a.p_partkey, b.n, b.p_size, a.n = b.n AS own FROM p a JOIN p b ON a.s = b.s AND (b.n = a.n OR a.n > 0 AND (b.n = (a.n * 7 + 3) % 40 OR b.n = (a.n * 3 + 1) % 40)))
SELECT CAST(p_partkey AS VARCHAR) AS id, 'disabled_algorithms' AS key, unnest(['A' || p_size % 7, 'B' || p_size % 5]) AS value FROM e UNION SELECT CAST(p_partkey AS VARCHAR), 'ephemeral_dh_key_size', CAST(arg_max(1000 + n, (own, n)) AS VARCHAR) FROM e WHERE n % 4 = 0 GROUP BY p_partkey""")
def a12_effective_config(spark, sf_dir):
    """Lists united along includes, which may go in circles; a file's own size before those of what it includes."""
    files, texts = security_files(spark, sf_dir, circles=True)
    return inifiles.effective(files, inifiles.java_properties(texts), inifiles.include_edges(files, inifiles.java_includes(texts)))
