import pytest
from pyspark.sql import functions as F

from ledgerloom.model import METADATA_BODY, TAG_BODY
from ledgerloom.operators import graph, joins, merge
from ledgerloom.operators.filters import IncludeExclude
from ledgerloom.operators.tags import package_tags, run_tag, tagged

E = "src string, edge_type string, dst string"


def edges(spark, *rows):
    return spark.createDataFrame(rows, E)


def triples(df):
    return {tuple(r) for r in df.select("src", "edge_type", "dst").collect()}


def test_only_four_types_are_reversed(spark):
    own = [("a", "alias:from", "b"), ("a", "contained:up", "c"), ("a", "build:down", "d"), ("a", "tag:from", "e"), ("a", "contained:down", "f"), ("a", "alias:from", "b")]
    assert triples(graph.with_reversed(edges(spark, *own))) == set(own) | {("b", "alias:to", "a"), ("c", "contained:down", "a"), ("d", "build:up", "a"), ("e", "tag:to", "a")}


def test_roots(spark):
    items = spark.createDataFrame([("plain", METADATA_BODY), ("alias", METADATA_BODY), ("held", METADATA_BODY), ("tags", METADATA_BODY), ("tag", TAG_BODY), ("stub", None)], "id string, body_mime string")
    own = edges(spark, ("alias", "alias:to", "x"), ("held", "contained:up", "y"), ("plain", "contained:down", "held"))
    assert [r.id for r in graph.roots(items, own).collect()] == ["plain"]


@pytest.mark.parametrize(("mtimes", "left"), [({"old": 1, "new": 9, "C": None, "A": None, "U": 1}, {"old", "U"}), ({"old": 1, "new": 1, "C": None, "A": None, "U": 1}, {"old", "new", "C", "A", "U"}), ({"old": 1, "new": 5, "C": 5, "A": None, "U": None}, {"old", "new", "C", "A", "U"})])
def test_cutoff(spark, mtimes, left):
    """old and new are in C; A is built from new; U stands alone; the cutoff is 5, and only later goes."""
    own = graph.with_reversed(edges(spark, ("old", "contained:up", "C"), ("new", "contained:up", "C"), ("A", "build:down", "new")))
    items = spark.createDataFrame(list(mtimes.items()), "id string, mtime long")
    kept, rest = graph.pruned(items, own, F.col("mtime") > 5)
    assert {r.id for r in kept.collect()} == left
    assert all(s in left and d in left for s, _, d in triples(rest))
    assert graph.dangling(rest, kept).count() == 0


def test_reach_walks_cycles_and_shared_nodes_once(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("r", "a")], "root string, id string")
    got = lambda depth=None: {(r.id, r.depth) for r in graph.reach(seeds, steps, depth).collect()}
    assert got() == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert got(1) == {("a", 0), ("b", 1), ("c", 1)}
    assert graph.reach(seeds.limit(0), steps).count() == 0


def test_merge_is_a_union_whatever_the_order(spark):
    rows = [("a", METADATA_BODY, ["y"], ["t"], 5), ("a", None, ["x"], [], 0), ("b", METADATA_BODY, [], ["u"], None), ("a", METADATA_BODY, ["y"], ["t"], 5)]
    schema = "id string, body_mime string, file_names array<string>, mime_types array<string>, file_size long"
    one = merge.merged_items(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, merge.merged_items(spark.createDataFrame(rows[::-1], schema)).collect())) == sorted(map(tuple, merge.merged_items(one).collect()))
    assert {r.id: (r.file_names, r.mime_types, r.file_size) for r in one.collect()} == {"a": (["x", "y"], ["t"], 5), "b": ([], ["u"], None)}


def test_names_are_qualified_where_there_are_several(spark):
    df = spark.createDataFrame([("a", "x", "p"), ("a", "y", "p"), ("b", "z", "p"), ("b", "z", None)], "id string, value string, parent string")
    assert {tuple(r) for r in merge.qualified_names(df).collect()} == {("a", "x"), ("a", "y"), ("a", "p/x"), ("a", "p/y"), ("b", "z")}


def test_earliest_ignores_what_is_no_plain_number(spark):
    k = "file_modified_epoch_millis"
    df = spark.createDataFrame([("a", k, None, "9"), ("a", k, None, "3"), ("a", k, "m", "1"), ("a", k, None, "x"), ("b", "other", None, "1")], "id string, key string, mime string, value string")
    assert [tuple(r) for r in merge.earliest(df).collect()] == [("a", 3)]


def test_include_exclude(spark):
    sets = [["a"], ["bad"], ["bad", "good"], [], ["badly"], ["bad", "gooey"]]
    df = spark.createDataFrame([(s,) for s in sets], "types array<string>")
    kept = [r.types for r in df.filter(IncludeExclude(["# c", "", "/bad", "+good", "*goo.y"]).passes(F.col("types"))).collect()]
    assert kept == [["a"], ["bad", "good"], [], ["badly"], ["bad", "gooey"]]
    assert df.filter(IncludeExclude([]).passes(F.col("types"))).count() == len(sets)
    with pytest.raises(ValueError):
        IncludeExclude(["?x"])


def test_primary_prefers_score_then_length(spark):
    df = spark.createDataFrame([("j", "spring-core", "spring", "g", "1"), ("j", "spring-core", "spring-core", "g", "1"), ("k", "a-b-c", "a-b", "g", "1"), ("k", "a-b-c", "a", "g", "1"), ("l", "x", "zzz", "g", "1")], "jar string, name string, artifact_id string, group_id string, version string")
    assert {(r.jar, r.artifact_id) for r in joins.primary(df).collect()} == {("j", "spring-core"), ("k", "a-b")}


def test_needles(spark):
    texts = spark.createDataFrame([(1, "EVP_sha256 and EVP_md5"), (2, None), (3, "")], "id int, text string")
    assert {tuple(r) for r in joins.needles_in(texts, ["EVP_sha256", "EVP_md5", "nope"]).collect()} == {(1, "EVP_sha256"), (1, "EVP_md5")}
    needles = spark.createDataFrame([(i, "x" * 40 + str(i)) for i in range(30)] + [(99, "ab")], "item_id int, needle string")
    own = spark.createDataFrame([(1, "qq" + "x" * 40 + "7 tail"), (2, "cab"), (3, "x" * 50)], "id int, text string")
    want = {(1, 7), (2, 99)}
    assert {tuple(r) for r in joins.holding(own, needles).collect()} == want == {tuple(r) for r in joins.holding(own, needles, most=3).collect()}


def test_tags(spark):
    assert run_tag("a", "d")[1] == '{"tag":"a","date":"d"}'
    assert run_tag("a", "d", "1", '{"tag":"b"}')[1] == '{"tag":"b","date":"d","version":"1"}'
    assert run_tag("a", "d", None, "[1]")[1] == '{"tag":"a","date":"d","extra":[1]}'
    items, own = tagged(spark, spark.createDataFrame([("x",)], "id string"), run_tag("a", "d"))
    tag = run_tag("a", "d")[0]
    assert triples(own) == {("x", "tag:from", tag), (tag, "tag:from", "tags")} and items.count() == 2
    items, own = package_tags(spark.createDataFrame([("i", "g/n:a", "1", "d")], "id string, name string, version string, date string"))
    assert '"simple_name":"a"' in items.first().tag and own.count() == 2
