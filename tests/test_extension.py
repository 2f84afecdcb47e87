import hashlib
import json

from pyspark.sql import functions as F

from ledgerloom.builder import GraphBuilder


def test_own_strategies_types_and_augmentation(spark, tmp_path):
    """A strategy of the caller's takes files before the built-in ones; scanners and changes add to what a hash names."""
    (tmp_path / "in").mkdir()
    recipe, other = b"recipe: soup 2.1\nwater\n", b"plain words"
    for name, data in {"soup.recipe": recipe, "etc.requirements.txt": other, "requirements.txt": b"cryptography==41\n"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    sha = hashlib.sha256(other).hexdigest()
    report = {"artifacts": [{"id": "p", "name": "n", "version": "1", "type": "java", "purl": "pkg:maven/g/n@1"}], "files": [{"id": "f", "location": {"path": "/x"}, "digests": [{"algorithm": "SHA256", "value": sha.upper()}]}], "artifactRelationships": [{"parent": "p", "child": "f", "type": "contains"}]}
    (tmp_path / "report.json").write_text(json.dumps(report))
    gitoid = "gitoid:blob:sha256:" + hashlib.sha256(b"blob %d\0" % len(recipe) + recipe).hexdigest()
    changes = spark.createDataFrame([(gitoid, "Reviewed", "yes"), ("sha256:" + "0" * 64, "Reviewed", "no")], "hash string, key string, value string")

    def extractor(taken):
        word = lambda n: F.regexp_extract("text", r"^recipe: (\S+) (\S+)", n)
        facts = taken.select("id", F.lit("Dish").alias("key"), F.lit(None).cast("string").alias("mime"), word(1).alias("value"))
        return facts, taken.select("id", F.concat(F.lit("pkg:generic/"), word(1), F.lit("@"), word(2)).alias("purl"))

    builder = GraphBuilder(spark).with_folder(str(tmp_path / "in")).with_augmentation(changes).with_scanner_reports(str(tmp_path / "report.json"))
    builder.with_type("text/x-recipe", F.col("path").endswith(".recipe")).with_strategy("kitchen", F.array_contains("mime", "text/x-recipe") | F.col("path").endswith("/requirements.txt"), extractor)
    items, edges = builder.run()
    by = {n.rpartition("/")[2]: r for r in items.collect() for n in r.file_names}
    facts = {(r.id, r.key, r.value) for r in builder.extra.collect()}
    soup, told = by["soup.recipe"].id, by["etc.requirements.txt"].id
    assert soup == gitoid and "text/x-recipe" in by["soup.recipe"].mime_types
    assert {(soup, "Dish", "soup"), (soup, "Reviewed", "yes")} <= facts and not any(k.startswith("CryptoDependency") for _, k, _ in facts)
    assert json.loads(next(v for i, k, v in facts if i == told and k == "static-metadata-artifact"))["name"] == "n" and ("x", "Reviewed", "no") not in facts
    assert {(r.id, r.purl) for r in builder.purls.filter("purl <> 'pkg:generic/@'").collect()} == {(soup, "pkg:generic/soup@2.1"), (told, "pkg:maven/g/n@1")}
    assert (told, "alias:from", "pkg:maven/g/n@1") in {tuple(r) for r in edges.collect()}
