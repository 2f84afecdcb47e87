import json

from pyspark.sql import functions as F

from ledgerloom.functions.poms import project, project_facts, rendered, repository, runtime
from ledgerloom.operators import cbom
from ledgerloom.sources.scanners import changes, eligible, read_reports

POM = """<?xml version="1.0"?><!DOCTYPE project [<!ENTITY x "y">]><project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>org.p</groupId><artifactId>pa</artifactId><version>1</version></parent>
<artifactId>a-${suffix}</artifactId><name>N</name><properties><suffix>${deep}</suffix><deep>z</deep><c1>${c2}</c1><c2>${c1}</c2></properties>
<licenses><license><name>MIT</name><url>http://m</url></license><license><name>X</name></license></licenses>
<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>9</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId></dependency><dependency><groupId>${project.groupId}</groupId><artifactId>t</artifactId><version>${c1}</version><scope>test</scope></dependency></dependencies></project>"""


def test_project(spark):
    got = project(POM)
    assert (got["group_id"], got["artifact_id"], got["version"], got["parent"]) == ("org.p", "a-z", "1", "org.p:pa:1")
    assert got["licences"] == ["MIT (http://m)", "X"]
    assert [(d["group_id"], d["artifact_id"], d["version"], d["scope"]) for d in got["dependencies"]] == [("g", "m", "9", None), ("org.p", "t", None, "test")]
    for bad in (None, "", "<project", "<other/>", "text"):
        assert project(bad) is None
    df = spark.createDataFrame([(POM,), (None,), ("x",)], "t string").select(project_facts("t").alias("p"))
    rows = df.select("p.artifact_id", F.size(runtime(F.col("p.dependencies"))).alias("n"), rendered(F.col("p.dependencies")).alias("j")).collect()
    assert [(r.artifact_id, r.n) for r in rows][0] == ("a-z", 1) and len(json.loads(rows[0].j)) == 2 and rows[1].artifact_id is None


def test_repository():
    assert repository("<metadata><versioning><latest>2</latest><versions><version>1</version><version>2</version></versions></versioning></metadata>") == {"latest": "2", "release": None, "versions": ["1", "2"]}


def test_scanner(spark, tmp_path):
    report = {
        "artifacts": [{"id": "p", "name": "n", "version": "1", "type": "java", "purl": "pkg:maven/g/n@1"}, {"id": "q", "name": "m"}],
        "files": [{"id": "f", "location": {"path": "/x"}, "digests": [{"algorithm": "SHA256", "value": "AB"}]}],
        "artifactRelationships": [{"parent": "p", "child": "f", "type": "contains"}, {"parent": "q", "child": "f", "type": "contains"}],
    }
    for n in (1, 2):
        (tmp_path / f"{n}.json").write_text(json.dumps(report, indent=1))
    got = {(r.hash, r.key, r.value) for r in changes(read_reports(spark, str(tmp_path))).collect()}
    assert {(h, k) for h, k, _ in got} == {("sha256:ab", "static-metadata-artifact"), ("sha256:ab", "alias:from")} and len(got) == 3
    df = spark.createDataFrame([(["application/zip"], "a"), (["text/plain"], "b.jar"), (["text/plain"], "c")], "m array<string>, p string")
    assert [r[0] for r in df.select(eligible(F.col("m"), F.col("p"))).collect()] == [True, True, False]


def test_bill_parts(spark, tmp_path):
    extra = spark.createDataFrame(
        [("a", "Name", None, "n"), ("a", "Certificates:Cert:0:SubjectDN", None, "CN=x"), ("b", "openssl.cnf:MinProtocol", None, "TLSv1.2"), ("b", "openssl.cnf:CipherString", None, "AES128-SHA:HIGH"), ("c", "Certificates:Entry:k:Chain:0:Serial", None, "1"), ("c", "Certificates:Entry:j:Kind", None, "key")],
        "id string, key string, mime string, value string",
    )
    assert {(r.id, r.family) for r in cbom.families(extra).collect()} == {("a", "certificate"), ("b", "protocol"), ("c", "certificate")}
    assert {(r.id, r.name) for r in cbom.main_components(extra).collect()} == {("a", "n"), ("b", "b"), ("c", "c")}
    assert [tuple(r) for r in cbom.certificate_fields(extra, ("SubjectDN",)).collect()] == [("a", "SubjectDN", "CN=x")]
    assert [(r.id, r.min_version, sorted(r.suites)) for r in cbom.protocols(extra).collect()] == [("b", "1.2", ["AES128-SHA", "HIGH"])]
    assert [tuple(r) for r in cbom.key_entries(extra).collect()] == [("c", "k")]
    cbom.write_documents(spark.createDataFrame([("r", "cbom_r.json", "{}")], "root string, file_name string, document string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "cbom_r.json").read_text() == "{}"
