from ledgerloom.functions.poms import project
from ledgerloom.operators import inifiles

CNF = """openssl_conf = init
.include early.cnf
[unused]
MinProtocol = SSLv3
[init]
ssl_conf = ssl
[ssl]
system_default = tls
[tls]
; note = 1
# CipherString = LOW
cipherstring = HIGH
cipherstring = DEFAULT@SECLEVEL=2
Options = A, B,,
.include !/etc/other.cnf
.include two.cnf
server = init
[lost]
x = y
"""


def rows(spark, **texts):
    return inifiles.section_rows(spark.createDataFrame(list(texts.items()), "id string, text string"))


def test_sections(spark):
    own = rows(spark, a=CNF, b="", c=None, d="[x]\nCipherString = LOW\n[y]\nCIPHERSTRING = HIGH")
    assert {tuple(r) for r in inifiles.pointers(own).collect()} == {("a", "init", "ssl"), ("a", "ssl", "tls"), ("a", "tls", "init")}
    lead = {(r.root, r.section) for r in inifiles.reached(own).filter("id = 'a'").collect()}
    circle = {"init", "ssl", "tls"}
    assert lead == {(a, b) for a in circle for b in circle} | {("unused", "unused"), ("lost", "lost")}
    active = inifiles.active(own)
    facts = {(r.id, r.key, r.value) for r in inifiles.security_facts(own, active).filter("key <> 'algorithms'").collect()}
    assert facts == {("a", "sections", s) for s in circle | {"unused"}} | {("a", "cipher_string", "DEFAULT@SECLEVEL=2"), ("a", "min_protocol", "SSLv3"), ("a", "options", "A"), ("a", "options", "B")} | {("d", "sections", "x"), ("d", "sections", "y"), ("d", "cipher_string", "HIGH")}
    assert {r.reference for r in inifiles.openssl_includes(own, active).collect()} == {"/etc/other.cnf", "two.cnf"}
    assert inifiles.reached(rows(spark, a="no sections")).count() == 0


def test_chain_ends_at_the_bound(spark):
    text = "".join(f"[s{i:02d}]\nssl_conf = s{i + 1:02d}\n" for i in range(14)) + "[s14]\nx = 1\n"
    found = inifiles.reached(rows(spark, a=text)).filter("root = 's00'").collect()
    assert sorted(r.section for r in found) == [f"s{i:02d}" for i in range(inifiles.DEPTH + 1)]


def test_layers(spark):
    files = [("1", p) for p in "abcdef"] + [("2", p) for p in "xyz"] + [("3", "only")]
    edges = [("1", "a", "b"), ("1", "b", "c"), ("1", "c", "a"), ("1", "d", "c"), ("1", "e", "e"), ("2", "x", "y"), ("2", "y", "z"), ("2", "x", "z")]
    f, e = spark.createDataFrame(files, "scope string, path string"), spark.createDataFrame(edges, "scope string, src string, dst string")
    got = {(r.scope, r.path): r.layer for r in inifiles.layers(f, e).collect()}
    assert got == {("1", "e"): 0, ("1", "f"): 0, ("1", "a"): 1, ("1", "c"): 2, ("1", "b"): 3, ("1", "d"): 3, ("2", "z"): 0, ("2", "y"): 1, ("2", "x"): 2, ("3", "only"): 0}
    assert inifiles.layers(f.limit(0), e).count() == 0
    placed = f.selectExpr("scope", "path", "concat('id-', path) as id")
    links = {tuple(r) for r in inifiles.associated(placed, e, inifiles.layers(f, e)).collect()}
    assert {("id-x", "2:id-z"), ("id-d", "1:id-c"), ("id-b", "1:id-c"), ("id-c", "1:id-a")} <= links and ("id-a", "1:id-b") not in links


def test_java_security(spark):
    texts = {"a": 'include "b.security"\njdk.tls.disabledAlgorithms=X, RSA keySize < 2048, \\\n  Y', "b": "include <file:/etc/a.security>\njdk.tls.disabledAlgorithms : Z\njdk.tls.ephemeralDHKeySize=matched\n# jdk.tls.namedGroups=no", "c": "jdk.tls.namedGroups=x25519\njdk.tls.namedGroups=secp256r1", "d": None}
    own = spark.createDataFrame(list(texts.items()), "id string, text string")
    files = own.selectExpr("'' as scope", "concat('conf/', id, '.security') as path", "id")
    edges = inifiles.include_edges(files, inifiles.java_includes(own))
    assert {(r.src, r.dst) for r in edges.collect()} == {("conf/a.security", "conf/b.security"), ("conf/b.security", "conf/a.security")}
    got = {tuple(r) for r in inifiles.effective(files, inifiles.java_properties(own), edges).collect()}
    both = {"X", "RSA keySize < 2048", "Y", "Z"}
    assert got == {(i, "disabled_algorithms", v) for i in "ab" for v in both} | {("a", "ephemeral_dh_key_size", "matched"), ("b", "ephemeral_dh_key_size", "matched"), ("c", "named_groups", "secp256r1")}


def test_document_types():
    body = "<project><groupId>g</groupId><artifactId>a</artifactId><version>1</version></project>"
    for head in ('<!DOCTYPE project SYSTEM "a>b">', "<!DOCTYPE project [<!ENTITY x ']>'>]>", '<!DOCTYPE project PUBLIC "-//x//" "y[z">', ""):
        assert project(head + body)["artifact_id"] == "a"


def test_build_follows_includes(spark, tmp_path):
    from ledgerloom.builder import GraphBuilder

    for name, text in {"ssl/openssl.cnf": CNF.replace("two.cnf", "extra.cnf"), "ssl/extra.cnf": "[more]\nMinProtocol = TLSv1.2\n", "jre/java.security": "include other.security\njdk.tls.disabledAlgorithms=RC4\n", "jre/other.security": "jdk.tls.disabledAlgorithms=DES\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    builder = GraphBuilder(spark).with_folder(str(tmp_path))
    items, _ = builder.run()
    by = {r.id: n.rpartition("/")[2] for r in items.collect() for n in r.file_names}
    name = {n: i for i, n in by.items()}
    facts = {(by[r.id], r.key, r.value) for r in builder.extra.collect()}
    assert {("openssl.cnf", "openssl.cnf:associated_files", ":" + name["extra.cnf"]), ("extra.cnf", "openssl.cnf:min_protocol", "TLSv1.2"), ("java.security", "java.security:disabled_algorithms", "DES"), ("java.security", "java.security:associated_files", ":" + name["other.security"])} <= facts
