from ledgerloom.operators.cbom import related_material
from ledgerloom.operators.jars import archive_facts


def test_members_tell_facts(spark):
    rows = [
        ("boot", "META-INF/MANIFEST.MF", "Manifest-Version: 1.0\nStart-Class: a.Main\nAutomatic-Module-Name: m\n"), ("boot", "BOOT-INF/lib/x.jar", None), ("boot", "BOOT-INF/layers.idx", None),
        ("war", "WEB-INF/lib/a.jar", None), ("war", "WEB-INF/lib/b.jar", None), ("war", "META-INF/K.SF", None), ("war", "META-INF/K.RSA", None),
        ("ear", "META-INF/application.xml", "<a/>"), ("ear", "web.war", None), ("jar", "META-INF/versions/11/A.class", None), ("jar", "META-INF/versions/9/A.class", None), ("jar", "META-INF/services/java.sql.Driver", "x"), ("jar", "lib.jar", None),
    ]
    got = {(r.id, r.key.partition(":")[2]): r.value for r in archive_facts(spark.createDataFrame(rows, "container string, path string, text string")).collect()}
    assert {i: got[i, "JarType"] for i in ("boot", "war", "ear", "jar")} == {"boot": "spring-boot", "war": "war", "ear": "ear", "jar": "jar"}
    assert got["boot", "SpringBootMainClass"] == "a.Main" and got["boot", "AutomaticModuleName"] == "m" and got["boot", "LayersIdx"] == "true"
    assert got["war", "WarLibJars"] == "a.jar,b.jar" and got["war", "JarSigned"] == "true" and got["war", "SignatureFiles"] == "K.RSA,K.SF"
    assert got["ear", "EarModules"] == "web.war" and ("jar", "EarModules") not in got
    assert got["jar", "MultiReleaseVersions"] == "11,9" and got["jar", "ServiceProviders"] == "java.sql.Driver" and got["jar", "NestedJars"] == "lib.jar"


def test_related_material(spark):
    rows = [("a", "SSH:KeyType", "ssh-rsa"), ("a", "SSH:KeySize", "3072"), ("b", "JWK:kty", "EC"), ("b", "JWK:private_present", "true"), ("c", "Name", "x")]
    got = {tuple(r) for r in related_material(spark.createDataFrame(rows, "id string, key string, value string")).collect()}
    assert got == {("a", "public-key", "ssh-rsa", "3072", None), ("b", "private-key", "EC", None, None)}
