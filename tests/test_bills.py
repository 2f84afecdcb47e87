import json

from ledgerloom.operators import bills

A, B = "gitoid:blob:sha256:" + "0" * 63 + "1", "gitoid:blob:sha256:" + "0" * 63 + "2"


def built(spark, extra, found, most=bills.COMPONENTS, aliases=None):
    rows = spark.createDataFrame([(i, k, None, v) for i, k, v in extra], "id string, key string, mime string, value string")
    tops = spark.createDataFrame(found, "root string, id string, depth int")
    own = bills.components(bills.described(bills.item_maps(rows)), aliases)
    return {r.root: json.loads(r.document) for r in bills.documents(bills.of_roots(tops, own, most), "T", tool_version="V").collect()}


def test_a_certificate(spark):
    """The shape of a whole document: an asset with its properties, and the algorithms that it refers to."""
    told = {"Name": "cert.pem", "Certificates:KeySize": "2048", "Certificates:SigAlgorithm": "SHA256withRSA", "Certificates:NotAfter": "2025-01-01T00:00:00Z", "Certificates:KeyAlgorithm": "RSA", "Certificates:NotBefore": "2024-01-01T00:00:00Z", "Certificates:IssuerDN": "CN=issuer", "Certificates:SubjectDN": "CN=test"}
    aliases = spark.createDataFrame([(A, "gitoid:blob:sha1:" + "a" * 40), (A, "md5:x")], "id string, alias string")
    doc = built(spark, [(A, k, v) for k, v in told.items()], [(A, A, 0)], aliases=aliases)[A]
    main, key, sig = doc["components"][0], *doc["components"][1:]
    assert {k: doc[k] for k in ("bomFormat", "specVersion", "version")} == {"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1} and doc["serialNumber"].startswith("urn:uuid:")
    assert doc["metadata"] == {"timestamp": "T", "tools": {"components": [{"type": "application", "name": "ledgerloom", "version": "V"}]}} and "properties" not in doc
    assert {(p["name"], p["value"]) for p in main.pop("properties")} == {(k, v) for k, v in told.items() if k != "Name"} | {("swhid:core", "swh:1:cnt:" + "a" * 40)}
    assert main == {"type": "cryptographic-asset", "bom-ref": A, "name": "cert.pem", "cryptoProperties": {"assetType": "certificate", "certificateProperties": {
        "subjectName": "CN=test", "issuerName": "CN=issuer", "notValidBefore": "2024-01-01T00:00:00Z", "notValidAfter": "2025-01-01T00:00:00Z", "subjectPublicKeyRef": "alg:pke:rsa", "signatureAlgorithmRef": "alg:signature:sha256withrsa", "certificateFormat": "X.509"}}}
    assert sig == {"type": "cryptographic-asset", "bom-ref": "alg:signature:sha256withrsa", "name": "SHA256withRSA", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "signature", "parameterSetIdentifier": "256"}}}
    assert key == {"type": "cryptographic-asset", "bom-ref": "alg:pke:rsa", "name": "RSA", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "pke", "parameterSetIdentifier": "2048"}}}


FAMILIES = {
    "conf": {"openssl.cnf:min_protocol": "TLSv1.2", "openssl.cnf:cipher_string": "HIGH:!aNULL", "openssl.cnf:options": "X"}, "policy": {"java.security:named_groups": "x25519"},
    "store": {"Certificates:KeystoreType": "jks", "Certificates:Entry:k:Chain:0:SubjectDN": "CN=x", "Certificates:Entry:k:KeyAlgorithm": "EC", "Certificates:Entry:k:Curve": "secp256r1", "Certificates:Entry:c:SubjectDN": "CN=y"},
    "crl": {"Certificates:CrlSha256": "ab", "Certificates:SigAlgorithm": "<unknown-sig-oid-2.16.840.1.101.3.4.3.17>"}, "passwd": {"PasswordHash:Algorithm": "sha512"}, "ssh": {"SSH:KeyType": "ssh-rsa", "SSH:KeySize": "3072"},
    "jwk": {"JWK:kty": "EC", "JWK:private_present": "true"}, "jwt": {"JWT:signature_algorithm": "none"}, "foot": {"CryptoAlgorithms:algorithm": "sha-256"}, "plain": {"Name": "x"},
    "lock": {"CryptoDependency:name": "Ring/Core", "CryptoDependency:version": "1.0", "CryptoDependency:algorithms": "aes sha"}, "nameless": {"Name": "", "TLSConfig:min": "x"}, "usign": {"Usign:KeyAlgorithm": "ed25519"},
}


def test_families(spark):
    doc = built(spark, [(i, k, v) for i, own in FAMILIES.items() for k, v in own.items()], [("r", i, 1) for i in FAMILIES] + [("other", "plain", 0)])
    assert doc.keys() == {"r"}
    by = {c["bom-ref"]: c for c in doc["r"]["components"]}
    crypto = {k: v.get("cryptoProperties") for k, v in by.items()}
    assert crypto["conf"]["protocolProperties"] == {"type": "tls", "version": "min:TLSv1.2", "cipherSuites": [{"name": n, "identifiers": [n]} for n in ("HIGH", "!aNULL", "X")]}
    material = {k: v["relatedCryptoMaterialProperties"] for k, v in crypto.items() if v and v["assetType"] == "related-crypto-material"}
    assert material == {
        "policy": {"type": "other"}, "store": {"type": "key", "algorithmRef": "alg:pke:ec"}, "crl": {"type": "other", "algorithmRef": "alg:signature:ml-dsa-44"}, "passwd": {"type": "password", "algorithmRef": "alg:hash:sha512"},
        "ssh": {"type": "public-key", "algorithmRef": "alg:pke:rsa", "size": 3072}, "jwk": {"type": "private-key", "algorithmRef": "alg:pke:ec"}, "jwt": {"type": "other"}, "usign": {"type": "public-key", "algorithmRef": "alg:pke:ed25519"},
    }
    assert by["dep-ring-core"] == {"type": "library", "bom-ref": "dep-ring-core", "name": "Ring/Core", "version": "1.0", "properties": [{"name": "crypto-family", "value": "aes sha"}, {"name": "algorithms", "value": "aes sha"}]}
    assert "alg:other:sha-256" in by and not {"foot", "lock", "plain", "nameless"} & by.keys()


def test_first_by_depth_and_cap(spark):
    extra = [(f"i{n}", "CryptoAlgorithms:algorithm", f"alg-{n:03d}") for n in range(50)] + [("deep", "SSH:KeyType", "ssh-rsa"), ("deep", "SSH:KeySize", "1024"), ("top", "SSH:KeyType", "ssh-rsa"), ("top", "SSH:KeySize", "4096")]
    found = [("r", f"i{n}", 2) for n in range(50)] + [("r", "deep", 1), ("r", "top", 0), ("s", "i1", 0)]
    docs = built(spark, extra, found, most=10)
    assert [c["bom-ref"] for c in docs["r"]["components"]][:3] == ["top", "alg:pke:rsa", "deep"] and len(docs["r"]["components"]) == 10
    assert docs["r"]["components"][1]["cryptoProperties"]["algorithmProperties"]["parameterSetIdentifier"] == "4096"
    assert docs["r"]["properties"] == [{"name": "cbom:truncated", "value": "true"}] and "properties" not in docs["s"]
    assert built(spark, [], [("r", "x", 0)]) == {}
