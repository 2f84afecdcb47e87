import io
import json
import tarfile

from pyspark.sql import functions as F

from ledgerloom.builder import GraphBuilder
from ledgerloom.operators import images

CONFIG = {"os": "linux", "architecture": "arm64", "variant": "v8", "created": "2025-03-22T00:00:00Z", "author": "", "config": {"Env": ["PATH=/bin:/usr=1", "EMPTY"], "Entrypoint": ["/run", "--x"], "WorkingDir": "/", "Labels": {"org.label-schema.name": "old", "org.opencontainers.image.title": "new", "own": "kept"}}, "rootfs": {"diff_ids": ["a", "b"]}, "history": [{"created_by": f"RUN {i}"} for i in range(5)] + [{"created_by": "EMPTY", "empty_layer": True}]}
BLOB = "blobs/sha256/"


def image_tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def entry(config, layers, tags):
    return {"Config": BLOB + config, "RepoTags": tags, "Layers": [BLOB + x for x in layers], "LayerSources": {x: {"size": 10} for x in layers}}


def test_join_is_unambiguous(spark):
    manifest = [entry("c1", ["l1", "l2", "gone", "l1"], ["x:1"]), entry("c2", ["l1"], []), entry("absent", ["l1"], []), {"Config": 5}, 7]
    files = [("t", "manifest.json", "m"), ("t", BLOB + "c1", "c1"), ("t", BLOB + "c2", "c2"), ("t", BLOB + "l1", "L1"), ("t", BLOB + "l2", "L2"), ("t", BLOB + "l2", "other")]
    files += [("two", "manifest.json", "m"), ("two", "manifest.json", "m"), ("two", BLOB + "c1", "c1"), (None, "manifest.json", "m"), ("object", "manifest.json", "o"), ("object", BLOB + "c1", "c1"), ("u", BLOB + "c1", None), ("u", None, "c1")]
    texts = [("m", json.dumps(manifest)), ("c1", json.dumps(CONFIG)), ("c2", "{broken"), ("o", json.dumps(manifest[0]))]
    files = spark.createDataFrame(files, "scope string, path string, id string")
    found = images.images(files, spark.createDataFrame(texts, "id string, json string"))
    assert [(r.scope, r.image, r.config) for r in found.collect()] == [("t", 0, "c1")]
    held = images.layers(found, files)
    assert sorted((r.position, r.layer) for r in held.collect()) == [(0, "L1"), (3, "L1")]
    assert {tuple(r) for r in images.layer_edges(held).collect()} == {("c1", "contained:down", "L1"), ("L1", "contained:up", "c1")}
    none = images.images(files.limit(0), spark.createDataFrame([], "id string, json string"))
    assert none.count() == images.metadata(none).count() == images.layers(none, files).count() == 0


def test_tags(spark):
    tags = {"bigtent:2025_03_22": "pkg:docker/bigtent@2025_03_22", "org/app:1": "pkg:docker/org%2Fapp@1", "reg.io/org/app:1+2": "pkg:docker/reg.io/org%2Fapp@1%2B2", "untagged": None, "a:": None}
    rows = spark.createDataFrame([(t,) for t in tags], "tag string").select("tag", images.tag_purl(F.col("tag")).alias("p")).collect()
    assert {r.tag: r.p for r in rows} == tags


def test_build_of_an_image(spark, tmp_path):
    layer = image_tar([("etc/os-release", b"ID=x\n"), ("usr/bin/tool", b"\x7fELF tool")])
    second = image_tar([("app/readme.txt", b"hello")])
    manifest = [entry("c1", ["l1", "l2"], ["reg.io/org/app:1.0", "app:latest"]), entry("c2", ["l2"], ["other:2"])]
    oci = {"schemaVersion": 2, "mediaType": "application/vnd.oci.image.manifest.v1+json", "config": {"digest": "sha256:c1", "mediaType": "application/vnd.oci.image.config.v1+json"}}
    files = [("manifest.json", json.dumps(manifest).encode()), (BLOB + "c1", json.dumps(CONFIG).encode()), (BLOB + "c2", b'{"os": "windows"}'), (BLOB + "l1", layer), (BLOB + "l2", second), (BLOB + "o1", json.dumps(oci).encode())]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "image.tar").write_bytes(image_tar(files))
    builder = GraphBuilder(spark).with_folder(str(tmp_path / "in")).with_tag("t").with_package_tags()
    items, edges = builder.run()
    by = {n.rpartition("/")[2]: r for r in items.collect() for n in r.file_names}
    c1, c2, l1, l2 = (by[n].id for n in ("c1", "c2", "l1", "l2"))
    links = {tuple(r) for r in edges.collect()}
    assert {(c1, "contained:down", l1), (c1, "contained:down", l2), (c2, "contained:down", l2), (l2, "contained:up", c2), (l1, "contained:up", by["image.tar"].id)} <= links
    assert (c2, "contained:down", l1) not in links and (by["tool"].id, "contained:up", l1) in links
    assert images.LAYER_TYPE in by["l1"].mime_types and set(images.CONFIG_TYPES) <= set(by["c1"].mime_types)
    facts = {(r.key, r.value) for r in builder.extra.filter(builder.extra.id == c1).collect()}
    assert {("docker:Platform", "linux/arm64/v8"), ("docker:Title", "new"), ("docker:Label:own", "kept"), ("docker:EnvCount", "2"), ("docker:LayerCount", "2"), ("docker:Size", "20"), ("docker:Entrypoint", "/run --x"), ("docker:Env:PATH", "/bin:/usr=1"), ("docker:ConfigMediaType", "application/vnd.oci.image.config.v1+json"), ("CanonicalPurl", "pkg:docker/reg.io/org%2Fapp@1.0")} <= facts
    assert sorted(v for k, v in facts if k == "docker:History") == ["RUN 2", "RUN 3", "RUN 4"] and not any(k == "docker:Author" for k, _ in facts)
    purls = {(r.id, r.purl) for r in builder.purls.collect()}
    assert {(c1, "pkg:docker/reg.io/org%2Fapp@1.0"), (c1, "pkg:docker/app@latest"), (c2, "pkg:docker/other@2")} <= purls
    assert (c1, "alias:from", "pkg:docker/app@latest") in links and ("pkg:docker/app@latest", "alias:to", c1) in links
    assert any(s == c1 and t == "tag:from" for s, t, _ in links)


def test_every_path_of_a_content_is_claimed(spark, tmp_path):
    """One content under two names gives the facts of both."""
    secret = b"root:$6$s$h:1:0:99999:7:::\n"
    jar = image_tar([("x", b"1")])
    for name, data in {"a/backup.txt": secret, "etc/shadow": secret, "org.one.lib-1.0.jar": jar, "org.two.lib-2.0.jar": jar, "zz/requirements.txt": b"cryptography==41\n", "aa/notes.txt": b"cryptography==41\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    builder = GraphBuilder(spark).with_folder(str(tmp_path))
    builder.run()
    facts = {(r.key, r.value) for r in builder.extra.collect()}
    assert {("PasswordHash:Algorithm", "sha512"), ("CryptoDependency:name", "cryptography")} <= facts
    assert {r.purl for r in builder.purls.collect()} == {"pkg:maven/org.one/lib@1.0", "pkg:maven/org.two/lib@2.0"}
