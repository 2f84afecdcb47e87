"""Project files of Maven: coordinates, parents, dependencies, licences; and repository metadata."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 10
#: A document type: names and quoted strings, which may hold any mark, and a subset in brackets.
DOCTYPE = r"""<!DOCTYPE(?:[^>\["']|"[^"]*"|'[^']*')*(?:\[(?:[^\]"']|"[^"]*"|'[^']*')*\])?\s*>"""


def parsed(text: str | None) -> ET.Element | None:
    """The root element, names without namespaces; a document type is stripped first, so no entity is ever expanded."""
    if not text:
        return None
    try:
        root = ET.fromstring(re.sub(DOCTYPE, "", text, flags=re.S).strip())
    except (ET.ParseError, ValueError):
        return None
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def under(e: ET.Element | None, path: str) -> str | None:
    text = e.findtext(path) if e is not None else None
    return text.strip() or None if text else None


def interpolated(text: str | None, known: dict[str, str], depth: int = 0, open_: frozenset = frozenset()) -> str | None:
    """The text with its properties put in; None if one is unknown, goes in a circle or lies too deep."""
    if text is None or depth > DEPTH:
        return None
    out, at = [], 0
    for m in re.finditer(r"\$\{([^}]*)\}", text):
        name = m[1]
        value = None if name in open_ else interpolated(known.get(name), known, depth + 1, open_ | {name})
        if value is None:
            return None
        out += [text[at : m.start()], value]
        at = m.end()
    return "".join([*out, text[at:]])


def project(text: str | None) -> dict | None:
    root = parsed(text)
    if root is None or root.tag != "project":
        return None
    parent = root.find("parent")
    own = {k: under(root, k) or under(parent, k) for k in ("groupId", "version")} | {"artifactId": under(root, "artifactId")}
    known = {e.tag: (e.text or "").strip() for e in root.findall("properties/*")}
    for prefix in ("project.", "pom.", ""):
        known |= {prefix + k: v for k, v in own.items() if v}
    known |= {"project.parent." + k: v for k in ("groupId", "artifactId", "version") if (v := under(parent, k))}
    fill = lambda e, k: interpolated(under(e, k), known)
    managed = {(fill(d, "groupId"), fill(d, "artifactId")): fill(d, "version") for d in root.findall("dependencyManagement/dependencies/dependency")}
    dependencies = []
    for d in root.findall("dependencies/dependency"):
        group, artifact = fill(d, "groupId"), fill(d, "artifactId")
        if group and artifact:
            dependencies.append({"group_id": group, "artifact_id": artifact, "version": fill(d, "version") or managed.get((group, artifact)), "scope": fill(d, "scope")})
    licences = [n if not (u := under(e, "url")) else f"{n} ({u})" for e in root.findall("licenses/license") if (n := under(e, "name"))]
    return {
        "group_id": interpolated(own["groupId"], known), "artifact_id": interpolated(own["artifactId"], known), "version": interpolated(own["version"], known),
        "name": fill(root, "name"), "description": fill(root, "description"), "url": fill(root, "url"), "scm_url": fill(root, "scm/url"),
        "parent": ":".join(v or "" for v in (under(parent, k) for k in ("groupId", "artifactId", "version"))) if parent is not None else None,
        "licences": licences, "dependencies": dependencies,
    }


def repository(text: str | None) -> dict | None:
    """Latest, release and versions of a ``maven-metadata.xml``."""
    root = parsed(text)
    if root is None or root.tag != "metadata":
        return None
    return {"latest": under(root, "versioning/latest"), "release": under(root, "versioning/release"), "versions": [v.text.strip() for v in root.findall("versioning/versions/version") if v.text]}


_S = T.StringType()
DEPENDENCY = T.StructType([T.StructField(n, _S) for n in ("group_id", "artifact_id", "version", "scope")])
PROJECT = T.StructType([*(T.StructField(n, _S) for n in ("group_id", "artifact_id", "version", "name", "description", "url", "scm_url", "parent")), T.StructField("licences", T.ArrayType(_S)), T.StructField("dependencies", T.ArrayType(DEPENDENCY))])


@F.pandas_udf(PROJECT)
def project_facts(text: pd.Series) -> pd.DataFrame:
    rows = [project(t) or {} for t in text]
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype="object") for f in PROJECT})


def runtime(dependencies):
    """The dependencies that a program needs at run time."""
    return F.filter(dependencies, lambda d: d["scope"].isNull() | d["scope"].isin("compile", "runtime"))


def rendered(dependencies):
    """dependencies as JSON."""
    return F.to_json(dependencies)
