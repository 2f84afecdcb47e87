"""Filters of artifacts and of type sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that are never archives, besides text and images.
NOT_ARCHIVES = (
    "application/java-vm", "text/plain", "multipart/appledouble", "application/xml-dtd", "application/xml", "text/x-java-properties", "text/x-scala",
    "text/x-java-source", "application/x-sh", "application/x-sharedlib", "image/png", "application/vnd.ms-fontobject", "application/x-font-ttf",
    "image/vnd.microsoft.icon", "image/gif", "application/x-sqlite3", "application/x-msdownload; format=pe64", "application/x-msdownload",
    "application/x-msdownload; format=pe32", "image/jpeg", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "audio/mpeg",
    "application/rdf+xml", "application/xhtml+xml", "image/svg+xml", "application/x-bat", "application/wsdl+xml", "application/x-mspublisher",
    "application/octet-stream", "application/x-dtbresource+xml", "application/vnd.iccprofile",
)
NOT_COMPRESSED = ("application/vnd.android.package-archive",)


def _plain(types: Column) -> Column:
    return F.exists(types, lambda m: m.startswith("text/") | m.startswith("image/"))


def not_archive(types: Column) -> Column:
    """Some type is text or an image, or all are known not to be archives."""
    return _plain(types) | F.forall(types, lambda m: m.isin(*NOT_ARCHIVES))


def not_compressed(types: Column) -> Column:
    """S13."""
    return _plain(types) | F.arrays_overlap(types, F.array(*map(F.lit, NOT_COMPRESSED)))


class IncludeExclude:
    """Lines of ``+`` exact and ``*`` pattern inclusions, ``-`` exact and ``/`` pattern exclusions, ``#`` comments.

    A set passes unless one of its members is excluded and none is included;
    patterns must match a whole member.
    """

    def __init__(self, rules: Iterable[str]):
        self.rules: dict[str, list[str]] = {c: [] for c in "+*-/"}
        for line in filter(None, map(str.strip, rules)):
            if line[0] == "#":
                continue
            if line[0] not in self.rules:
                raise ValueError(f"not a filter line: {line}")
            self.rules[line[0]].append(line[1:].strip())

    def _any(self, types: Column, exact: str, pattern: str) -> Column:
        whole = "|".join(f"(?:{p})" for p in self.rules[pattern])
        hit = lambda m: (m.isin(*self.rules[exact]) if self.rules[exact] else F.lit(False)) | (m.rlike(f"^(?:{whole})$") if whole else F.lit(False))
        return F.exists(types, hit)

    def passes(self, types: Column) -> Column:
        return ~self._any(types, "-", "/") | self._any(types, "+", "*")


def scan_filtered(artifacts: DataFrame, ignored: DataFrame, exclude: str | None = None) -> DataFrame:
    """Artifacts (path, ...) that are not hidden, not in ``ignored`` (path) and whose name matches no exclusion."""
    name = F.substring_index("path", "/", -1)
    kept = artifacts.filter(~name.startswith("."))
    return (kept.filter(~name.rlike(exclude)) if exclude else kept).join(ignored.select("path").distinct(), "path", "left_anti")


def unblocked(artifacts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Artifacts (id, ...) whose identity is not on the block list (id)."""
    return artifacts.join(blocked.select("id").distinct(), "id", "left_anti")


def of_types(files: DataFrame, *types: str) -> DataFrame:
    """Files whose types (mime) meet the given ones."""
    return files.filter(F.arrays_overlap("mime", F.array(*map(F.lit, types))))
