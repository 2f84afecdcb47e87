"""Content identity: digests, gitoids and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BLOB_PREFIX


def _bytes(content: Column) -> Column:
    return content.cast("binary")


def framed(content: Column, kind: str = "blob") -> Column:
    """The bytes with the header that object identifiers hash: kind, length and NUL."""
    head = F.concat(F.lit(kind + " "), F.octet_length(_bytes(content)).cast("string"))
    return F.concat(_bytes(head), F.expr("X'00'"), _bytes(content))


def gitoid(content: Column, kind: str = "blob", digest: str = "sha256") -> Column:
    """``gitoid:<kind>:<digest>:<hex>`` of text or bytes."""
    own = framed(content, kind)
    return F.concat(F.lit(f"gitoid:{kind}:{digest}:"), F.sha2(own, 256) if digest == "sha256" else F.sha1(own))


def aliases(content: Column) -> Column:
    """the five alias identifiers, in their fixed order."""
    raw = _bytes(content)
    named = (("sha1:", F.sha1(raw)), ("sha256:", F.sha2(raw, 256)), ("sha512:", F.sha2(raw, 512)), ("md5:", F.md5(raw)))
    return F.array(gitoid(content, "blob", "sha1"), *(F.concat(F.lit(p), h) for p, h in named))


def tree_gitoid(ids: Column) -> Column:
    """The identity of a set of gitoids, whatever their order."""
    hexes = F.transform(F.array_sort(ids), lambda i: F.element_at(F.split(i, ":"), -1))
    return gitoid(F.unhex(F.array_join(hexes, "")), "tree")


def path_parts(gitoid_: Column) -> Column:
    """the hex as three, three and the remaining characters."""
    own = F.substring_index(gitoid_, ":", -1)
    return F.array(F.substring(own, 1, 3), F.substring(own, 4, 3), F.substring(own, 7, 1000))


def positive_long(digest_hex: Column) -> Column:
    """the first eight bytes of a hex digest as a number of 63 bits."""
    first = F.conv(F.substring(digest_hex, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7))
    return F.conv(F.concat(first.cast("string"), F.substring(digest_hex, 2, 15)), 16, 10).cast("long")


def hex16(number: Column) -> Column:
    """a long as sixteen hex digits."""
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def swhid(sha1_gitoid: Column) -> Column:
    """F16: the content identifier of a SHA-1 gitoid, null for other identifiers."""
    own = F.regexp_extract(sha1_gitoid, "^gitoid:blob:sha1:([0-9a-f]{40})$", 1)
    return F.when(own != "", F.concat(F.lit("swh:1:cnt:"), own))


def is_blob(identifier: Column) -> Column:
    """P04."""
    return identifier.startswith(BLOB_PREFIX)


def name_uuid(identifier: Column) -> Column:
    """the name-based (version 3) UUID of an identifier."""
    h = F.md5(_bytes(identifier))
    byte = lambda at, keep, mark: F.lpad(F.lower(F.hex(F.conv(F.substring(h, at, 2), 16, 10).cast("int").bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(mark)))), 2, "0")
    own = F.concat(F.substring(h, 1, 12), byte(13, 0x0F, 0x30), F.substring(h, 15, 2), byte(17, 0x3F, 0x80), F.substring(h, 19, 14))
    return F.concat_ws("-", *(F.substring(own, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
