"""Content-derived identities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nul() -> Column:
    return F.expr("X'00'")


def blob_id(content: Column) -> Column:
    """The git blob hash of binary content: SHA-1 of `blob <length>`, a NUL and the bytes."""
    size = F.octet_length(content).cast("string")
    return F.sha1(F.concat(F.concat(F.lit("blob "), size).cast("binary"), _nul(), content))


def pattern_id(pattern: Column) -> Column:
    """A rule's structural id: SHA-1 of its pattern with named groups made plain."""
    return F.sha1(F.regexp_replace(pattern, r"\(\?P<[^>]+>", "(").cast("binary"))


def match_id(rule_sid: Column, blob: Column, start: Column, end: Column) -> Column:
    """A match's structural id, from the rule, the blob and the byte range."""
    parts = [rule_sid.cast("binary"), _nul(), F.unhex(blob), _nul(), start.cast("string").cast("binary"), _nul(), end.cast("string").cast("binary")]
    return F.sha1(F.concat(*parts))


def base64_of(value: Column) -> Column:
    """Standard base64 on one line."""
    return F.regexp_replace(F.base64(value.cast("binary")), r"\r\n", "")


def groups_json(groups: Column) -> Column:
    """Groups as a JSON array of base64 strings; null groups are `null`."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(groups, lambda g: F.concat(F.lit('"'), base64_of(g), F.lit('"'))), ","), F.lit("]"))
    return F.when(groups.isNull(), F.lit("null")).otherwise(listed)


def finding_id(rule_sid: Column, groups: Column) -> Column:
    """A finding's id: the rule and the captured groups, wherever they were matched."""
    return F.sha1(F.concat(rule_sid.cast("binary"), _nul(), groups_json(groups).cast("binary")))


def secret_key(rule_id: Column, secret: Column) -> Column:
    """The key of a secret across places: SHA-256 of rule and secret."""
    return F.sha2(F.concat(rule_id, F.lit(":"), secret), 256)
