"""Digests of text and of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def pseudonym(c: Column) -> Column:
    """Stable short name that does not reveal the value."""
    return F.left(digest(c), F.lit(16))


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON object with its keys in alphabetical order; nulls are kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def content_hash(columns: dict[str, Column]) -> Column:
    return digest(canonical_json(columns))
