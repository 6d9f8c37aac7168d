"""One canonical name for quantities that are printed under several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K

_CANONICAL = {alias: name for name, aliases in reversed(K.FIELD_ALIASES.items()) for alias in aliases}
_RANK = {alias: i for aliases in K.FIELD_ALIASES.values() for i, alias in enumerate(aliases)}


def canonical_name(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in _CANONICAL.items() for x in p])
    return F.coalesce(F.try_element_at(table, field), field)


def alias_rank(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in _RANK.items() for x in p])
    return F.coalesce(F.try_element_at(table, field), F.lit(0))


def first_filled(*aliases: Column) -> Column:
    """First alternative that is present (wide form)."""
    return F.coalesce(*aliases)


def canonical_fields(long: DataFrame, keys: list[str], tie: Column) -> DataFrame:
    """Per key and canonical field the value of the best-ranked alias (long form)."""
    return (
        long.where("value is not null")
        .groupBy(*keys, canonical_name(F.col("field")).alias("field"))
        .agg(F.min_by("value", F.struct(alias_rank(F.col("field")), tie)).alias("value"))
    )
