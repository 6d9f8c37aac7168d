"""Ordered computations per key that stay parallel inside a hot key.

A plain window puts all rows of a key into one task, so one key with a third of the rows decides
the run time. Here the rows of a key are first cut into buckets that follow the order (for
instance the hour of the time stamp); each (key, bucket) is windowed by itself, and only the one
summary row per bucket is combined along the key. The results are exact.

``bucket`` must never decrease along ``order``.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def hour_bucket(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600)


def _merge(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
    return F.greatest(before, inside) if kind == "max" else F.least(before, inside)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
    folds: Mapping[str, tuple[str, Column]], include_current: bool = True,
) -> DataFrame:
    """Running sum, max or min along each key: ``folds`` maps the new column to (kind, value)."""
    df = df.withColumn("_bucket", bucket)
    for name, (_, value) in folds.items():
        df = df.withColumn(f"_v_{name}", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if include_current else -1
    )
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(*[_FOLD[k](f"_v_{n}").alias(f"_b_{n}") for n, (k, _) in folds.items()])
    sums = sums.select(*keys, "_bucket", *[_FOLD[k](f"_b_{n}").over(along).alias(f"_before_{n}") for n, (k, _) in folds.items()])
    local = df.select("*", *[_FOLD[k](f"_v_{n}").over(inside).alias(f"_in_{n}") for n, (k, _) in folds.items()])
    joined = local.join(sums, [*keys, "_bucket"])
    own = [c for c in df.columns if not c.startswith("_")]
    return joined.select(*own, *[_merge(k, F.col(f"_before_{n}"), F.col(f"_in_{n}")).alias(n) for n, (k, _) in folds.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "n", crowded: bool = True) -> DataFrame:
    """Row number along each key, from 1. Where no key is ``crowded`` its rows are numbered where they lie, in one pass; the same rows are left out, those without a key or bucket (the latter come first and keep their numbers)."""
    if not crowded:
        named = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys], F.col("_bucket").isNotNull())
        along = Window.partitionBy(*keys).orderBy("_bucket", *order)
        return df.withColumn("_bucket", bucket).withColumn(name, F.row_number().over(along).cast("bigint")).where(named).drop("_bucket")
    return running(df, keys, order, bucket, {name: ("sum", F.lit(1).cast("bigint"))})


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, cols: Sequence[str], step: int = 1, prefix: str = "next_"
) -> DataFrame:
    """Values of the next (``step`` 1) or previous (-1) row along each key."""
    df = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    shift = F.lead if step > 0 else F.lag
    edge = F.min_by if step > 0 else F.max_by
    ends = df.groupBy(*keys, "_bucket").agg(edge(F.struct(*cols), F.struct(*order)).alias("_edge"))
    ends = ends.select(*keys, "_bucket", shift("_edge").over(along).alias("_beyond"))
    local = df.withColumn("_near", shift(F.struct(*cols)).over(inside))
    own = [c for c in df.columns if not c.startswith("_")]
    found = F.coalesce("_near", "_beyond")
    return local.join(ends, [*keys, "_bucket"]).select(*own, *[found[c].alias(prefix + c) for c in cols])


def pages(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, item: Column, size: int = 1000, crowded: bool = True) -> DataFrame:
    """Child rows as arrays in order, ``size`` per page, so that no array grows with the data."""
    rows = numbered(df.withColumn("item", item), keys, order, bucket, "n", crowded)
    return (
        rows.groupBy(*keys, F.floor((F.col("n") - 1) / size).alias("page"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    )
