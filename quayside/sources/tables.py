"""Table reads with projection and filter next to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import fresh_path


def read_table(
    spark: SparkSession, base: str, name: str, cols: Sequence[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """Parquet table ``name`` under ``base``; only ``cols`` are read and ``where`` reaches the scan."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    if where is not None:
        df = df.where(where)
    return df if cols is None else df.select(*cols)


def read_jdbc(spark: SparkSession, url: str, name: str, cols: Sequence[str], where: str | None = None, **options) -> DataFrame:
    """The same read against a relational source; projection and filter are pushed to it."""
    df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return (df.where(where) if where else df).select(*cols)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage of loops, and a lost executor loses nothing of it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Planner's estimate of a frame's size, from file sizes and statistics; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only when the estimated size is within ``max_bytes``; else the planner decides."""
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df


PIECE_BYTES = 2 << 20  # estimated bytes of a piece before its rows are multiplied


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows out by ``keys`` before an operator multiplies them, into pieces that follow the size of the input.

    Groups, windows and joins by these keys, or groups by more columns, then run where the multiplied rows are made: only the
    narrow rows are shuffled, and a piece is small enough to be grouped and sorted in memory.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size_in_bytes(df) // PIECE_BYTES)), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split an input with fewer partitions than cores before an operator multiplies its rows.

    Large inputs already have a split per block and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
