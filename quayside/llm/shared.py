"""Helpers of the training-text operators: shared-folder tables, Bloom filters, components of a graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayside.session import fresh_path

BLOCK_BITS = 32768  # bits of one filter block; Spark's bitmap functions work on blocks of this size


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table_of_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows of the driver, whose size the caller bounds; Arrow carries it without a Python worker."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=to_arrow_schema(StructType.fromDDL(schema))))


def smallest_hashes(rows: DataFrame, h: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash ``h`` (ties by all columns). A threshold leaves about twice as many rows before they
    are ordered, so that tasks do not each send their own ``most`` to the driver."""
    n = rows.count()
    low = rows if n <= 2 * most else rows.where(F.pmod(F.col(h), F.lit(1 << 30)) < int((1 << 30) * 2 * most / n))
    return low.orderBy(F.pmod(F.col(h), F.lit(1 << 30)), *rows.columns).limit(most)


# --- blocked Bloom filters ------------------------------------------------------------------------
# A hash picks a block of 32768 bits and two different bits in it. Blocks are rows, so building and
# testing are joins and aggregates; the number of blocks is bounded, so the filter can be broadcast.


def filter_blocks(rows: int, bits_per_row: int = 32, max_bytes: int = 32 << 20) -> int:
    """Blocks for so many rows. The bound only raises the share of false positives, it loses nothing."""
    wanted = -(-rows * bits_per_row // BLOCK_BITS)
    return max(1, min(wanted, max_bytes * 8 // BLOCK_BITS))


def bloom_block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def bloom_bits(h: Column) -> list[Column]:
    first = F.shiftrightunsigned(h, 49).cast("int")
    step = F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
    return [first, F.pmod(first + 1 + step % (BLOCK_BITS - 1), F.lit(BLOCK_BITS)).cast("int")]


def repeated_bits(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """Second pass of a two-pass filter: per block the bits that at least two hashes set."""
    hit = hashes.select(bloom_block(F.col(h), blocks).alias("block"), F.explode(F.array(*bloom_bits(F.col(h)))).alias("bit"))
    twice = hit.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return twice.groupBy("block").agg(F.expr("bitmap_construct_agg(CAST(bit AS BIGINT))").alias("bitmap"))


def set_bit(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a block is set; null where the block is missing."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7))) == 1


# --- connected components -------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each round gives the smallest label among a node's neighbours to the node and to the node that its label names, and then
    takes the label of the label. Trees hook onto each other by their roots, so the rounds follow the logarithm of the
    largest component and not its width. Labels live in tables of the shared folder: rounds do not pile up lineage, and both
    sides of every join are plain exchanges, so that a hot node is split. Stops when no label changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{label}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), label)
    while True:
        lowest = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        own = F.struct("node", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        root = F.struct(F.col("comp").alias("node"), F.col("low").alias("comp"), F.lit(None).cast("long").alias("was"))
        told = labels.join(lowest, "node").select(F.explode(F.array(own, root)).alias("t")).select("t.*")
        hooked = written(told.groupBy("node").agg(F.min("comp").alias("comp"), F.max("was").alias("was")), label)
        upper = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        moved = written(hooked.join(upper, "comp").select("node", F.col("top").alias("comp"), "was"), label)
        if moved.where("comp <> was").isEmpty():
            return moved.select("node", "comp")
        labels = moved.select("node", "comp")
