"""Starting streams on a bounded replay and reading back what they wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quayside.session import fresh_path


def table_stream(spark: SparkSession, base: str, name: str, max_files: int = 1000) -> DataFrame:
    """New files of a table as a stream; the schema is taken from the files there now."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    # as a pattern the path may be one file or a folder of files
    path = f"{base}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


@dataclass
class Closing:
    """A last row for a replay, whose time lies beyond all others, so that the watermark passes them. It has nulls
    elsewhere; drop it from results by its null key. ``stream`` is its place in the feed, empty until ``write``."""

    row: DataFrame
    path: str

    @property
    def stream(self) -> DataFrame:
        spark = self.row.sparkSession
        self.row.limit(0).write.mode("overwrite").parquet(self.path)
        return spark.readStream.schema(self.row.schema).parquet(self.path)

    def write(self) -> None:
        self.row.coalesce(1).write.mode("append").parquet(self.path)


def closing_row(table: DataFrame, ts: str, after: str, label: str) -> Closing:
    """The row ``after`` the newest one of ``table``."""
    at = table.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.col(ts).cast(f.dataType).alias(ts) for f in table.schema]
    return Closing(at.select(*empty), fresh_path(table.sparkSession, label))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drain(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> None:
    """Read all there is and stop. State lives in files beside the task, so that it may be larger than memory; timers need that store."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def append_to_table(stream: DataFrame, label: str, partition_by: Sequence[str] = (), closing: Closing | None = None) -> DataFrame:
    """Append-only sink (exactly once through the file sink's log); returns the written table.

    With ``closing`` the row that ends the replay is written, and read, after all others."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)

    def drain() -> None:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        _drain(spark, writer, f"{out}/checkpoint")

    drain()
    if closing is not None:
        closing.write()
        drain()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def upsert_to_table(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Update-mode sink: every micro-batch writes its changed keys to its own folder, a repeated
    batch overwrites the same folder, and the newest row of a key is the current one."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)

    def keep(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")

    _drain(spark, stream.writeStream.outputMode("update").foreachBatch(keep), f"{out}/checkpoint")
    written = spark.read.parquet(f"{out}/table")
    rest = [c for c in written.columns if c not in (*keys, "epoch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_row")).select(*keys, "_row.*")


def each_batch_to_table(stream: DataFrame, label: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a batch operator to every micro-batch and keep its result; idempotent per batch."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)

    def keep(rows: DataFrame, epoch: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")

    _drain(spark, stream.writeStream.foreachBatch(keep), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").drop("epoch")


