"""Results kept as tables and files that others read: a run that dies half-way is as if it had never been.

``commit`` writes rows into a folder of their own and then one marker row. Readers take only folders that a marker names, so rows of a run
without its marker are never seen, and the run can be repeated. ``replace_keys`` rewrites only the buckets that the new keys fall into.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators.listing import replace_by_key
from quayside.sources.tables import stored

KEY_SETTING = "spark.quayside.payload.secret"  # settings with this word are masked in logs and in the user interface
BUCKET = "key_bucket"
_MARKER = "seq bigint, run string, rows bigint"


def _markers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_MARKER).parquet(f"{root}/commits")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], _MARKER)


def put(rows: DataFrame, root: str, format: str = "json") -> str:
    """First half of a commit: the rows in a folder that does not count yet. JSON becomes one line per row."""
    run = uuid.uuid4().hex
    rows.write.format(format).option("compression", "gzip").save(f"{root}/data/{run}")
    return run


def mark(spark: SparkSession, root: str, run: str, rows: int) -> int:
    """Second half: from here on the folder counts. Returns its number."""
    seq = (_markers(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    spark.createDataFrame([(seq, run, rows)], _MARKER).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return seq


def commit(rows: DataFrame, root: str, format: str = "json") -> int:
    """Write ``rows`` and make them count."""
    spark = rows.sparkSession
    run = put(rows, root, format)
    return mark(spark, root, run, spark.read.schema(rows.schema).format(format).load(f"{root}/data/{run}").count())


def committed(spark: SparkSession, root: str, schema: str, format: str = "json") -> DataFrame:
    """Rows of all committed runs with the number ``seq`` of their commit."""
    runs = [(r["run"], r["seq"]) for r in _markers(spark, root).orderBy("seq").collect()]  # one row for each run
    if not runs:
        return spark.createDataFrame([], f"{schema}, seq bigint")
    parts = [spark.read.schema(schema).format(format).load(f"{root}/data/{run}").withColumn("seq", F.lit(seq).cast("bigint")) for run, seq in runs]
    return functools.reduce(DataFrame.unionByName, parts)


def replace_keys(new: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Old rows of the keys present in ``new`` give way to the new rows. The table is partitioned by a bucket of its keys; buckets without a new key are not touched.

    The new content of the touched buckets is written beside the table first, then takes their place by a dynamic partition overwrite."""
    spark = new.sparkSession
    new = new.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException:
        old = new.limit(0)
    touched = new.select(BUCKET).distinct()  # at most ``buckets`` rows
    ready = stored(replace_by_key(old.join(F.broadcast(touched), BUCKET, "left_semi").select(*new.columns), new, [*keys, BUCKET]), "replacement")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def payload_key(spark: SparkSession, trial: str | None = None) -> Column:
    """The encryption key from the session's masked setting, as a value that no plan prints: it comes from a one-row table at run time."""
    key = spark.conf.get(KEY_SETTING, trial)
    if key is None:
        raise ValueError(f"set {KEY_SETTING} to a key of 16, 24 or 32 characters")
    return spark.createDataFrame([(key,)], "key string").scalar()
