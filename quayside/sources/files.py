"""Landing folder: document files to checked document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.extract import infer_doc_type

# Size limit, files per batch, leading bytes of accepted types, types by file ending
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_FILES = 3
LEADING_BYTES = [("25504446", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("52494646", "image/webp"), ("504B0304", "application/zip")]
ENDINGS = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
ZIP_BASED = ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]


def _real_type(head: Column) -> Column:
    chain = None
    for lead, kind in LEADING_BYTES:
        test = F.startswith(head, F.lit(lead))
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("application/octet-stream")


def ingest_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """Files of a landing folder, checked by ``check_files``. A file beyond the size limit is listed, and its content never loaded: the length filter reaches the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fit = F.col("length") <= max_bytes
    listed = files.where(~fit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return check_files(files.where(fit).select("path", "length", "content").unionByName(listed), max_bytes, max_files)


def check_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """One row per file (path, length, content) with digest, size, types and the reason it is turned away, if any. The folder of a file is its batch."""
    return within_batches(file_rows(files, max_bytes), max_files)


def file_rows(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """What a file shows by itself: digest, size, types and the reason to turn it away that lies in it."""
    small = F.col("length") <= max_bytes
    rows = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("batch"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size_bytes"),
        F.when(small, F.sha2("content", 256)).alias("file_hash"), _real_type(F.when(small, F.hex(F.substring("content", 1, 8))).otherwise("")).alias("real_type"),
    )
    endings = F.create_map(*[F.lit(x) for p in ENDINGS.items() for x in p])
    rows = rows.withColumn("claimed_type", F.coalesce(F.try_element_at(endings, F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))), F.lit("unknown")))
    matches = (F.col("claimed_type") == F.col("real_type")) | (F.col("claimed_type").isin(ZIP_BASED) & (F.col("real_type") == "application/zip"))
    reason = (
        F.when(F.col("size_bytes") > max_bytes, "exceeds 50MB limit").when(F.col("claimed_type") == "unknown", "unsupported file type")
        .when(~matches, "content does not match claimed type")
    )
    return rows.withColumn("doc_type", infer_doc_type(F.col("name"))).withColumn("reject_reason", reason)


def within_batches(rows: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """The rule over a whole batch: sound files of a batch with too many files are turned away."""
    per_batch = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("files"))
    reason = F.coalesce("reject_reason", F.when(F.col("files") > max_files, "too many files in batch"))
    return rows.join(per_batch, "batch").withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def landing_stream(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, max_files_per_trigger: int = 1000) -> DataFrame:
    """The files of a landing folder as they arrive, each handed out once: the source keeps the files it has read in the query's checkpoint. Feed it to
    ``runner.append_to_table`` and put ``within_batches`` over the table, as a batch may arrive in several micro-batches."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    return file_rows(files, max_bytes)
