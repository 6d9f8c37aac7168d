"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass one sets two bits per content hash in a blocked filter whose size is bounded, and keeps the bits
that were set twice. Pass two tests every row against these bits (a broadcast of at most ``max_bytes``):
rows that miss a bit are the only ones with their content and pass straight through; the others, true
repeats and a few false positives, are the only rows that shuffle.

Two texts are equal when they are identical after deleting white space (``IGNORED``). Of equal rows
the one with the most code points stays, then the one with the smallest id (null ids last).

Defined cases: null text counts as empty, so empty and null rows form one group; rows that repeat both
text and id are one group of which one row stays; an empty table gives no rows; other columns, whatever
their names, are passed on (``distinct_texts``) or ignored (``duplicate_report``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import bloom_bits, bloom_block, filter_blocks, repeated_bits, set_bit, text_of, written

#: white space that does not count: space and the code points 9 to 13
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; literal replacement is several times faster than a pattern."""
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(text), 256)


def _hash(sha: Column) -> Column:
    return F.xxhash64(sha)


def _with_flag(rows: DataFrame, digests: DataFrame, max_bytes: int) -> DataFrame:
    """Rows (with column ``_sha``) plus ``_maybe``: whether their hash may occur twice in ``digests``."""
    blocks = filter_blocks(digests.count(), max_bytes=max_bytes)
    bits = repeated_bits(digests.select(_hash(F.col("_sha")).alias("_h")), "_h", blocks)
    h = _hash(F.col("_sha"))
    tested = rows.withColumn("_block", bloom_block(h, blocks)).join(F.broadcast(bits.withColumnRenamed("block", "_block")), "_block", "left")
    both = [set_bit(F.col("bitmap"), b) for b in bloom_bits(h)]
    return tested.withColumn("_maybe", F.coalesce(both[0] & both[1], F.lit(False))).drop("bitmap", "_block")


def _rank(length: Column, key: Column) -> Column:
    """Smallest for the row that stays: longest text, then an id that is there, then the smallest."""
    return F.struct((-length).alias("less"), key.isNull().alias("none"), key.alias("key"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    text = text_of(text_col)
    # ids and digests as a table: the texts are read once, and the row number below cannot change
    digests = written(docs.select(F.col(id_col).alias("_key"), digest(text).alias("_sha"), F.length(text).cast("long").alias("_len")), "digests")
    rows = digests.withColumn("_row", F.monotonically_increasing_id())
    flagged = written(_with_flag(rows, digests, max_bytes), "digests-tested")
    alone = flagged.where(~F.col("_maybe")).select(
        F.col("_key").alias(id_col), F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    maybe = flagged.where("_maybe")
    best = F.min(F.struct(_rank(F.col("_len"), F.col("_key")).alias("rank"), F.col("_row").alias("row"))).alias("best")
    # groups as a table: both sides of the join are then plain exchanges, which Spark splits where one group is hot
    groups = written(maybe.groupBy("_sha").agg(best, F.count(F.lit(1)).alias("group_size")), "digest-groups")
    shared = maybe.join(groups, "_sha").select(
        F.col("_key").alias(id_col), F.col("best.rank.key").alias("keep_id"), F.col("group_size").cast("long"), (F.col("_row") == F.col("best.row")).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    return alone.unionByName(shared)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only rows that may be repeats move, and they
    are reduced to the best of their group before they do."""
    names = docs.columns
    carried = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_all"), digest(text_of(text_col)).alias("_sha"))
    digests = written(carried.select("_sha"), "digests")
    flagged = _with_flag(carried, digests, max_bytes)
    place = {c: f"_all.c{i}" for i, c in enumerate(names)}
    rank = _rank(F.length(text_of(F.col(place[text_col]))), F.col(place[id_col]))
    best = flagged.where("_maybe").groupBy("_sha").agg(F.min_by("_all", rank).alias("_all"))
    kept = flagged.where(~F.col("_maybe")).select("_all").unionByName(best.select("_all"))
    return kept.select(*[F.col(place[c]).alias(c) for c in names])
