"""op7: ``documents`` packed into sequences of 2048 tokens. Tokenising is not expressible in SQL; tested by an exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.packing import packed
from quayside.llm.shared import table

TOKENIZER = "word_bpe_49k.json"


def pieces_of(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    out = packed(docs, TOKENIZER, end_id=1, length=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_packing")
def packing(spark: SparkSession, base: str) -> DataFrame:
    return pieces_of(table(spark, base, "documents"))
