"""op12: ``documents`` packed whole into sequences of 1024 tokens. Tokenising is not expressible in SQL; tested by an exact round trip and the program's lower bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.config_packing import packed
from quayside.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


@query("op12_best_fit_packing")
def best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    out = packed(table(spark, base, "documents"), TOKENIZER, end_id=2, length=1024)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
