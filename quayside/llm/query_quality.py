"""op5: quality of ``documents`` as ``labels.quality`` marks it. Not expressible in SQL; tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.quality import fold, scored, train
from quayside.llm.shared import table


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    out = scored(docs, train(docs, table(spark, base, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
