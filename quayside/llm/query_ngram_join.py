"""op6: components of texts with near-equal sets of word trigrams. Tested against brute force; all-pairs SQL is too slow on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.catalog import query
from quayside.llm.ngram_join import jaccard_components
from quayside.llm.shared import table


@query("op6_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, base: str) -> DataFrame:
    return jaccard_components(table(spark, base, "documents"), width=3, num=90, den=100)
