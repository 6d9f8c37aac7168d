"""op1: exact duplicates of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.catalog import query
from quayside.llm.exact_dedup import duplicate_report
from quayside.llm.shared import table

SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
    sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) AS keep_id,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) AS place
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


@query("op1_exact_dedup", SQL)
def exact_dedup(spark: SparkSession, base: str) -> DataFrame:
    return duplicate_report(table(spark, base, "documents"))
