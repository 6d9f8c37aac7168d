"""op3: ``pages`` written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.shared import table
from quayside.llm.warc import read_archives, write_archives

SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, [('0x' || substr(hex, 5 * g + 1, 5))::BIGINT for g in range(8)] AS fives, max(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1) for s in [15, 10, 5, 0]] for v in fives]), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS verified
FROM d
"""


def page_of(name: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(.*)>$', 1) AS BIGINT)")


@query("op3_warc", SQL)
def warc(spark: SparkSession, base: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, base, "pages"), least_bytes=0))
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "verified")
