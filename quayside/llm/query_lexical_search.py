"""op13: the best 50 ``documents`` for each ``benchmark`` item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.catalog import query
from quayside.llm.lexical_search import build_index, search
from quayside.llm.shared import table

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), s AS (
  SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d
), held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM held GROUP BY term
), items AS (
  SELECT item_id, row_number() OVER () AS q,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT DISTINCT q, item_id, unnest(ts) AS term FROM items
), scored AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
    sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY q, r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INT AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


@query("op13_lexical_search", SQL)
def lexical_search(spark: SparkSession, base: str) -> DataFrame:
    return search(build_index(table(spark, base, "documents")), table(spark, base, "benchmark"), k=50)
