"""op4: preference pairs of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.chat import preference_rows, swapped_answers
from quayside.llm.shared import table

SQL = r"""
WITH talk AS (
  SELECT conv_id, list({'turn': turn, 'role': coalesce(role, 'user'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), turns AS (
  SELECT conv_id, [{'role': x.role, 'text': x.text} for x in t] AS c, list_max([CASE WHEN t[i].role = 'assistant' THEN i END for i in range(1, len(t) + 1)]) AS last FROM talk
), pair AS (
  SELECT a.conv_id, a.c, a.c[:coalesce(a.last - 1, len(a.c))] || CASE WHEN b.last IS NULL THEN [] ELSE [b.c[b.last]] END AS r
  FROM turns a LEFT JOIN turns b ON b.conv_id = xor(a.conv_id, 1)
), cut AS (
  SELECT *, coalesce(list_min([CASE WHEN c[i] IS DISTINCT FROM r[i] THEN i - 1 END for i in range(1, least(len(c), len(r)) + 1)]), least(len(c), len(r))) AS n FROM pair
), parts AS (
  SELECT conv_id, n, c[:n] AS s, c[n + 1:] AS c, r[n + 1:] AS r,
    coalesce(c[n + 1].role = 'assistant' AND r[n + 1].role = 'assistant', false) AS headed FROM cut
), texts AS (
  SELECT *, [ '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10) for x in c] AS ct, [ '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10) for x in r] AS rt,
    CASE WHEN headed THEN 22 ELSE 0 END AS head FROM parts
)
SELECT conv_id AS pair_id, n::BIGINT AS n_common,
  array_to_string([ '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10) for x in s], '') || CASE WHEN headed THEN '<|im_start|>assistant' || chr(10) ELSE '' END AS prompt,
  substr(array_to_string(ct, ''), head + 1) AS chosen, substr(array_to_string(rt, ''), head + 1) AS rejected,
  array_to_string([(coalesce(list_sum([length(ct[j]) for j in range(1, i)]), 0) - head + 13 + length(c[i].role))::BIGINT::VARCHAR || ':' || (list_sum([length(ct[j]) for j in range(1, i + 1)]) - head)::BIGINT::VARCHAR
    for i in range(1, len(c) + 1) if c[i].role = 'assistant'], ',') AS chosen_mask,
  array_to_string([(coalesce(list_sum([length(rt[j]) for j in range(1, i)]), 0) - head + 13 + length(r[i].role))::BIGINT::VARCHAR || ':' || (list_sum([length(rt[j]) for j in range(1, i + 1)]) - head)::BIGINT::VARCHAR
    for i in range(1, len(r) + 1) if r[i].role = 'assistant'], ',') AS rejected_mask
FROM texts
"""


@query("op4_preference_formatting", SQL)
def preference_formatting(spark: SparkSession, base: str) -> DataFrame:
    found = preference_rows(swapped_answers(table(spark, base, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return found.select("pair_id", "n_common", "prompt", "chosen", "rejected", text("chosen_mask"), text("rejected_mask"))
