"""op11: the prefix trie of ``conversations``, rebuilt so that they share openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.prefix_trie import shared_openings, trie, turn_lists
from quayside.llm.shared import table

# the CRC-32 of the decimal id is folded bit by bit over its bytes
SQL = r"""
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
    xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT for c in string_split(conv_id::VARCHAR, '')],
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns[:a.h], []) || a.turns[a.h + 1:] AS path FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefix AS (
  SELECT conv_id, path[:u.depth] AS p, u.depth, u.depth = len(path) AS is_end FROM rebuilt, unnest(range(len(path) + 1)) AS u(depth)
), node AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256 FROM prefix GROUP BY p, depth
), kids AS (
  SELECT p[:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), whole AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].text) ELSE 0 END AS own FROM node LEFT JOIN kids USING (p)
), sums AS (
  SELECT p[:u.d] AS p, u.d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM whole, unnest(range(depth + 1)) AS u(d) GROUP BY 1, 2
)
SELECT w.conv_id, w.depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.p = w.p AND s.depth = w.depth LEFT JOIN node parent ON parent.p = w.p[:w.depth - 1] AND parent.depth = w.depth - 1
"""


@query("op11_prefix_trie", SQL)
def prefix_trie(spark: SparkSession, base: str) -> DataFrame:
    found = trie(shared_openings(turn_lists(table(spark, base, "conversations"))))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
