"""op2: passages of ``benchmark`` in ``documents``. Tested against brute force over all windows; SQL over all windows is too slow on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.decontaminate import benchmark_matches
from quayside.llm.shared import table


@query("op2_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, base: str) -> DataFrame:
    found = benchmark_matches(table(spark, base, "documents"), table(spark, base, "benchmark"))
    items = F.array_sort(F.transform("matches", lambda m: m["item"]))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"), F.concat_ws(",", items.cast("array<string>")).alias("item_ids"))
