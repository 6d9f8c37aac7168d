"""op10: licences stated in ``documents``. Tested against brute force and texts of known licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.licenses import scan
from quayside.llm.shared import table


@query("op10_license_scan")
def license_scan(spark: SparkSession, base: str) -> DataFrame:
    found = scan(table(spark, base, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["licence"])))
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["licence"], f["start"], f["end"])), ",")
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.concat_ws(",", names).alias("licences"), spans.alias("spans"))
