"""op9: personal data in ``documents``. The terms depend on corpus statistics; tested against brute force and the plain patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.pii import spans
from quayside.llm.shared import table


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_pii_sanitisation")
def pii_sanitisation(spark: SparkSession, base: str) -> DataFrame:
    found = spans(table(spark, base, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    plain = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(F.col("id").alias("doc_id"), *map(count, ("email", "ip", "card", "phone")), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("term"))
