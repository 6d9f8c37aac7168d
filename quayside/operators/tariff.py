"""Tariff table checks: existence, restrictions, permits and company dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K


def chapter(code: Column) -> Column:
    return F.left(F.regexp_replace(F.trim(code), r"\.", ""), F.lit(2))


def permits_of(code: Column) -> Column:
    """Permits the chapter of a code calls for; null when it is unrestricted. The table is fixed and small, so it is a map literal."""
    table = F.create_map(*[x for ch, names in K.RESTRICTED_CHAPTERS.items() for x in (F.lit(ch), F.array(*[F.lit(n) for n in names]))])
    return F.try_element_at(table, chapter(code))


def restricted(items: DataFrame, code: str = "hs_code") -> DataFrame:
    return items.where(chapter(F.col(code)).isin(list(K.RESTRICTED_CHAPTERS)))


def tariff_lookup(items: DataFrame, tariff: DataFrame) -> DataFrame:
    """Duty and tax of each item's code, and whether it exists and is in force."""
    rates = tariff.groupBy("hs_code").agg(F.max("duty").alias("duty"), F.max("vat").alias("vat"), F.bool_or("active").alias("active"))
    return items.join(rates, "hs_code", "left").select(
        *items.columns, "duty", "vat",
        F.when(F.col("active").isNull(), "unknown").when(F.col("active"), "active").otherwise("inactive").alias("tariff_status"),
    )


def restriction_issues(items: DataFrame, code: str = "hs_code") -> DataFrame:
    """Issue text per restricted item."""
    need = permits_of(F.col(code))
    text = F.concat(F.lit("HS "), F.left(F.regexp_replace(F.trim(F.col(code)), r"\.", ""), F.lit(8)), F.lit(" may require: "), F.array_join(need, ", "))
    return items.where(need.isNotNull()).withColumn("issue", text)


def restriction_status(items: DataFrame, code: str = "hs_code") -> DataFrame:
    """Per batch: number of distinct restricted codes, and passed when there is none."""
    hit = permits_of(F.col(code)).isNotNull()
    return items.groupBy("batch_id").agg(F.count_distinct(F.when(hit, F.col(code))).alias("restricted_codes")).withColumn(
        "passed", F.col("restricted_codes") == 0
    )


def missing_permits(items: DataFrame, permits: DataFrame, code: str = "hs_code") -> DataFrame:
    """Restricted items of a batch without a permit for their code."""
    return (
        restricted(items, code).select("batch_id", F.col(code).alias("hs_code")).distinct()
        .join(permits.select("batch_id", "hs_code"), ["batch_id", "hs_code"], "left_anti")
        .withColumn("severity", F.lit("CRITICAL"))
    )


def company_dictionary(items: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """A company's own code for a description wins over the recommended one."""
    own = dictionary.groupBy(*keys).agg(F.max("own_code").alias("own_code"))
    return items.join(own, keys, "left").withColumn("final_code", F.coalesce("own_code", "hs_code")).withColumn(
        "from_dictionary", F.col("own_code").isNotNull()
    )
