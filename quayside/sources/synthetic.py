"""Deterministic synthetic tables, one or more rows per key of a given frame.

Every random figure is a hash of the key and a name, so the tables are the same under any
partitioning and after any retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Carriers, ports and vessel types the generators draw from
CARRIER_NAMES = ["Hapag-Lloyd", "MSC", "Maersk", "Evergreen", "Cordelia"]
PORTS = ["IDJKT", "INNSA", "INMUN", "AEJEA", "CNGZH"]
VESSEL_TYPES = ["Container", "Bulk", "Tanker"]
RISK_WEIGHTS = {"crs": 0.02, "corrections": 0.3, "agreement": 2.0, "hs": 1.5, "restricted": 2.0, "voyage": 1.2, "carrier": 2.0}
RISK_SHIFT = 4.0


def uniform(key: Column, name: str) -> Column:
    """Figure in [0, 1) from the key and a name."""
    text = F.concat(key.cast("string"), F.lit(":" + name))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def whole(key: Column, name: str, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(uniform(key, name) * (high - low + 1))).cast("bigint")


def choice(key: Column, name: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), whole(key, name, 1, len(values)).cast("int"))


def normal(key: Column, name: str) -> Column:
    u = F.greatest(uniform(key, name + "1"), F.lit(1e-9))
    return F.sqrt(F.log(u) * -2.0) * F.cos(uniform(key, name + "2") * (2.0 * math.pi))


def poisson(key: Column, name: str, mean: float, most: int = 12) -> Column:
    """Small counts by the inverse of the distribution function."""
    u, total, p = uniform(key, name), 0.0, math.exp(-mean)
    count = F.lit(0)
    for i in range(most):
        total += p
        count = count + F.when(u >= total, 1).otherwise(0)
        p = p * mean / (i + 1)
    return count


def synth_documents(keys: DataFrame) -> DataFrame:
    """Bills of lading with raw and normalised values side by side."""
    k = F.col("key")
    day = F.date_add(F.lit("2015-01-01").cast("date"), whole(k, "day", 0, 3999).cast("int"))
    tons = whole(k, "tons", 1, 50)
    unit = choice(k, "unit", ["KGS", "MTS"])
    serial = F.lpad(whole(k, "serial", 0, 9999999).cast("string"), 7, "0")
    code = F.lpad(whole(k, "hs", 10000000, 99999999).cast("string"), 8, "0")
    return keys.select(
        "key", choice(k, "carrier", CARRIER_NAMES).alias("carrier"),
        F.concat(F.lit("BL"), F.lpad(whole(k, "bl", 1000000, 9999999).cast("string"), 7, "0")).alias("bl_number"),
        F.upper(F.date_format(day, "dd/MMM/yyyy")).alias("date_raw"), F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("HLXU "), serial).alias("container_raw"), F.concat(F.lit("HLXU"), serial).alias("container"),
        F.concat(F.when(unit == "MTS", tons).otherwise(tons * 1000).cast("string"), F.lit(" "), unit).alias("weight_raw"), (tons * 1000).cast("double").alias("weight_kg"),
        F.concat(F.substring(code, 1, 4), F.lit("."), F.substring(code, 5, 2), F.lit("."), F.substring(code, 7, 2)).alias("hs_raw"), code.alias("hs_code"),
    )


def synth_maritime(keys: DataFrame) -> DataFrame:
    """Three recent positions per vessel with its type and next port."""
    k = F.col("key")
    return keys.select("key", F.explode(F.array(F.lit(1), F.lit(6), F.lit(24))).alias("hours_ago")).select(
        "key", "hours_ago", F.concat(F.lit("9"), F.lpad(k.cast("string"), 6, "0")).alias("imo"), choice(k, "type", VESSEL_TYPES).alias("vessel_type"), choice(k, "port", PORTS).alias("port"),
        whole(k, "built", 1998, 2020).alias("built_year"),
        F.round((uniform(k, "lat") * 45 - 10).cast("decimal(18,8)"), 6).cast("double").alias("latitude"),
        F.round((uniform(F.concat(k.cast("string"), F.lit("@"), F.col("hours_ago").cast("string")), "speed") * 20).cast("decimal(18,8)"), 2).cast("double").alias("speed"),
    )


def synth_scenarios(keys: DataFrame) -> DataFrame:
    """Labelled cases: of every 15, eight good, four with a currency warning, three with a package mismatch."""
    slot = F.pmod(F.col("key"), F.lit(15))
    return keys.select(
        "key", F.when(slot < 8, "8517.62.21").otherwise("8471.30.20").alias("expected_hs_code"),
        F.when(slot < 8, "LOW").when(slot < 12, "MEDIUM").otherwise("CRITICAL").alias("expected_risk"),
        F.when(slot < 12, 50).otherwise(48).alias("bl_packages"), F.lit(50).alias("pl_packages"),
        F.when((slot >= 8) & (slot < 12), "IDR").otherwise("USD").alias("currency"), F.lit(25000.0).alias("total_value"),
    )


def synth_risk(keys: DataFrame) -> DataFrame:
    """32 declaration features with a label drawn from a logistic model of seven of them."""
    k = F.col("key")
    u = lambda n, lo=0.0, hi=1.0: uniform(k, n) * (hi - lo) + lo
    flip = lambda n, p: F.when(uniform(k, n) < p, 1.0).otherwise(0.0)
    three = lambda n, a, b: F.when(uniform(k, n) < a, 0.0).when(uniform(k, n) < b, 1.0).otherwise(2.0)
    bounded = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    f = {
        "crs_score": bounded(normal(k, "crs") * 15 + 70, 0.0, 100.0), "correction_count": poisson(k, "corr", 1.2).cast("double"),
        "agent_agreement": u("agree", 0.55, 1.0), "hs_confidence": u("hs", 0.4, 1.0), "field_low_count": poisson(k, "low", 0.8).cast("double"),
        "field_missing_count": poisson(k, "missing", 0.3).cast("double"), "has_hs_code": flip("hashs", 0.85), "doc_page_count": three("pages", 0.5, 0.85) + 1,
        "has_watermark": flip("wm", 0.7), "is_scanned": flip("scan", 0.4), "carrier_code": whole(k, "carrier", 0, 4).cast("double"), "incoterm_code": whole(k, "inco", 0, 2).cast("double"),
        "nib_valid": flip("nib", 0.9), "npwp_valid": flip("npwp", 0.88), "hs_format_valid": flip("hsf", 0.92), "date_parseable": flip("date", 0.95),
        "weight_converted": flip("weight", 0.93), "container_iso": flip("iso", 0.91), "cross_doc_rules_pass": F.floor(bounded(normal(k, "rules") * 1.5 + 8, 0.0, 11.0)).cast("double"),
        "insw_flag": flip("insw", 0.05), "vessel_voyage_match": flip("voyage", 0.88), "port_congestion_index": u("congestion"), "carrier_rejection_30d": u("carrier30", 0.05, 0.35),
        "route_risk_score": u("route"), "vessel_flag_risk": flip("flag", 0.03), "avg_transit_days": normal(k, "transit") * 7 + 21, "cargo_category_risk": three("cargo", 0.7, 0.95),
        "importer_rejection_rate": u("importer", 0.0, 0.5), "importer_declaration_count": F.round(F.greatest(F.lit(0.0), normal(k, "decl") * math.sqrt(50.0) + 50), 0),
        "hs_code_rejection_rate": u("hsrate", 0.0, 0.4), "avg_operator_correction": u("opcorr", 0.5, 3.0),
        "days_since_last_rejection": bounded(F.log(F.greatest(F.lit(1.0) - uniform(k, "days"), F.lit(1e-9))) * -30.0, 1.0, 365.0),
    }
    w = RISK_WEIGHTS
    df = keys.select("key", *[c.alias(n) for n, c in f.items()])
    c = F.col
    risk = (
        (100 - c("crs_score")) * w["crs"] + c("correction_count") * w["corrections"] + (1 - c("agent_agreement")) * w["agreement"] + (1 - c("hs_confidence")) * w["hs"]
        + c("insw_flag") * w["restricted"] + (1 - c("vessel_voyage_match")) * w["voyage"] + c("carrier_rejection_30d") * w["carrier"]
    )
    chance = F.lit(1.0) / (F.exp(F.lit(RISK_SHIFT) - risk) + 1)
    return df.withColumn("rejected", uniform(c("key"), "label") < chance)
