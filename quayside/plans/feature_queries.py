"""Signals of a submission as they stood when it came in: rates by as-of sums, and the full feature list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import rnd
from quayside.operators import asof
from quayside.operators import maritime as M
from quayside.operators import scoring as S
from quayside.plans import bindings as B
from quayside.plans import maritime_queries as MQ
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.scoring_queries import AG, scored
from quayside.sources.tables import read_table


def _r(expr: str, n: int = 6) -> str:
    return f"round(({expr})::DECIMAL(18,8), {n})::DOUBLE"


def submissions(spark, base) -> DataFrame:
    """A batch handed in on the day its vessel arrives and decided one to five days later."""
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"])
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit(1).cast("decimal(12,2)") - F.col("l_discount").cast("decimal(12,2)"))
    facts = li.groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("num_line_items"), F.sum(net).cast("double").alias("fob_value"), F.min("l_suppkey").alias("supplier"),
        F.lpad(F.pmod(F.min("l_partkey"), F.lit(100)).cast("string"), 2, "0").alias("chapter"), F.bool_or(F.pmod("l_partkey", F.lit(25)) == 0).alias("hs_changed"),
    )
    country = B.owners(spark, base).select(F.col("imo").alias("supplier"), F.col("country").alias("shipper_country"))
    scores = scored(spark, base).drop("label").join(read_table(spark, base, "orders", ["o_orderkey", "o_orderstatus"]).withColumnRenamed("o_orderkey", "batch_id"), "batch_id")
    key, codes = F.col("batch_id"), F.array(*[F.lit(c) for c in K.CARRIERS])
    arrived = F.col("arrival").cast("timestamp") + F.make_interval(hours=F.pmod(key, F.lit(24)).cast("int"))
    importer = F.col("company_id").cast("string")
    return (
        facts.join(country, "supplier", "left").join(MQ.voyages(spark, base), "batch_id").join(scores, "batch_id")
        .withColumn("carrier", F.element_at(codes, (F.pmod("supplier", F.lit(len(K.CARRIERS))) + 1).cast("int")))
        .withColumn("submitted_at", arrived).withColumn("decided_at", F.col("submitted_at") + F.make_interval(days=(F.pmod(key, F.lit(5)) + 1).cast("int")))
        .withColumn("rejected", F.col("o_orderstatus") == "P").withColumn("corrections", F.col("disagreements"))
        .withColumn("nib", F.lpad(importer, F.when(F.pmod("company_id", F.lit(10)) == 0, 12).otherwise(13), F.lit("0")))
        .withColumn("npwp", F.lpad(importer, F.when(F.pmod("company_id", F.lit(7)) == 0, 14).otherwise(15), F.lit("0")))
        .withColumn("aju", F.concat(F.date_format("submitted_at", "yyyyMMddHHmmss"), F.lpad(importer, 6, "0"), F.lpad(key.cast("string"), F.when(F.pmod(key, F.lit(13)) == 0, 5).otherwise(6), F.lit("0"))))
    )


_FACTS = """SELECT l_orderkey AS batch_id, count(*) AS num_line_items, sum(l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(12,2)))::DOUBLE AS fob_value, min(l_suppkey) AS supplier, lpad((min(l_partkey) % 100)::VARCHAR, 2, '0') AS chapter,
    bool_or(l_partkey % 25 = 0) AS hs_changed FROM lineitem GROUP BY 1"""
_SUBMITTED = f"""SELECT *, submitted_at + to_days((batch_id % 5)::INT + 1) AS decided_at FROM (SELECT f.*, s.* EXCLUDE (batch_id, label), country AS shipper_country, voy.bl_date, voy.port, voy.arrival, voy.arrival::TIMESTAMP + to_hours((f.batch_id % 24)::INT) AS submitted_at,
    ([{', '.join(repr(c) for c in K.CARRIERS)}])[(supplier % {len(K.CARRIERS)})::INT + 1] AS carrier, s.label AS rejected, s.disagreements AS corrections
    FROM facts f JOIN scored s USING (batch_id) JOIN voy USING (batch_id) LEFT JOIN owners ON owners.imo = supplier)"""


def _known(key: str, more: str = "") -> str:
    return f"""SELECT s.batch_id, count(h.batch_id) AS n, count(*) FILTER (h.rejected) AS bad, coalesce(sum(h.corrections), 0)::DOUBLE AS fixes
        FROM subs s LEFT JOIN subs h ON h.{key} = s.{key} AND h.decided_at < s.submitted_at {more} GROUP BY 1"""


_RATES = {"facts": _FACTS, **AG, "voy": MQ.VOYAGES, "subs": _SUBMITTED, "imp": _known("company_id"), "car": _known("carrier", "AND h.decided_at >= s.submitted_at - INTERVAL 30 DAY"), "cha": _known("chapter")}
_RATE = "CASE WHEN {t}.n = 0 THEN 0.0::DOUBLE ELSE {t}.bad / {t}.n::DOUBLE END"
_MEAN = "CASE WHEN imp.n = 0 THEN 0.0::DOUBLE ELSE imp.fixes / imp.n END"
_JOINED = "subs JOIN imp USING (batch_id) JOIN car USING (batch_id) JOIN cha USING (batch_id)"


@query("point_in_time_rates", oracle(f"""SELECT batch_id, imp.n AS importer_submissions, car.n AS carrier_decisions, cha.n AS chapter_decisions, {_r(_RATE.format(t='imp'))} AS importer_rejection_rate, {_r(_RATE.format(t='car'))} AS carrier_rejection_rate,
    {_r(_RATE.format(t='cha'))} AS chapter_rejection_rate, {_r(_MEAN)} AS mean_corrections FROM {_JOINED}""", "b3", "owners", **_RATES))
def _point_in_time(spark, base):
    s = submissions(spark, base)
    found = asof.rates_at_arrival(s, s)
    rates = [rnd(F.col(c), 6).alias(c) for c in ("importer_rejection_rate", "carrier_rejection_rate", "chapter_rejection_rate", "mean_corrections")]
    return found.select("batch_id", "importer_submissions", "carrier_decisions", "chapter_decisions", *rates)


_CONGESTION = "SELECT port, d, ships / max(ships) OVER ()::DOUBLE AS congestion FROM (SELECT port, eta::DATE AS d, count(*) AS ships FROM sl GROUP BY 1, 2)"
_PLAIN = {
    "avg_ocr_confidence": "agreement", "num_low_confidence_fields": "missing", "num_operator_corrections": "disagreements", "had_cross_doc_warnings": "(warnings > 0)::INT", "had_critical_validation_failures": "(critical > 0)::INT",
    "had_lartas_flag": "(chapter IN (" + ", ".join(f"'{c}'" for c in K.RESTRICTED_CHAPTERS) + "))::INT", "agent_disagreement_rate": "1.0::DOUBLE - agreement", "hs_code_ai_suggested": "(hs_conf < 0.75)::INT", "hs_code_confidence": "hs_conf",
    "hs_code_changed_by_operator": "hs_changed::INT", "cif_value_usd": "s.cif_value", "cif_per_unit_usd": "s.cif_value / package_count", "num_line_items": "num_line_items", "cif_fob_ratio": "s.cif_value / fob_value",
    "importir_historical_rejection_rate": _RATE.format(t="imp"), "importir_total_submissions": "imp.n", "nib_present": "(company_id % 10 <> 0)::INT", "npwp_valid": "(company_id % 7 <> 0)::INT", "aju_format_correct": "(batch_id % 13 <> 0)::INT",
    "all_required_fields_filled": "(completeness = 1.0)::INT", "vessel_ais_eta_delta_days": "coalesce(abs(c.arrival - ais_eta::DATE), 0)", "vessel_confirmed_in_ais": "(ais_eta IS NOT NULL)::INT", "vessel_confirmed_in_lineup": "c.lineup_confirmed::INT",
    "carrier_country_risk_score": "coalesce(owner_risk, 0.0)", "vessel_age_years": "year(c.arrival) - coalesce(built_year, year(c.arrival))", "vessel_type_matches_cargo": "coalesce(vessel_type = 'Container', false)::INT",
    "hour_of_submission": "hour(submitted_at)", "days_since_bl_date": "submitted_at::DATE - s.bl_date", "crs_score": "score", "carrier_rejection_rate_30d": _RATE.format(t="car"), "chapter_rejection_rate": _RATE.format(t="cha"), "port_congestion": "coalesce(congestion, 0.0)",
}


def feature_rows(spark, base) -> DataFrame:
    """Submissions with everything that the feature list reads; the rates are those known at arrival."""
    s = submissions(spark, base)
    at = F.col("port"), F.date_format("arrival", "yyyy-MM-dd")
    busy = M.port_congestion(MQ.ship_lineups(spark, base)).select(F.col("port").alias("_port"), F.col("day").alias("_day"), "congestion")
    vessel = M.maritime_features(MQ.checked(spark, base))
    return asof.rates_at_arrival(s, s).join(vessel, "batch_id").join(busy, (at[0] == F.col("_port")) & (at[1] == F.col("_day")), "left")


@query("rejection_features", oracle("SELECT batch_id, chapter AS hs_chapter, shipper_country AS shipper_country_code, " + ", ".join(f"{_r(e, 4)} AS {n}" for n, e in _PLAIN.items())
    + f" FROM {_JOINED.replace('subs', 'subs s')} JOIN (SELECT * FROM allchecks) c USING (batch_id) LEFT JOIN busy ON busy.port = s.port AND busy.d = s.arrival", "b3", *MQ._NEEDS, **(_RATES | MQ._CHECKED), busy=_CONGESTION))
def _features(spark, base):
    rows = feature_rows(spark, base)
    texts = ("hs_chapter", "shipper_country_code")
    return rows.select("batch_id", *[(v if n in texts else rnd(v.cast("double"), 4)).alias(n) for n, v in S.rejection_features(rows).items()])


@query("risk_features_wide", oracle(f"""SELECT batch_id, {_r('1.0::DOUBLE - agreement')} AS agent_disagreement_rate, (warnings > 0)::INT::DOUBLE AS had_cross_doc_warnings, {_r('cif_value / package_count', 4)} AS cif_per_unit_usd, {_r('cif_value / fob_value')} AS cif_fob_ratio,
    {_r('rate')} AS importer_rejection_rate, n::DOUBLE AS importer_submissions FROM subs JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (rejected) / count(*)::DOUBLE AS rate FROM subs GROUP BY 1) USING (company_id)""",
    "b3", "owners", **{k: _RATES[k] for k in ("facts", "ag", "scored", "voy", "subs")}))
def _wide(spark, base):
    """The importer's figures over all submissions, whenever they were decided."""
    s = submissions(spark, base)
    per = s.groupBy("company_id").agg(F.count(F.lit(1)).cast("double").alias("importer_submissions"), rnd(F.count_if("rejected") / F.count(F.lit(1)), 6).alias("importer_rejection_rate"))
    return s.join(per, "company_id").select(
        "batch_id", rnd(1.0 - F.col("agreement"), 6).alias("agent_disagreement_rate"), (F.col("warnings") > 0).cast("double").alias("had_cross_doc_warnings"),
        rnd(F.col("cif_value") / F.col("package_count"), 4).alias("cif_per_unit_usd"), rnd(F.col("cif_value") / F.col("fob_value"), 6).alias("cif_fob_ratio"), "importer_rejection_rate", "importer_submissions",
    )
