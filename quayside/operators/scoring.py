"""Readiness score, rejection risk and the features behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions import validate as V
from quayside.functions.common import rnd
from quayside.operators.ordered import running


def banded(value: Column, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    """First label whose lower bound the value reaches."""
    chain = None
    for bound, label in bands:
        chain = F.when(value >= bound, label) if chain is None else chain.when(value >= bound, label)
    return chain.otherwise(lowest)


def grade(score: Column, profile: str = "spec") -> Column:
    return banded(score, K.GRADES[profile], K.LOWEST_GRADE[profile])


def risk_level(probability: Column, profile: str = "spec") -> Column:
    return banded(probability, K.RISK_LEVELS[profile], K.LOWEST_RISK[profile])


def readiness_score(df: DataFrame, profile: str = "spec") -> DataFrame:
    """Score 0..100 with its grade.

    ``agents`` adds points for quality, passed rules, agreement, code confidence and vessel;
    ``api`` weighs five pillars and subtracts for failures; ``spec`` weighs completeness,
    confidence, validation and risk.
    """
    c = F.col
    if profile == "agents":
        vessel = F.when(c("vessel_status") == "critical", 0.0).when(c("vessel_status") == "warning", 10.0).otherwise(15.0)
        parts = {
            "document_quality": rnd(c("doc_quality") * 20, 1), "validation_pass_rate": rnd(c("consistency") * 25, 1),
            "agent_agreement": rnd(c("agreement") * 20, 1), "hs_confidence": rnd(c("hs_conf") * 20, 1), "vessel_validation": vessel,
        }
        total = F.lit(0).cast("decimal(10,1)")
        for p in parts.values():
            total = total + p.cast("decimal(10,1)")
        bounded = F.least(F.greatest(total.cast("double"), F.lit(0.0)), F.lit(100.0))
        return df.select("*", *[p.alias(n) for n, p in parts.items()], F.floor(bounded).cast("bigint").alias("score"), grade(bounded, "agents").alias("grade"))
    if profile == "api":
        values = {"historical": F.lit(K.HISTORICAL_DEFAULT)}
        raw = F.lit(0.0)
        for name, weight in K.API_PILLARS.items():
            raw = raw + values.get(name, c(name) if name != "historical" else None) * weight
        base = rnd(raw * 100, 2)
        penalty = c("critical") * 10.0 + c("warnings") * 4.0
        return df.select("*", penalty.alias("penalty"), rnd(F.greatest(F.lit(0.0), base - penalty), 2).alias("score")).withColumn("grade", grade(c("score"), "api"))
    validation = F.greatest(F.lit(0.0), 1.0 - (c("critical") * 0.30 + c("warnings") * 0.10))
    raw = (c("completeness") * 0.30 + c("agreement") * 0.25 + validation * 0.25 + (1.0 - c("probability")) * 0.20) * 100
    return df.withColumn("score", rnd(raw, 2)).withColumn("grade", grade(c("score"), "spec"))


def _triggered(value: Column, condition: str, threshold: float) -> Column:
    return {"lt": value < threshold, "gte": value >= threshold, "eq": value == threshold, "gt": value > threshold}[condition]


def fallback_risk(features: Mapping[str, Column], rules: Mapping) -> Column:
    """Base risk plus the contributions of the rules that fire, capped; the rule list becomes one expression."""
    risk = F.lit(rules["base_risk"]).cast("decimal(10,4)")
    for r in rules["rules"]:
        value = F.coalesce(features.get(r["feature"], F.lit(0.0)), F.lit(0.0))
        risk = risk + F.when(_triggered(value, r["condition"], r["threshold"]), F.lit(r["risk_contribution"]).cast("decimal(10,4)")).otherwise(F.lit(0).cast("decimal(10,4)"))
    return F.round(F.least(risk.cast("decimal(10,4)"), F.lit(rules["max_risk"]).cast("decimal(10,4)")), 3).cast("double")


def heuristic_risk(known: Sequence[Column], critical: Column, warnings: Column) -> Column:
    """One minus the mean of the score and confidence features, at least the share the failures stand for."""
    mean = F.lit(0.0)
    for k in known:
        mean = mean + k
    guess = rnd(1.0 - mean / len(known), 4)
    return rnd(F.greatest(guess, F.least(F.lit(0.95), critical * 0.18 + warnings * 0.06)), 4)


def agent_features(df: DataFrame) -> dict[str, Column]:
    c = F.col
    return {
        "crs_score": c("score").cast("double"), "critical_validation_failures": c("critical").cast("double"),
        "agent_disagreement_count": c("disagreements").cast("double"), "hs_code_confidence": c("hs_conf"),
        "vessel_validation_critical": F.when(c("vessel_status") == "critical", 1.0).otherwise(0.0),
        "missing_required_fields_count": c("missing").cast("double"), "document_quality": c("doc_quality"), "agent_agreement_rate": c("agreement"),
    }


def api_features(df: DataFrame) -> dict[str, Column]:
    c = F.col
    return {
        "doc_quality_score": c("doc_quality"), "completeness_score": c("completeness"), "consistency_score": c("consistency"),
        "historical_rate": F.lit(K.HISTORICAL_DEFAULT), "hs_confidence": c("hs_conf"), "cif_value_usd": c("cif_value"),
        "package_count": c("package_count").cast("double"), "gross_weight_kg": c("gross_weight"),
    }


def rejection_features(df: DataFrame) -> dict[str, Column]:
    """The full list of signals of a submission: documents, tariff code, values, importer, completeness, vessel and time. Texts stay
    categories (``hs_chapter``, ``shipper_country_code``); the last three are the rates and the congestion of the vessel signals."""
    c, flag = F.col, lambda test: F.coalesce(test, F.lit(False)).cast("double")
    return {
        "avg_ocr_confidence": c("agreement"), "num_low_confidence_fields": c("missing").cast("double"), "num_operator_corrections": c("disagreements").cast("double"),
        "had_cross_doc_warnings": flag(c("warnings") > 0), "had_critical_validation_failures": flag(c("critical") > 0),
        "had_lartas_flag": flag(c("chapter").isin(list(K.RESTRICTED_CHAPTERS))), "agent_disagreement_rate": 1.0 - c("agreement"),
        "hs_code_ai_suggested": flag(c("hs_conf") < 0.75), "hs_code_confidence": c("hs_conf"), "hs_code_changed_by_operator": flag(c("hs_changed")), "hs_chapter": c("chapter"),
        "cif_value_usd": c("cif_value"), "cif_per_unit_usd": F.coalesce(F.try_divide(c("cif_value"), c("package_count")), F.lit(0.0)), "num_line_items": c("num_line_items").cast("double"),
        "cif_fob_ratio": F.coalesce(F.try_divide(c("cif_value"), c("fob_value")), F.lit(0.0)),
        "shipper_country_code": c("shipper_country"), "importir_historical_rejection_rate": c("importer_rejection_rate"), "importir_total_submissions": c("importer_submissions").cast("double"),
        "nib_present": flag(V.valid_nib(c("nib"))), "npwp_valid": flag(V.valid_npwp(c("npwp"))), "aju_format_correct": flag(F.length("aju") == 26) * flag(c("aju").rlike("^[0-9]+$")),
        "all_required_fields_filled": flag(c("completeness") == 1.0),
        "vessel_ais_eta_delta_days": c("eta_delta_days").cast("double"), "vessel_confirmed_in_ais": flag(c("in_ais")), "vessel_confirmed_in_lineup": flag(c("lineup_confirmed")),
        "carrier_country_risk_score": c("owner_risk"), "vessel_age_years": c("vessel_age").cast("double"), "vessel_type_matches_cargo": flag(c("type_matches")),
        "hour_of_submission": F.hour("submitted_at").cast("double"), "days_since_bl_date": F.datediff(F.to_date("submitted_at"), F.col("bl_date")).cast("double"), "crs_score": c("score").cast("double"),
        "carrier_rejection_rate_30d": c("carrier_rejection_rate"), "chapter_rejection_rate": c("chapter_rejection_rate"), "port_congestion": F.coalesce("congestion", F.lit(0.0)),
    }


def top_features(df: DataFrame, features: Mapping[str, Column], keys: Sequence[str] = ("batch_id",), k: int = 5, without=("crs_score",)) -> DataFrame:
    """The largest features by magnitude of each row, as rows; sorted inside the row, so nothing is shuffled."""
    kept = [(n, v) for n, v in features.items() if n not in without]
    cells = F.array(*[F.struct((-F.abs(v)).alias("weight"), F.lit(i).alias("i"), F.lit(n).alias("feature"), v.alias("value")) for i, (n, v) in enumerate(kept)])
    return df.select(*keys, F.posexplode(F.slice(F.array_sort(cells), 1, k)).alias("pos", "cell")).select(
        *keys, (F.col("pos") + 1).alias("place"), F.col("cell.feature").alias("feature"), F.col("cell.value").alias("value")
    )


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums with ties halved; one half when a class is missing.

    Rows are reduced to counts per distinct score before anything is ordered, and the ordering
    runs per score bucket.
    """
    per = df.groupBy(*keys, F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label), 1).otherwise(0)).cast("bigint").alias("pos"), F.sum(F.when(F.col(label), 0).otherwise(1)).cast("bigint").alias("neg")
    )
    ranked = running(per, keys, [F.col("s")], F.floor(F.col("s") * 1000), {"below": ("sum", F.col("neg"))}, include_current=False)
    half = F.lit(0.5).cast("decimal(2,1)")
    hits = F.col("pos").cast("decimal(20,1)") * (F.col("below") + F.col("neg") * half).cast("decimal(17,1)")
    total = ranked.groupBy(*keys).agg(F.sum(hits).cast("double").alias("hits"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    area = F.when(both, F.coalesce(F.try_divide("hits", F.col("positives").cast("double") * F.col("negatives")), F.lit(0.5))).otherwise(0.5)
    return total.select(*keys, "positives", "negatives", rnd(area, 6).alias("auc"))


def promotions(registry: DataFrame, keys: Sequence[str] = (), max_drop: float = 0.02) -> DataFrame:
    """Which model versions replaced the one in use: each is compared with the last promoted one.

    A registry has one row per training run, so its history folds inside one row.
    """
    runs = registry.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("version", "auc"))).alias("runs"))
    start = F.struct(F.lit(None).cast("double").alias("current"), F.array().cast("array<struct<version:string,auc:double,promoted:boolean>>").alias("out"))

    def step(acc: Column, run: Column) -> Column:
        ok = promote(run["auc"], acc["current"], max_drop)
        row = F.struct(run["version"].alias("version"), run["auc"].alias("auc"), ok.alias("promoted"))
        return F.struct(F.when(ok, run["auc"]).otherwise(acc["current"]).alias("current"), F.concat(acc["out"], F.array(row)).alias("out"))

    return runs.select(*keys, F.inline(F.aggregate("runs", start, step, lambda acc: acc["out"])))


def promote(candidate_auc: Column, current_auc: Column, max_drop: float = 0.02) -> Column:
    """A candidate model replaces the current one unless it is clearly worse."""
    return current_auc.isNull() | (candidate_auc >= current_auc - max_drop)


