"""Score, risk and feature queries over the per-batch aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.common import rnd
from quayside.operators import scoring as S
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.sources.dims import load_fallback_risk


def _r(expr: str, n: int) -> str:
    return f"round(({expr})::DECIMAL(18,8), {n})::DOUBLE"


_AGENTS = f"""SELECT *, {_r('doc_quality*20', 1)} AS document_quality, {_r('consistency*25', 1)} AS validation_pass_rate, {_r('agreement*20', 1)} AS agent_agreement, {_r('hs_conf*20', 1)} AS hs_confidence,
    CASE vessel_status WHEN 'critical' THEN 0.0 WHEN 'warning' THEN 10.0 ELSE 15.0 END::DOUBLE AS vessel_validation FROM b3"""
_AGENTS2 = """SELECT *, floor(t)::BIGINT AS score, CASE WHEN t >= 85 THEN 'A' WHEN t >= 70 THEN 'B' WHEN t >= 55 THEN 'C' WHEN t >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *,
    least(greatest(document_quality::DECIMAL(10,1) + validation_pass_rate::DECIMAL(10,1) + agent_agreement::DECIMAL(10,1) + hs_confidence::DECIMAL(10,1) + vessel_validation::DECIMAL(10,1), 0), 100)::DOUBLE AS t FROM ag)"""
AG = {"ag": _AGENTS, "scored": _AGENTS2}


def scored(spark, base) -> DataFrame:
    return S.readiness_score(B.batch_scores(spark, base), "agents")


@query("readiness_score", oracle("SELECT batch_id, document_quality, validation_pass_rate, agent_agreement, hs_confidence, vessel_validation, score, grade FROM scored", "b3", **AG))
def _agents(spark, base):
    return scored(spark, base).select("batch_id", "document_quality", "validation_pass_rate", "agent_agreement", "hs_confidence", "vessel_validation", "score", "grade")


_API = f"""SELECT *, critical * 10.0::DOUBLE + warnings * 4.0::DOUBLE AS penalty, {_r("greatest(0.0, " + _r('(0.0::DOUBLE + doc_quality*0.20::DOUBLE + completeness*0.25::DOUBLE + consistency*0.30::DOUBLE + 0.8::DOUBLE*0.15::DOUBLE + hs_conf*0.10::DOUBLE) * 100', 2) + " - (critical * 10.0::DOUBLE + warnings * 4.0::DOUBLE))", 2)} AS score FROM b3"""


@query("readiness_score_api", oracle("SELECT batch_id, penalty, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM api", "b3", api=_API))
def _api(spark, base):
    return S.readiness_score(B.batch_scores(spark, base), "api").select("batch_id", "penalty", "score", "grade")


_SPEC = f"""SELECT batch_id, {_r('(completeness*0.30::DOUBLE + agreement*0.25::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - (critical*0.30::DOUBLE + warnings*0.10::DOUBLE))*0.25::DOUBLE + (1.0::DOUBLE - (1.0::DOUBLE - consistency))*0.20::DOUBLE)*100', 2)} AS score FROM b3"""


@query("readiness_score_spec", oracle("SELECT batch_id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade FROM s", "b3", s=_SPEC))
def _spec(spark, base):
    df = B.batch_scores(spark, base).withColumn("probability", F.lit(1.0) - F.col("consistency"))
    return S.readiness_score(df, "spec").select("batch_id", "score", "grade")


_RISK = """SELECT batch_id, least(0.1 + CASE WHEN hs_conf < 0.7 THEN 0.3 ELSE 0 END + CASE WHEN disagreements >= 3 THEN 0.2 ELSE 0 END + CASE WHEN score < 55 THEN 0.5 ELSE 0 END + CASE WHEN critical >= 1 THEN 0.35 ELSE 0 END
    + CASE WHEN vessel_status = 'critical' THEN 0.25 ELSE 0 END + CASE WHEN missing >= 3 THEN 0.2 ELSE 0 END, 0.95)::DOUBLE AS risk FROM scored"""


def with_risk(spark, base) -> DataFrame:
    df = scored(spark, base)
    return df.withColumn("risk", S.fallback_risk(S.agent_features(df), load_fallback_risk()))


@query("fallback_risk", oracle("SELECT * FROM risky", "b3", **AG, risky=_RISK))
def _fallback(spark, base):
    return with_risk(spark, base).select("batch_id", "risk")


@query("risk_level", oracle("""SELECT batch_id, risk, CASE WHEN risk >= .7 THEN 'HIGH' WHEN risk >= .4 THEN 'MEDIUM' WHEN risk >= .2 THEN 'LOW' ELSE 'VERY_LOW' END AS agents,
    CASE WHEN risk >= .6 THEN 'CRITICAL' WHEN risk >= .35 THEN 'HIGH' WHEN risk >= .15 THEN 'MEDIUM' ELSE 'LOW' END AS api, CASE WHEN risk >= .7 THEN 'CRITICAL' WHEN risk >= .45 THEN 'HIGH' WHEN risk >= .2 THEN 'MEDIUM' ELSE 'LOW' END AS spec FROM risky""", "b3", **AG, risky=_RISK))
def _level(spark, base):
    return with_risk(spark, base).select("batch_id", "risk", *[S.risk_level(F.col("risk"), p).alias(p) for p in ("agents", "api", "spec")])


@query("heuristic_risk", oracle(f"""SELECT batch_id, {_r("greatest(" + _r('1.0::DOUBLE - (0.0::DOUBLE + doc_quality + completeness + consistency + hs_conf) / 4', 4) + ", least(0.95::DOUBLE, critical*0.18::DOUBLE + warnings*0.06::DOUBLE))", 4)} AS risk FROM b3""", "b3"))
def _heuristic(spark, base):
    df = B.batch_scores(spark, base)
    known = [F.col(c) for c in ("doc_quality", "completeness", "consistency", "hs_conf")]
    return df.select("batch_id", S.heuristic_risk(known, F.col("critical"), F.col("warnings")).alias("risk"))


_FEATURES = ["score::DOUBLE AS crs_score", "critical::DOUBLE AS critical_validation_failures", "disagreements::DOUBLE AS agent_disagreement_count", "round(hs_conf::DECIMAL(18,8), 6)::DOUBLE AS hs_code_confidence",
             "CASE WHEN vessel_status = 'critical' THEN 1.0 ELSE 0.0 END::DOUBLE AS vessel_validation_critical", "missing::DOUBLE AS missing_required_fields_count", "round(doc_quality::DECIMAL(18,8), 6)::DOUBLE AS document_quality", "round(agreement::DECIMAL(18,8), 6)::DOUBLE AS agent_agreement_rate"]


@query("risk_features", oracle(f"SELECT batch_id, {', '.join(_FEATURES)}, cif_value AS cif_value_usd, package_count::DOUBLE AS package_count, round(completeness::DECIMAL(18,8), 6)::DOUBLE AS completeness_score FROM scored", "b3", **AG))
def _features(spark, base):
    df = scored(spark, base)
    a = {n: rnd(c, 6) for n, c in S.agent_features(df).items()}
    b = S.api_features(df)
    return df.select("batch_id", *[c.alias(n) for n, c in a.items()], b["cif_value_usd"].alias("cif_value_usd"), b["package_count"].alias("package_count"), rnd(b["completeness_score"], 6).alias("completeness_score"))


_LONG = ["critical_validation_failures", "agent_disagreement_count", "hs_code_confidence", "vessel_validation_critical", "missing_required_fields_count", "document_quality", "agent_agreement_rate"]


@query("top_features", oracle(f"""SELECT batch_id, feature, place::INT AS place, {_r('value', 6)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY abs(value) DESC, i) AS place FROM (
    SELECT batch_id, unnest([critical::DOUBLE, disagreements::DOUBLE, hs_conf, CASE WHEN vessel_status = 'critical' THEN 1.0::DOUBLE ELSE 0.0 END, missing::DOUBLE, doc_quality, agreement]) AS value,
      unnest({_LONG}) AS feature, unnest([1,2,3,4,5,6,7]) AS i FROM scored)) WHERE place <= 5""", "b3", **AG))
def _top(spark, base):
    df = scored(spark, base)
    return S.top_features(df, S.agent_features(df)).select("batch_id", "place", "feature", rnd(F.col("value"), 6).alias("value"))


@query("auc", oracle(f"""SELECT sum(CASE WHEN label THEN 1 ELSE 0 END)::BIGINT AS positives, sum(CASE WHEN label THEN 0 ELSE 1 END)::BIGINT AS negatives,
    {_r('(sum(CASE WHEN label THEN r END) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label)::DOUBLE * count(*) FILTER (NOT label))', 6)} AS auc
    FROM (SELECT label, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0::DOUBLE AS r FROM risky JOIN b3 USING (batch_id))""", "b3", **AG, risky=_RISK))
def _auc(spark, base):
    return S.auc(with_risk(spark, base), "risk", "label")
