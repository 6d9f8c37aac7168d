"""Voting, alignment and correction queries over the observations."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.operators import voting as vote
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.sources.tables import dealt

# Normal forms and rule checks of the four bound fields, for the checking engine.
NORM = """SELECT *, CASE field
    WHEN 'hs_code' THEN CASE WHEN length(value) = 6 THEN value || '00' ELSE left(value, 8) END
    WHEN 'gross_weight' THEN CASE WHEN w LIKE '%.00' THEN left(w, length(w) - 1) WHEN w LIKE '%0' THEN left(w, length(w) - 1) ELSE w END
    WHEN 'vessel_name' THEN replace(upper(value), 'M/V ', '') ELSE value END AS norm
    FROM (SELECT *, replace(replace(value, ',', ''), ' KGS', '') AS w FROM b2)"""
BALLOT = """SELECT batch_id, doc_id, doc_type, field, norm, count(*) AS votes, sum(confidence::DECIMAL(18,6)) AS conf_sum,
    min(engine_rank) AS first_rank, max(engine_rank) AS last_rank FROM normed GROUP BY ALL"""
TALLY = """SELECT *, row_number() OVER (PARTITION BY batch_id, doc_id, doc_type, field ORDER BY norm IS NULL,
      CASE WHEN field = 'hs_code' THEN CASE WHEN regexp_full_match(norm, '\\d{8}') THEN 0 ELSE 1 END ELSE -votes END, first_rank) AS place,
    sum(CASE WHEN norm IS NOT NULL THEN votes END) OVER p AS given, count(norm) OVER p AS forms,
    sum(votes) OVER p AS readings, sum(conf_sum) OVER p AS conf_all FROM ballots
    WINDOW p AS (PARTITION BY batch_id, doc_id, doc_type, field)"""
RECONCILED = """SELECT batch_id, doc_id, doc_type, field, norm AS value, CASE WHEN norm IS NULL THEN 0.0::DOUBLE
      WHEN field = 'hs_code' THEN round((votes / given::DOUBLE * (conf_all::DOUBLE / readings))::DECIMAL(18,8), 3)::DOUBLE
      ELSE round((votes / given::DOUBLE * (conf_sum::DOUBLE / votes))::DECIMAL(18,8), 3)::DOUBLE END AS confidence,
    CASE WHEN field = 'hs_code' AND norm IS NOT NULL THEN 'rule' ELSE 'ensemble' END AS source, forms > 1 AS disagreement,
    NULL::VARCHAR AS flag_reason FROM tally WHERE place = 1"""
LEVELLED = """SELECT *, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' WHEN confidence > 0 THEN 'LOW'
    ELSE 'MISSING' END AS level FROM reconciled"""
STAGES = {"normed": NORM, "ballots": BALLOT, "tally": TALLY, "reconciled": RECONCILED, "rec": LEVELLED}
NAMES = {t: ", ".join(f"'{f}'" for f in fields) for t, fields in K.EXPECTED_FIELDS.items()}
WANTED = "SELECT batch_id, doc_id, doc_type, unnest(CASE doc_type " + " ".join(f"WHEN '{t}' THEN [{n}]" for t, n in NAMES.items()) + " END) AS field FROM docs"

WEIGHTS = {"agent_a": 1.00, "agent_b": 0.92, "agent_c": 0.84, "agent_d": 0.82}


def rec_sql(body: str, *needs: str, **extra: str) -> str:
    return oracle(body, "b2", *needs, **STAGES, **extra)


def reconciled(spark: SparkSession, base: str) -> DataFrame:
    return vote.majority_vote(B.observations(spark, base))


def by_batch(spark: SparkSession, base: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over the readings where they lie by batch, and over those of crowded batches; no batch is in both."""
    return functools.reduce(DataFrame.unionByName, [work(obs) for obs in B.observations_by_batch(spark, base)])


@query("majority_vote", rec_sql("SELECT * FROM rec"))
def _majority(spark, base):
    return reconciled(spark, base)


_TIER = {
    "normed": NORM, "ballots": BALLOT,
    "topped": "SELECT *, max(CASE WHEN norm IS NOT NULL THEN votes END) OVER (PARTITION BY batch_id, doc_id, doc_type, field) AS top FROM ballots",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY batch_id, doc_id, doc_type, field ORDER BY norm IS NULL,
        CASE WHEN field = 'hs_code' THEN 0 WHEN top >= 2 THEN -votes WHEN last_rank = 4 THEN 0 ELSE 1 END, first_rank) AS place FROM topped""",
}


@query("tier_vote", oracle("""SELECT batch_id, doc_id, doc_type, field, norm AS value,
    (CASE WHEN norm IS NULL THEN 0 WHEN field = 'hs_code' THEN 0.98 WHEN votes >= 3 THEN 0.94 WHEN votes = 2 AND last_rank = 4 THEN 0.85 WHEN votes = 2 THEN 0.78 ELSE 0.55 END)::DOUBLE AS confidence,
    CASE WHEN norm IS NULL THEN 'MISSING' WHEN field = 'hs_code' OR votes >= 3 THEN 'HIGH' WHEN votes = 2 THEN 'MEDIUM' ELSE 'LOW' END AS level,
    CASE WHEN field = 'hs_code' AND norm IS NOT NULL THEN 'rule' ELSE 'ensemble' END AS source, field <> 'hs_code' AND coalesce(top < 2, false) AS disagreement
    FROM ranked WHERE place = 1""", "b2", **_TIER))
def _tier(spark, base):
    return vote.tier_vote(B.observations(spark, base))


_FORMS = {
    "formed": """SELECT *, CASE WHEN field = 'gross_weight' THEN rtrim(rtrim(replace(replace(value, ',', ''), ' KGS', ''), '0'), '.')
        WHEN field = 'total_packages' THEN value ELSE lower(value) END AS form FROM b2 WHERE value IS NOT NULL""",
    "scored": """SELECT batch_id, doc_id, doc_type, field, form, sum(confidence::DECIMAL(18,6) * CASE engine WHEN 'agent_a' THEN 1.00::DECIMAL(8,4)
        WHEN 'agent_b' THEN 0.92 WHEN 'agent_c' THEN 0.84 ELSE 0.82 END) AS score, min(engine_rank) AS first_rank, count(*) AS support,
        arg_min(value, engine_rank) AS display FROM formed GROUP BY 1, 2, 3, 4, 5""",
    "cand": """SELECT *, row_number() OVER o AS place, lead(score) OVER o AS runner_up, sum(score) OVER p AS total,
        least(0.99::DOUBLE, score::DOUBLE / sum(score) OVER p::DOUBLE) AS share FROM scored
        WINDOW o AS (PARTITION BY batch_id, doc_id, doc_type, field ORDER BY score DESC, first_rank),
               p AS (PARTITION BY batch_id, doc_id, doc_type, field)""",
}


@query("weighted_vote", oracle("""SELECT batch_id, doc_id, doc_type, field, display AS value, round(share::DECIMAL(18,8), 4)::DOUBLE AS confidence,
    conflict, CASE WHEN conflict THEN CASE WHEN runner_up IS NOT NULL THEN 'engine_disagreement' ELSE 'low_confidence' END END AS reason,
    conflict AND share < 0.7 AS needs_review
    FROM (SELECT *, coalesce((score - runner_up)::DOUBLE < 0.12, false) OR share < 0.7 AS conflict FROM cand WHERE place = 1)""", "b2", **_FORMS))
def _weighted(spark, base):
    return vote.weighted_vote(B.observations(spark, base), WEIGHTS)


@query("rank_candidates", oracle("""SELECT batch_id, doc_id, field, form, display, support, place, round(share::DECIMAL(18,8), 6)::DOUBLE AS share,
    round((score - runner_up)::DOUBLE::DECIMAL(18,8), 6)::DOUBLE AS margin FROM cand""", "b2", **_FORMS))
def _rank(spark, base):
    from quayside.functions.common import rnd

    ranked = vote.rank_candidates(B.observations(spark, base), WEIGHTS)
    return ranked.select("batch_id", "doc_id", "field", "form", "display", "support", "place", rnd(F.col("share"), 6).alias("share"), rnd(F.col("margin"), 6).alias("margin"))


@query("agreement_rate", rec_sql("""SELECT batch_id, fields, disputed, round((1.0::DOUBLE - disputed / fields::DOUBLE)::DECIMAL(18,8), 3)::DOUBLE AS agreement_rate
    FROM (SELECT w.batch_id, count(*) AS fields, count(*) FILTER (r.disagreement) AS disputed FROM wanted w
          LEFT JOIN rec r ON w.doc_id = r.doc_id AND w.field = r.field GROUP BY 1)""", "docs", wanted=WANTED))
def _agreement(spark, base):
    return vote.agreement_rate(reconciled(spark, base), B.documents_of_batches(spark, base))


@query("two_engine_rate", oracle("""SELECT batch_id, count(*) AS fields, round((count(*) FILTER (best >= 2) / count(*)::DOUBLE)::DECIMAL(18,8), 3)::DOUBLE AS agreement_rate
    FROM (SELECT batch_id, doc_id, field, max(votes) AS best FROM ballots WHERE norm IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1""", "b2", normed=NORM, ballots=BALLOT))
def _two_engine(spark, base):
    return vote.two_engine_rate(B.observations(spark, base))


@query("expected_fields", rec_sql("""SELECT w.batch_id, w.doc_id, w.doc_type, w.field, r.value, coalesce(r.confidence, 0.0) AS confidence,
    coalesce(r.level, 'MISSING') AS level, coalesce(r.disagreement, false) AS disagreement
    FROM wanted w LEFT JOIN rec r ON w.doc_id = r.doc_id AND w.field = r.field""", "docs", wanted=WANTED))
def _expected(spark, base):
    return vote.align(reconciled(spark, base), B.documents_of_batches(spark, base))


@query("confidence_level", oracle("""SELECT batch_id, doc_id, field, engine,
    CASE WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' WHEN c > 0 THEN 'LOW' ELSE 'MISSING' END AS agents,
    CASE WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS stored,
    CASE WHEN value IS NULL THEN 'DISAGREEMENT' WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS review,
    CASE WHEN c > 0.85 THEN 'HIGH' WHEN c > 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS screen
    FROM (SELECT *, CASE WHEN value IS NULL THEN 0.0 ELSE confidence END AS c FROM b2)""", "b2"))
def _levels(spark, base):
    obs = B.observations(spark, base)
    c = F.when(F.col("value").isNull(), 0.0).otherwise(F.col("confidence"))
    return obs.select(
        "batch_id", "doc_id", "field", "engine",
        vote.confidence_level(c).alias("agents"), vote.confidence_level(c, profile="table").alias("stored"),
        vote.confidence_level(c, F.col("value").isNull(), "review").alias("review"), vote.confidence_level(c, profile="screen").alias("screen"),
    )


@query("avg_confidence", rec_sql("""SELECT batch_id, doc_id, round((sum(confidence::DECIMAL(18,6))::DOUBLE / count(*))::DECIMAL(18,8), 4)::DOUBLE AS avg_confidence,
    round((sum(confidence::DECIMAL(18,6) * w)::DOUBLE / sum(w))::DECIMAL(18,8), 4)::DOUBLE AS weighted_confidence
    FROM (SELECT *, CASE WHEN field = 'hs_code' THEN 2 ELSE 1 END AS w FROM rec) GROUP BY 1, 2"""))
def _avg(spark, base):
    named = F.col("batch_id").isNotNull() & F.col("doc_id").isNotNull()
    return vote.average_confidence(reconciled(spark, base).where(named), both=True)


@query("combine_documents", rec_sql("""SELECT batch_id, field, arg_max(value, doc_id) AS value, arg_max(confidence, doc_id) AS confidence FROM rec WHERE value IS NOT NULL GROUP BY 1, 2"""))
def _combine(spark, base):
    return by_batch(spark, base, lambda obs: vote.combine_documents(vote.majority_vote(obs), F.col("doc_id")))


@query("engine_quorum", oracle("""SELECT batch_id, doc_id, route, engines, 4 - engines AS failed_engines,
    CASE WHEN engines >= CASE WHEN route = 'FAST_PATH' THEN 1 ELSE 2 END THEN 'ok' ELSE 'error' END AS status
    FROM (SELECT batch_id, doc_id, CASE WHEN batch_id % 4 = 0 THEN 'FAST_PATH' ELSE 'STANDARD' END AS route,
          count(DISTINCT CASE WHEN value IS NOT NULL THEN engine END) AS engines FROM b2 GROUP BY 1, 2, 3)""", "b2"))
def _quorum(spark, base):
    docs = B.documents_of_batches(spark, base)
    routes = docs.select("doc_id", F.when(F.pmod("batch_id", F.lit(4)) == 0, "FAST_PATH").otherwise("STANDARD").alias("route"))
    return vote.engine_quorum(B.observations(spark, base), routes)


@query("distinct_values", rec_sql("SELECT DISTINCT batch_id, field, value FROM rec WHERE value IS NOT NULL"))
def _distinct(spark, base):
    return by_batch(spark, base, lambda obs: vote.distinct_values(vote.majority_vote(obs)))


# corrections come from the returned lines: the operator replaced the package count
_CORR = """SELECT batch_id, doc_id, 'total_packages' AS field, (l_quantity::BIGINT + 100)::VARCHAR AS corrected_value FROM docs WHERE l_returnflag = 'R'
    UNION ALL SELECT batch_id, doc_id, 'seal_number', 'S' || l_suppkey::VARCHAR FROM docs WHERE l_returnflag = 'A'"""


def corrections(spark: SparkSession, base: str) -> DataFrame:
    docs = dealt(B.documents_of_batches(spark, base), "batch_id", "doc_id")
    packages = docs.where("l_returnflag = 'R'").select(
        "batch_id", "doc_id", F.lit("total_packages").alias("field"),
        (F.col("l_quantity").cast("bigint") + 100).cast("string").alias("corrected_value"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("correction_id"),
    )
    seals = docs.where("l_returnflag = 'A'").select(
        "batch_id", "doc_id", F.lit("seal_number").alias("field"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("corrected_value"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("correction_id"),
    )
    return packages.unionByName(seals)


@query("apply_corrections", rec_sql("""SELECT coalesce(r.batch_id, c.batch_id) AS batch_id, coalesce(r.doc_id, c.doc_id) AS doc_id, coalesce(r.field, c.field) AS field,
    coalesce(c.corrected_value, r.value) AS value, coalesce(r.confidence, 1.0) AS confidence,
    CASE WHEN c.corrected_value IS NOT NULL THEN 'operator' ELSE r.source END AS source
    FROM rec r FULL JOIN corr c ON r.batch_id = c.batch_id AND r.doc_id = c.doc_id AND r.field = c.field""", corr=_CORR))
def _apply(spark, base):
    return vote.apply_corrections(reconciled(spark, base), corrections(spark, base))


@query("correction_log", rec_sql("""SELECT c.batch_id, c.doc_id, c.field, r.value AS before_state, c.corrected_value AS after_state
    FROM corr c LEFT JOIN rec r ON r.batch_id = c.batch_id AND r.doc_id = c.doc_id AND r.field = c.field WHERE r.value IS DISTINCT FROM c.corrected_value""", corr=_CORR))
def _log(spark, base):
    before = reconciled(spark, base)
    return vote.correction_log(before, vote.apply_corrections(before, corrections(spark, base), keep_before=True))


@query("merge_containers", oracle("""SELECT batch_id, container, arg_max(packages, lpad(is_main::VARCHAR, 2, '0') || lpad(packages::VARCHAR, 6, '0')) AS packages, max(is_main) AS on_main
    FROM (SELECT batch_id, 'CONT' || lpad((l_partkey % 50)::VARCHAR, 7, '0') AS container, l_quantity::BIGINT AS packages, CASE WHEN doc_type = 'bill_of_lading' THEN 1 ELSE 0 END AS is_main FROM docs) GROUP BY 1, 2""", "docs"))
def _containers(spark, base):
    docs = B.documents_of_batches(spark, base)
    shape = ["batch_id", F.concat(F.lit("CONT"), F.lpad(F.pmod("l_partkey", F.lit(50)).cast("string"), 7, "0")).alias("container"), F.col("l_quantity").cast("bigint").alias("packages")]
    main = docs.where("doc_type = 'bill_of_lading'").select(*shape)
    rest = docs.where("doc_type <> 'bill_of_lading'").select(*shape)
    return vote.merge_containers(main, rest)


# what a document of each type should hold is a table of a few rows: the readings join it, and nothing joins the readings to themselves
_KINDS = "SELECT doc_type, unnest(names) AS field, len(names) AS wanted FROM (VALUES " + ", ".join(f"('{t}', [{n}])" for t, n in NAMES.items()) + ") v(doc_type, names)"


@query("confidence_cap", rec_sql("""SELECT r.batch_id, r.doc_id, r.field, route, CASE WHEN route = 'DEGRADED' THEN least(r.confidence, 0.8) ELSE r.confidence END AS confidence
    FROM kept r JOIN routes q ON r.batch_id = q.batch_id AND r.doc_id = q.doc_id""", kinds=_KINDS, **{
    "kept": "SELECT DISTINCT batch_id, doc_id, doc_type, field, value, confidence FROM rec",
    "routes": """SELECT batch_id, doc_id, CASE WHEN 1 - count(CASE WHEN k.field IS NOT NULL THEN value END) / max(n)::DOUBLE > 0.75 THEN 'DEGRADED' ELSE 'STANDARD' END AS route
      FROM kept JOIN (SELECT doc_type, max(wanted) AS n FROM kinds GROUP BY 1) USING (doc_type) LEFT JOIN kinds k USING (doc_type, field) GROUP BY 1, 2""",
}))
def _cap(spark, base):
    capped = vote.cap_confidence(reconciled(spark, base), B.documents_of_batches(spark, base), max_empty=0.75)
    return capped.select("batch_id", "doc_id", "field", "route", "confidence")


_STATE = """SELECT batch_id, doc_id, count(value) = 0 AS has_error, count(value) > 0 AS has_data, bool_or(disagreement) AS has_conflict, min(confidence) AS min_confidence FROM rec GROUP BY 1, 2"""


@query("needs_fallback", rec_sql("""SELECT batch_id, bool_or(weak) AS needs_fallback, count(*) FILTER (weak) AS weak_documents FROM (
    SELECT s.batch_id, has_error OR NOT has_data OR quality < 0.85 OR (NOT digital AND (min_confidence < 0.8 OR has_conflict)) AS weak
    FROM state s JOIN (SELECT doc_id, 1.0::DOUBLE - l_discount * 2 AS quality, doc_type = 'invoice' AS digital FROM docs) q ON s.doc_id = q.doc_id) GROUP BY 1""", "docs", state=_STATE))
def _fallback(spark, base):
    state = reconciled(spark, base).groupBy("batch_id", "doc_id").agg(
        (F.count("value") == 0).alias("has_error"), (F.count("value") > 0).alias("has_data"),
        F.bool_or("disagreement").alias("has_conflict"), F.min("confidence").alias("min_confidence"), F.lit(1).alias("candidates"),
    )
    docs = B.documents_of_batches(spark, base).select(
        "batch_id", "doc_id", (F.lit(1.0) - F.col("l_discount") * 2).alias("quality"), (F.col("doc_type") == "invoice").alias("digital_text")
    )
    return vote.needs_fallback(state.join(docs, ["batch_id", "doc_id"]))


@query("hs_needed", rec_sql("""SELECT b1.batch_id, tier, tier <> 'enterprise' AND coalesce(weak, true) AS hs_needed FROM b1 LEFT JOIN
    (SELECT batch_id, bool_or(value IS NULL OR confidence < 0.5) AS weak FROM rec WHERE field = 'hs_code' GROUP BY 1) w ON b1.batch_id = w.batch_id""", "b1"))
def _hs_needed(spark, base):
    return vote.hs_needed(reconciled(spark, base), B.batches(spark, base))


@query("disputed_values", rec_sql("""SELECT r.batch_id, r.doc_id, r.field, any_value(r.value) AS chosen, string_agg(n.engine || '=' || coalesce(n.norm, '-'), ';' ORDER BY n.engine_rank) AS readings
    FROM rec r JOIN normed n ON r.batch_id = n.batch_id AND r.doc_id = n.doc_id AND r.field = n.field WHERE r.disagreement GROUP BY 1, 2, 3"""))
def _disputed(spark, base):
    obs = B.observations(spark, base)
    found = vote.disputed_values(obs, vote.majority_vote(obs))
    texts = F.transform("readings", lambda r: F.concat(r["engine"], F.lit("="), F.coalesce(r["norm"], F.lit("-"))))
    return found.select("batch_id", "doc_id", "field", "chosen", F.array_join(texts, ";").alias("readings"))


@query("hs_search_documents", rec_sql("""SELECT batch_id, doc_id, CASE WHEN coalesce(value, '') = '' THEN 'empty' WHEN NOT regexp_full_match(value, '[0-9]{8}') THEN 'format' ELSE 'confidence' END AS reason FROM rec
    WHERE field = 'hs_code' AND (coalesce(value, '') = '' OR NOT regexp_full_match(value, '[0-9]{8}') OR confidence < 0.75)"""))
def _hs_search(spark, base):
    return vote.hs_search_documents(reconciled(spark, base)).select("batch_id", "doc_id", "reason")
