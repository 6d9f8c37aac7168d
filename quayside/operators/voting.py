"""Reconciling competing readings of one field into one trusted value.

Shape of every vote: readings are first combined per normal form on the map side (a hash
aggregate with fixed-width buffers), so only a handful of rows per document reach the shuffle;
the winner is then the first row of a window over at most one row per distinct value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions import validate as V
from quayside.functions.common import dec, millionths, rnd
from quayside.functions.normalize import compare_form, normalize_field

DOC_FIELD = ["batch_id", "doc_id", "doc_type", "field"]


def confidence_level(confidence: Column, disagreement: Column | None = None, profile: str = "agents") -> Column:
    """Label of a confidence: ``agents`` knows MISSING, ``table`` does not, ``review`` puts DISAGREEMENT first, ``screen`` uses the display bounds."""
    if profile == "screen":
        return F.when(confidence > 0.85, "HIGH").when(confidence > 0.65, "MEDIUM").otherwise("LOW")
    level = F.when(confidence >= 0.90, "HIGH").when(confidence >= 0.70, "MEDIUM")
    if profile == "agents":
        return level.when(confidence > 0, "LOW").otherwise("MISSING")
    if profile == "review":
        return F.when(F.coalesce(disagreement, F.lit(False)), "DISAGREEMENT").otherwise(level.otherwise("LOW"))
    return level.otherwise("LOW")


def _ballots(obs: DataFrame) -> DataFrame:
    """One row per distinct normal form of a field, null form included, with its support; confidences are summed in millionths."""
    return obs.groupBy(*DOC_FIELD, normalize_field(F.col("field"), F.col("value")).alias("norm")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.sum(millionths(F.col("confidence"))).alias("conf_sum"),
        F.min("engine_rank").alias("first_rank"),
        F.max("engine_rank").alias("last_rank"),
    )


def _tally(ballots: DataFrame, order: list[Column]) -> DataFrame:
    """Winner row per field with totals over all its forms."""
    everyone = Window.partitionBy(*DOC_FIELD)
    given = F.col("norm").isNotNull()
    return (
        ballots.withColumn("place", F.row_number().over(everyone.orderBy(F.col("norm").isNull(), *order)))
        .withColumn("given", F.sum(F.when(given, F.col("votes"))).over(everyone))
        .withColumn("forms", F.count("norm").over(everyone))
        .withColumn("readings", F.sum("votes").over(everyone))
        .withColumn("conf_all", F.sum("conf_sum").over(everyone))
        .where("place = 1")
    )


def majority_vote(obs: DataFrame) -> DataFrame:
    """Most frequent normal form, ties to the earliest engine; rule-checked fields take the first valid engine."""
    checked = V.is_rule_checked(F.col("field"))
    valid = V.passes_rule_check(F.col("field"), F.col("norm"))
    ballots = _ballots(obs).withColumn("ok", checked & valid)
    rank = F.when(checked, F.when(F.col("ok"), 0).otherwise(1)).otherwise(-F.col("votes"))
    won = _tally(ballots, [rank, F.col("first_rank")])

    share = F.col("votes") / F.col("given")
    mean_agreeing = F.col("conf_sum") / F.lit(1e6) / F.col("votes")
    mean_all = F.col("conf_all") / F.lit(1e6) / F.col("readings")
    missing = F.col("norm").isNull()
    confidence = (
        F.when(missing, F.lit(0.0))
        .when(~checked, rnd(share * mean_agreeing, 3))
        .when(F.col("ok"), rnd(share * mean_all, 3))
        .otherwise(F.lit(0.3))
    )
    failed = checked & ~F.col("ok") & ~missing
    return won.select(
        *DOC_FIELD,
        F.col("norm").alias("value"),
        confidence.alias("confidence"),
        F.when(checked & F.col("ok"), "rule").otherwise("ensemble").alias("source"),
        (failed | (F.col("forms") > 1)).alias("disagreement"),
        F.when(failed, F.concat(F.lit("No agent produced a valid "), F.col("field"), F.lit(" value"))).alias("flag_reason"),
    ).withColumn("level", confidence_level(F.col("confidence")))


def disputed_values(obs: DataFrame, voted: DataFrame) -> DataFrame:
    """What every engine read of the disputed fields: one row per field with the readings in order of the engines (one of each), for the operator to choose from.

    The disputed fields of a document are packed and meet the readings by document, so that readings which lie by document are not moved again."""
    dispute = F.struct("doc_type", "field", F.col("value").alias("chosen"), "flag_reason")
    packed = voted.where("disagreement").groupBy("batch_id", "doc_id").agg(F.collect_list(dispute).alias("disputed"))
    own = F.filter("disputed", lambda d: (d["doc_type"] == F.col("doc_type")) & (d["field"] == F.col("field")))
    met = obs.join(packed, ["batch_id", "doc_id"]).withColumn("dispute", F.explode(own)).select(*obs.columns, "dispute.chosen", "dispute.flag_reason")
    one = F.struct("engine_rank", "engine", "value", normalize_field(F.col("field"), F.col("value")).alias("norm"), "confidence")
    return met.groupBy(*DOC_FIELD, "chosen", "flag_reason").agg(F.array_sort(F.collect_list(one)).alias("readings"))


def tier_vote(obs: DataFrame) -> DataFrame:
    """Fixed confidence by vote count; without any agreement the last engine's value stands, and a field that nobody read is missing."""
    checked = V.is_rule_checked(F.col("field"))
    ballots = _ballots(obs).withColumn("ok", checked & V.passes_rule_check(F.col("field"), F.col("norm")))
    by_last = F.col("last_rank") == len(K.ENGINES)
    agreed = Window.partitionBy(*DOC_FIELD)
    top = F.max(F.when(F.col("norm").isNotNull(), F.col("votes"))).over(agreed)
    ballots = ballots.withColumn("top", top)
    rank = (
        F.when(checked, F.when(F.col("ok"), 0).otherwise(1))
        .when(F.col("top") >= 2, -F.col("votes"))
        .otherwise(F.when(by_last, 0).otherwise(1))
    )
    won = _tally(ballots, [rank, F.col("first_rank")])
    missing = F.col("norm").isNull()
    split = ~checked & F.coalesce(F.col("top") < 2, F.lit(False))
    failed = checked & ~F.col("ok") & ~missing
    confidence = (
        F.when(missing, 0.0).when(checked, F.when(F.col("ok"), 0.98).otherwise(0.40))
        .when(F.col("votes") >= 3, 0.94)
        .when((F.col("votes") == 2) & by_last, 0.85)
        .when(F.col("votes") == 2, 0.78)
        .otherwise(0.55)
    )
    level = (
        F.when(missing, "MISSING").when(checked, F.when(F.col("ok"), "HIGH").otherwise("LOW"))
        .when(F.col("votes") >= 3, "HIGH").when(F.col("votes") == 2, "MEDIUM").otherwise("LOW")
    )
    return won.select(
        *DOC_FIELD, F.col("norm").alias("value"), confidence.alias("confidence"), level.alias("level"),
        F.when(checked & F.col("ok"), "rule").otherwise("ensemble").alias("source"), (split | failed).alias("disagreement"),
    )


def scored_forms(obs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted support of every distinct comparison form of a field; a reading without a confidence has the default one."""
    table = {**K.ENGINE_WEIGHTS, **(weights or {})}
    by_engine = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    weight = F.coalesce(F.try_element_at(by_engine, F.col("engine")), F.lit(K.UNKNOWN_ENGINE_WEIGHT))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(K.DEFAULT_CONFIDENCE))))
    form = F.nullif(compare_form(F.col("field"), F.col("value")), F.lit(""))
    return (
        obs.select(*DOC_FIELD, form.alias("form"), "value", "engine_rank", (dec(clamped, 6) * dec(weight, 4, 8)).alias("score"))
        .where("form is not null")
        .groupBy(*DOC_FIELD, "form")
        .agg(
            F.sum("score").alias("score"),
            F.min("engine_rank").alias("first_rank"),
            F.count(F.lit(1)).alias("support"),
            F.min_by("value", "engine_rank").alias("display"),
        )
    )


def rank_candidates(obs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Candidates of a field in score order with margin to the next one and share of the total score."""
    everyone = Window.partitionBy(*DOC_FIELD)
    ordered = everyone.orderBy(F.col("score").desc(), "first_rank")
    return (
        scored_forms(obs, weights)
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("runner_up", F.lead("score").over(ordered))
        .withColumn("total", F.sum("score").over(everyone))
        .withColumn("share", F.least(F.lit(0.99), F.col("score").cast("double") / F.col("total").cast("double")))
        .withColumn("margin", (F.col("score") - F.col("runner_up")).cast("double"))
    )


def weighted_vote(
    obs: DataFrame, weights: Mapping[str, float] | None = None, margin: float = 0.12, min_conf: float = 0.70
) -> DataFrame:
    """Value with the highest weighted support; close or weak wins are marked as conflicts."""
    won = rank_candidates(obs, weights).where("place = 1")
    close = F.coalesce(F.col("margin") < margin, F.lit(False))
    weak = F.col("share") < min_conf
    conflict = close | weak
    return won.select(
        *DOC_FIELD,
        F.col("display").alias("value"),
        rnd(F.col("share"), 4).alias("confidence"),
        conflict.alias("conflict"),
        F.when(conflict, F.when(F.col("runner_up").isNotNull(), "engine_disagreement").otherwise("low_confidence")).alias("reason"),
        (conflict & weak).alias("needs_review"),
    )


# --- aggregates over reconciled fields ------------------------------------------------------------------

def expected_count(doc_type: Column) -> Column:
    table = {t: len(fields) for t, fields in K.EXPECTED_FIELDS.items()}
    found = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), doc_type)
    return F.coalesce(found, F.lit(len(K.COMMON_FIELDS)))


def is_expected(doc_type: Column, field: Column) -> Column:
    chain = None
    for name, fields in K.EXPECTED_FIELDS.items():
        chain = F.when(doc_type == name, field.isin(fields)) if chain is None else chain.when(doc_type == name, field.isin(fields))
    return chain.otherwise(field.isin(K.COMMON_FIELDS))


def expected_fields(docs: DataFrame, *extra: str) -> DataFrame:
    """Every expected field of every document, as rows; a map-side expansion without a join."""
    chain = None
    for name, fields in K.EXPECTED_FIELDS.items():
        names = F.array(*[F.lit(f) for f in fields])
        chain = F.when(F.col("doc_type") == name, names) if chain is None else chain.when(F.col("doc_type") == name, names)
    listed = chain.otherwise(F.array(*[F.lit(f) for f in K.COMMON_FIELDS]))
    return docs.select("batch_id", "doc_id", "doc_type", *extra, F.explode(listed).alias("field"))


def align(reconciled: DataFrame, docs: DataFrame) -> DataFrame:
    """Expected fields with their reconciled value; fields nobody read become MISSING rows.

    The reconciled fields of a document (at most one row per field) are packed before they meet the
    documents, and the expectation is expanded last, so the many MISSING rows are never shuffled.
    """
    keys = ["batch_id", "doc_id", "doc_type"]
    packed = reconciled.where(is_expected(F.col("doc_type"), F.col("field"))).groupBy(*keys).agg(
        F.collect_list(F.struct("field", "value", "confidence", "level", "disagreement")).alias("have")
    )
    listed = expected_fields(docs.select(*keys).distinct().join(packed, keys, "left"), "have")
    found = listed.withColumn("hit", F.get(F.filter("have", lambda x: x["field"] == F.col("field")), 0))
    return found.select(
        *keys, "field", F.col("hit.value").alias("value"),
        F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("hit.level", F.lit("MISSING")).alias("level"),
        F.coalesce("hit.disagreement", F.lit(False)).alias("disagreement"),
    )


def agreement_rate(reconciled: DataFrame, docs: DataFrame) -> DataFrame:
    """Per batch: share of expected fields without disagreement; a missing field counts as agreement."""
    disputed = (
        reconciled.where(F.col("disagreement") & is_expected(F.col("doc_type"), F.col("field")))
        .groupBy("batch_id").agg(F.count(F.lit(1)).alias("disputed"))
    )
    total = docs.groupBy("batch_id").agg(F.sum(expected_count(F.col("doc_type"))).alias("fields"))
    return total.join(disputed, "batch_id", "left").select(
        "batch_id", "fields", F.coalesce("disputed", F.lit(0)).alias("disputed"),
        rnd(F.lit(1.0) - F.coalesce("disputed", F.lit(0)) / F.col("fields"), 3).alias("agreement_rate"),
    )


def two_engine_rate(obs: DataFrame) -> DataFrame:
    """Per batch: share of read fields on which at least two engines gave the same form."""
    best = (
        _ballots(obs).where("norm is not null").groupBy(*DOC_FIELD).agg(F.max("votes").alias("best"))
    )
    return best.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("fields"), rnd(F.count_if(F.col("best") >= 2) / F.count(F.lit(1)), 3).alias("agreement_rate")
    )


def average_confidence(reconciled: DataFrame, weighted: bool = False, both: bool = False) -> DataFrame:
    """Mean confidence per document; critical fields count twice in the weighted form. ``both`` gives the plain and the weighted mean of one pass over the fields."""
    twice = F.when(F.col("field").isin(K.CRITICAL_FIELDS), 2).otherwise(1)

    def mean(w: Column) -> Column:
        return rnd(F.sum(dec(F.col("confidence"), 6) * w).cast("double") / F.sum(w), 4)

    means = [mean(F.lit(1)).alias("avg_confidence"), mean(twice).alias("weighted_confidence")] if both else [mean(twice if weighted else F.lit(1)).alias("avg_confidence")]
    return reconciled.groupBy("batch_id", "doc_id").agg(*means)


def combine_documents(reconciled: DataFrame, doc_order: Column) -> DataFrame:
    """One value per batch and field; the later document overwrites the earlier one."""
    return reconciled.where("value is not null").groupBy("batch_id", "field").agg(
        F.max_by(F.struct("value", "confidence"), doc_order).alias("last")
    ).select("batch_id", "field", "last.value", "last.confidence")


def engine_quorum(obs: DataFrame, routes: DataFrame | None = None, engines: int = len(K.ENGINES), need: int = 2) -> DataFrame:
    """Engines that returned data per document; fewer than ``need`` is an error, the fast path needs one."""
    seen = obs.groupBy("batch_id", "doc_id").agg(
        F.count_distinct(F.when(F.col("value").isNotNull(), F.col("engine_rank"))).alias("engines")
    )
    if routes is not None:
        seen = seen.join(routes.select("doc_id", "route"), "doc_id", "left")
    else:
        seen = seen.withColumn("route", F.lit("STANDARD"))
    floor = F.when(F.col("route") == "FAST_PATH", 1).otherwise(need)
    return seen.select(
        "batch_id", "doc_id", "route", "engines", (F.lit(engines) - F.col("engines")).alias("failed_engines"),
        F.when(F.col("engines") >= floor, "ok").otherwise("error").alias("status"),
    )


def distinct_values(reconciled: DataFrame) -> DataFrame:
    """Distinct values of a field across the documents of a batch."""
    return reconciled.where("value is not null").select("batch_id", "field", "value").distinct()


# --- operator corrections ---------------------------------------------------------------------------------

def apply_corrections(reconciled: DataFrame, corrections: DataFrame, keep_before: bool = False) -> DataFrame:
    """Overlay the last correction of each field; a field that was never read enters with full confidence. With ``keep_before`` each row also
    lists the values that its field had before.

    The fields of a document meet its corrections in one row by document, so that frames which lie by document are not moved again."""
    last = corrections.where("corrected_value is not null").groupBy("batch_id", "doc_id", "field").agg(
        F.max_by("corrected_value", F.struct("ts", "correction_id")).alias("corrected_value")
    )
    keys = ["batch_id", "doc_id"]
    read = reconciled.select(*keys, F.struct("field", "value", "confidence", "source").alias("read"))
    both = read.unionByName(last.select(*keys, F.struct("field", "corrected_value").alias("fix")), allowMissingColumns=True)
    packed = both.groupBy(*keys).agg(F.collect_list("read").alias("read"), F.collect_list("fix").alias("fix"))
    named = F.col("batch_id").isNotNull() & F.col("doc_id").isNotNull()
    same = lambda r, f: named & F.coalesce(r["field"] == f["field"], F.lit(False))

    def before(field: Column) -> list[Column]:
        had = F.when(named, F.transform(F.filter("read", lambda r: r["field"] == field), lambda r: r["value"]))
        return [had.alias("before")] if keep_before else []

    def corrected(r: Column) -> Column:
        fix = F.get(F.filter("fix", lambda f: same(r, f)), 0)["corrected_value"]
        return F.struct(
            r["field"].alias("field"), F.coalesce(fix, r["value"]).alias("value"), F.coalesce(r["confidence"], F.lit(1.0)).alias("confidence"),
            F.when(fix.isNotNull(), "operator").otherwise(r["source"]).alias("source"), *before(r["field"]),
        )

    def entered(f: Column) -> Column:
        return F.struct(f["field"].alias("field"), f["corrected_value"].alias("value"), F.lit(1.0).alias("confidence"), F.lit("operator").alias("source"), *before(f["field"]))

    new = F.filter("fix", lambda f: ~F.exists("read", lambda r: same(r, f)))
    return packed.select(*keys, F.inline(F.concat(F.transform("read", corrected), F.transform(new, entered))))


def correction_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed fields with their value before and after; a field that enters by correction has none before.

    Rows that kept their values of before (``apply_corrections(keep_before=True)``) are read alone; else the fields before are packed by document and met."""
    keys = ["batch_id", "doc_id"]
    if "before" in after.columns:
        met = after.select(*keys, "field", F.explode_outer("before").alias("before_state"), F.col("value").alias("after_state"))
        return met.where(~F.col("before_state").eqNullSafe(F.col("after_state")))
    old = before.groupBy(*keys).agg(F.collect_list(F.struct("field", F.col("value").alias("before_state"))).alias("old"))
    new = after.select(*keys, "field", F.col("value").alias("after_state")).join(old, keys, "left")
    own = F.filter("old", lambda o: o["field"] == F.col("field"))
    met = new.select(*keys, "field", F.explode_outer(own).alias("own"), "after_state").select(*keys, "field", "own.before_state", "after_state")
    return met.where(~F.col("before_state").eqNullSafe(F.col("after_state")))


def merge_containers(main: DataFrame, attachment: DataFrame) -> DataFrame:
    """Container rows of main and attachment pages, one per number; the main page wins."""
    keys = ["batch_id", "container"]
    both = main.withColumn("is_main", F.lit(1)).unionByName(attachment.withColumn("is_main", F.lit(0)))
    rest = [c for c in main.columns if c not in keys]
    return both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("is_main", *rest)).alias("row"), F.max("is_main").alias("on_main")
    ).select(*keys, "row.*", "on_main")


def cap_confidence(reconciled: DataFrame, docs: DataFrame, limit: float = 0.80, max_empty: float = 0.60) -> DataFrame:
    """Documents with mostly empty expected fields are DEGRADED and their confidences capped.

    The fields of a document are packed with the names of its filled ones before they meet the documents, so that they are made once."""
    keys = ["batch_id", "doc_id"]
    rest = [c for c in reconciled.columns if c not in keys]
    hit = F.col("value").isNotNull() & is_expected(F.col("doc_type"), F.col("field"))
    packed = reconciled.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("rows"), F.size(F.collect_set(F.when(hit, F.col("field")))).alias("filled"))
    empty = 1 - F.col("filled") / expected_count(F.col("doc_type"))
    routed = docs.select(*keys, "doc_type").join(packed, keys).select(*keys, "rows", F.when(empty > max_empty, "DEGRADED").otherwise("STANDARD").alias("route"))
    return routed.select(*keys, "route", F.inline("rows")).select(
        *keys, *rest, "route"
    ).withColumn("confidence", F.when(F.col("route") == "DEGRADED", F.least("confidence", F.lit(limit))).otherwise(F.col("confidence")))


def needs_fallback(doc_state: DataFrame, quality: float = 0.85, confidence: float = 0.80) -> DataFrame:
    """Per batch: must the other engines be asked? True when any of its documents is weak."""
    c = F.col
    weak = c("has_error") | ~c("has_data") | (c("quality") < quality) | (
        ~c("digital_text") & ((c("min_confidence") < confidence) | c("has_conflict") | (c("candidates") > 1))
    )
    return doc_state.groupBy("batch_id").agg(
        F.bool_or(F.coalesce(weak, F.lit(False))).alias("needs_fallback"), F.count_if(weak).alias("weak_documents")
    )


def hs_needed(fields: DataFrame, batches: DataFrame, limit: float = 0.5) -> DataFrame:
    """Batches to send to tariff search: not enterprise, and some document without a code or a weak one."""
    weak = fields.where("field = 'hs_code'").groupBy("batch_id").agg(
        F.bool_or(F.col("value").isNull() | (F.col("confidence") < limit)).alias("weak")
    )
    return batches.select("batch_id", "tier").join(weak, "batch_id", "left").select(
        "batch_id", "tier",
        ((F.col("tier") != "enterprise") & F.coalesce("weak", F.lit(True))).alias("hs_needed"),
    )


def hs_search_documents(fields: DataFrame, limit: float = K.HS_SEARCH_CONFIDENCE) -> DataFrame:
    """Documents whose tariff code is to be searched for: not read, of the wrong form, or read with little confidence. With the reason."""
    code = fields.where("field = 'hs_code'")
    reason = (
        F.when(F.coalesce("value", F.lit("")) == "", "empty").when(~V.valid_hs(F.col("value")), "format")
        .when(F.coalesce("confidence", F.lit(0.0)) < limit, "confidence")
    )
    return code.select("batch_id", "doc_id", "value", "confidence", reason.alias("reason")).where(F.col("reason").isNotNull())
