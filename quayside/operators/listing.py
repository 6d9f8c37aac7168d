"""Lists, searches, filters and routing decisions over batches, documents and events."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import is_filled
from quayside.operators.ordered import pages


def list_batches(df: DataFrame, company: int | str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest batches first; the id breaks ties so pages never overlap."""
    if company is not None:
        df = df.where(F.col("company_id") == company)
    return df.orderBy(F.col("created_at").desc(), "batch_id").offset(offset).limit(limit)


def batch_detail(batches: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per batch with its children summarised; each child is aggregated before the join, so nothing fans out."""
    docs = documents.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_type").alias("document_types")
    )
    values = fields.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("fields"), F.count("value").alias("filled"), F.count_if("disagreement").alias("disputed")
    )
    return batches.join(docs, "batch_id", "left").join(values, "batch_id", "left").na.fill(0)


def status_search(df: DataFrame, tab: str = "all", text: str = "") -> DataFrame:
    """Tab filter and contains-search over reference and importer, both case-insensitive."""
    if tab == "processing":
        df = df.where(F.col("status").isin(K.PROCESSING_STATUSES))
    elif tab != "all":
        df = df.where(F.col("status") == tab)
    want = F.lit(text.lower())
    return df.where(F.contains(F.lower(batch_reference(F.col("batch_id"))), want) | F.contains(F.lower(F.coalesce("importer", F.lit(""))), want))


def text_search(df: DataFrame, text: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive contains over several columns."""
    want = F.lit(text.lower())
    test = F.lit(False)
    for c in cols:
        test = test | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), want)
    return df.where(test)


def visible_to(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Who may see each row: every member of its company by name, and the all-seeing staff as one group.

    Staff (admins and supervisors) see everything, so listing them per row would multiply the
    table by the number of staff; one ``staff`` row per batch says the same.
    """
    member = profiles.where(~F.col("role").isin("admin", "supervisor")).select(
        "company_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("viewer")
    )
    own = df.join(member, "company_id").select("viewer", *df.columns)
    return own.unionByName(df.select(F.lit("staff").alias("viewer"), *df.columns))


def visible_batches(df: DataFrame, profiles: DataFrame, user) -> DataFrame:
    """Rows one user may see: those of the user's companies, all for staff. Decided in the plan; nothing is read beforehand."""
    me = profiles.where(F.col("user_id") == user)
    staff = F.coalesce(me.agg(F.bool_or(F.col("role").isin("admin", "supervisor")).alias("staff")).scalar(), F.lit(False))
    mine = me.select(F.col("company_id").alias("_mine")).distinct()
    return df.join(mine, df["company_id"] == F.col("_mine"), "left").where(staff | F.col("_mine").isNotNull()).drop("_mine")


def detail_pages(children: Mapping[str, tuple[DataFrame, Sequence[str]]], size: int = 1000, crowded: bool = True) -> DataFrame:
    """(batch_id, child, page, items): child rows of each batch as JSON in the given order, ``size`` per page, so that no array grows with a batch.

    ``children`` maps a name to its rows and the columns that order them, unique within a batch. ``crowded`` says that a batch may be too large for one task."""
    parts = []
    for name, (rows, order) in children.items():
        body = F.to_json(F.struct(*[c for c in rows.columns if c != "batch_id"]), {"ignoreNullFields": "false"})
        paged = pages(rows.withColumn("body", body), ["batch_id"], [F.col(c) for c in order], F.col(order[0]), F.col("body"), size, crowded)
        parts.append(paged.select("batch_id", F.lit(name).alias("child"), "page", "items"))
    return functools.reduce(DataFrame.unionByName, parts)


def last_write(fields: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last written row of each key."""
    return fields.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def completeness(fields: DataFrame, required: Sequence[str] = tuple(K.REQUIRED_FIELDS)) -> DataFrame:
    """Filled required fields over required fields; blank and zero count as missing."""
    hit = F.col("field").isin(list(required)) & is_filled(F.col("value"))
    return fields.groupBy("batch_id").agg(
        (F.count_distinct(F.when(hit, F.col("field"))) / F.lit(float(len(required)))).alias("completeness")
    )


def route_document(has_text: Column, quality: Column) -> Column:
    return F.when(has_text & (quality >= 0.95), "FAST_PATH").when(quality >= 0.5, "STANDARD").otherwise("DEGRADED")


def dense_text(chars: Column, pages: Column, confidence: Column) -> Column:
    """Is the text layer good enough to skip the other engines?"""
    return (confidence >= 0.95) & (chars >= 250) & (chars / F.greatest(pages, F.lit(1)) >= 80)


def page_type(page: Column, density: Column, text: Column | None = None) -> Column:
    """MAIN for the first page, else by ink density; clause headings mark terms and conditions."""
    kind = F.when(page == 1, "MAIN")
    if text is not None:
        kind = kind.when(text.rlike(r"\bDEFINITIONS\b"), "TC")
    return kind.when(density > 0.15, "TC").when(density > 0.05, "ATTACHMENT").otherwise("UNKNOWN")


def keep_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_type").isin("MAIN", "ATTACHMENT"))


def review_gate(score: Column, probability: Column, flagged: Column) -> dict[str, Column]:
    return {
        "needs_review": flagged | (score < K.MIN_AUTO_SCORE) | (probability >= K.REVIEW_PROBABILITY),
        "blocked": score < K.MIN_SUBMIT_SCORE,
    }


def submit_checklist(row: Mapping[str, Column]) -> dict[str, Column]:
    """One boolean per condition of submission, and all of them together."""
    checks = {
        "criticals_pass": row["critical"] == 0,
        "score_ok": row["score"] >= K.MIN_SUBMIT_SCORE,
        "nib_ok": F.coalesce(row["nib"].rlike(r"^\d{13}$"), F.lit(False)),
        "npwp_ok": row["npwp_ok"],
        "vessel_ok": row["vessel_status"] != "critical",
        "permits_ok": row["permit_gaps"] == 0,
    }
    everything = F.lit(True)
    for c in checks.values():
        everything = everything & c
    return {**checks, "can_submit": everything}


def age_label(ts: Column, as_of: Column) -> Column:
    minutes = F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 60000000), F.lit(0))
    hours = F.floor(minutes / 60)
    return (
        F.when(ts.isNull() | (minutes < 1), "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" d ago")))
    )


def batch_reference(batch_id: Column) -> Column:
    text = batch_id.cast("string")
    return F.when(F.coalesce(text, F.lit("")) == "", "PIB-PENDING").otherwise(F.concat(F.lit("PIB-"), F.upper(F.left(text, F.lit(8)))))


def status_flags(status: Column, batch_id: Column) -> dict[str, Column]:
    working = status.isin([s for s in K.PROCESSING_STATUSES if s != "processing"])
    label = F.when(working, "Processing OCR").when(status == "review_ready", "Awaiting Review").otherwise(
        F.regexp_replace(F.coalesce(status, F.lit("Ready")), "^([^_]*)_", "$1 ")
    )
    return {"is_processing": working, "status_label": label, "reference": batch_reference(batch_id)}


def next_status(has_error: Column, has_fields: Column, validated: Column, needs_review: Column) -> Column:
    return F.when(has_error, "error").when(needs_review, "review_ready").when(validated, "validated").when(has_fields, "ocr_complete").otherwise("error")


def domain_violations(df: DataFrame, key: str, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Violations as rows; ``checks`` maps a name to (condition that must hold, offending value). Null passes."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(True)).alias("ok"), v.cast("string").alias("value")) for n, (ok, v) in checks.items()]
    )
    return df.select(key, F.inline(cells)).where("not ok").drop("ok")


def expired(df: DataFrame, as_of: Column, days: int = 7, partial_hours: int = 48) -> Column:
    """Open batches past their time: a week for full ones, two days for partial ones."""
    age_h = (F.unix_seconds(as_of) - F.unix_seconds(df["created_at"])) / 3600
    return ~df["status"].isin(K.TERMINAL_STATUSES) & (age_h > F.when(df["partial"], partial_hours).otherwise(days * 24))


def new_rows_only(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of the keys present in ``new`` give way to the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], on_conflict: str = "update") -> DataFrame:
    """Insert with conflict handling: ``update`` takes the new row, ``nothing`` keeps the old one."""
    if on_conflict == "nothing":
        return old.unionByName(new_rows_only(old, new, keys))
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *rest)).alias("_row")).select(*keys, "_row.*").select(*old.columns)
