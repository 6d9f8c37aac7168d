"""The streaming operators. Time is event time everywhere; lateness beyond the watermark is dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import rnd
from quayside.operators.rules import document_rules
from quayside.streaming.ordered import Step, expiring, in_order

LATE = "2 days"


# --- running views without state -----------------------------------------------------------------------------
# What a micro-batch adds to a running view is a small mergeable row per key: each micro-batch writes its own (``runner.each_batch_to_table``) and
# the view merges them. No state is held however many keys there are, rows may come in any order and as late as they like, and a key
# that was quiet for a year goes on where it was.


def status_changes(feed: DataFrame) -> DataFrame:
    """Per batch the newest status and amount among these rows; a null update changes nothing."""
    def newest(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", c))).alias(c)

    return feed.groupBy("batch_id").agg(newest("action"), newest("amount"), F.count(F.lit(1)).alias("updates"))


def latest_status(changes: DataFrame) -> DataFrame:
    """Current status and amount per batch from the changes of all micro-batches."""
    merged = changes.groupBy("batch_id").agg(F.max("action").alias("action"), F.max("amount").alias("amount"), F.sum("updates").alias("updates"))
    return merged.select("batch_id", F.col("action.action").alias("status"), F.col("amount.amount").alias("amount"), "updates")


def terminal_changes(observed: DataFrame, terminal=tuple(K.TERMINAL_STATUSES)) -> DataFrame:
    """Per batch the first terminal status among these rows."""
    hits = observed.where(F.col("action").isin(list(terminal)))
    return hits.groupBy("batch_id").agg(F.min(F.struct("ts", "event_id", "action")).alias("first"))


def first_terminal(changes: DataFrame) -> DataFrame:
    """First terminal status per batch from the changes of all micro-batches."""
    return changes.groupBy("batch_id").agg(F.min("first").alias("f")).select("batch_id", F.col("f.action").alias("status"), F.col("f.event_id").alias("event_id"))


def quota_changes(usage: DataFrame) -> DataFrame:
    """Pages per calendar month among these rows."""
    return usage.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("requests"))


def quota_per_month(changes: DataFrame) -> DataFrame:
    """Pages per calendar month from the changes of all micro-batches: a busy month is one row for each of them."""
    return changes.groupBy("month").agg(F.sum("pages").alias("pages"), F.sum("requests").alias("requests"))


LATENCY_BINS = (0, 25, 50, 75, 100)  # lower ends; the last bin is open, values below the first have their own
SKETCH_K = 4096  # items of a quantile sketch: ranks are within 0.1 % of the exact ones, and exact up to so many values


def latency_changes(durations: DataFrame) -> DataFrame:
    """Per day and action a quantile sketch and the histogram of these rows."""
    ends = (*LATENCY_BINS[1:], None)
    inside = [F.count_if((F.col("amount") >= lo) & (F.lit(True) if hi is None else F.col("amount") < hi)).alias(f"from_{lo}") for lo, hi in zip(LATENCY_BINS, ends)]
    return durations.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action").agg(
        F.count(F.lit(1)).alias("n"), F.max("amount").alias("slowest"), F.kll_sketch_agg_double("amount", SKETCH_K).alias("sketch"),
        F.count_if(F.col("amount") < LATENCY_BINS[0]).alias("below"), *inside,
    )


def daily_latency(changes: DataFrame) -> DataFrame:
    """Latency figures per day and action from the changes of all micro-batches."""
    counts = ["n", "below", *(f"from_{lo}" for lo in LATENCY_BINS)]
    merged = changes.groupBy("day", "action").agg(
        *[F.sum(c).alias(c) for c in counts], F.max("slowest").alias("slowest"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch")
    )
    p95 = F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)).alias("p95")
    return merged.select("day", "action", "n", "slowest", p95, *counts[1:])


# --- streams with a watermark --------------------------------------------------------------------------------


def done_batches(log: DataFrame, end_events=tuple(K.END_EVENTS)) -> DataFrame:
    """Batch view of the event log: is the batch finished?"""
    return log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("events"), F.bool_or(F.col("action").isin(list(end_events))).alias("done"))


def drift_windows(corrections: DataFrame, minimum: int = K.DRIFT_MIN_CORRECTIONS) -> DataFrame:
    """Corrections per field in 30-day windows sliding by a day; alerts at the threshold. Update mode."""
    return (
        corrections.withWatermark("ts", LATE)
        .groupBy(F.window("ts", f"{K.DRIFT_DAYS} days", "1 day"), "field_name").agg(F.count(F.lit(1)).alias("corrections"))
        .where(F.col("corrections") >= minimum)
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "field_name", "corrections")
    )


def idempotent(submissions: DataFrame, key: str = "idem_key", within: str = LATE) -> DataFrame:
    """One row per idempotency key among repeats within the lateness bound. Append mode."""
    return submissions.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def ingest_positions(feed: DataFrame, within: str = LATE) -> DataFrame:
    """Vessel positions with a possible heading, once per vessel and time. Append mode."""
    sound = feed.where(F.col("heading").isNull() | F.col("heading").between(0, 359))
    return sound.withWatermark("ts", within).dropDuplicatesWithinWatermark(["imo", "ts"])


def join_outcomes(submissions: DataFrame, outcomes: DataFrame, key: str = "idem_key", within: str = "1 day") -> DataFrame:
    """Submissions with their outcome inside the time limit; both sides forget what the watermarks rule out. Append mode."""
    s = submissions.withWatermark("ts", LATE).select(F.col(key).alias("key"), F.col("ts").alias("submitted"), F.col("event_id").alias("submission"))
    o = outcomes.withWatermark("ts", LATE).select(F.col(key).alias("key_o"), F.col("ts").alias("decided"), "event_id", F.col("action").alias("outcome"))
    return s.join(
        o, (F.col("key") == F.col("key_o")) & (F.col("decided") >= F.col("submitted")) & (F.col("decided") <= F.col("submitted") + F.expr(f"INTERVAL {within}"))
    ).select("key", "submission", F.col("event_id").alias("decision"), "outcome")


def review_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity per batch. Append mode: a session comes out once the watermark has passed its gap."""
    return (
        log.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "batch_id").agg(F.count(F.lit(1)).alias("events"))
        .select("batch_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "events")
    )


# --- custom state ----------------------------------------------------------------------------------------------
# Rows of a key are judged in event-time order (``ordered``), whatever the order of files and micro-batches.

_ALLOWED = {(a, b) for a, bs in K.LIFE_CYCLE.items() for b in bs}


def _check_transitions(last: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    before = rows["tag"].shift(1)
    before.iloc[0] = last[0] if last else None
    changed = before.notna() & rows["tag"].notna() & (before != rows["tag"])
    illegal = [bool(c) and (a, b) not in _ALLOWED for c, a, b in zip(changed, before, rows["tag"], strict=True)]
    bad = rows[illegal]
    return (rows["tag"].iloc[-1],), pd.DataFrame({"event_id": bad["event_id"], "from_action": before[illegal], "action": bad["tag"]})


def transition_violations(log: DataFrame, late: str = LATE) -> DataFrame:
    """Status changes the life cycle does not know, once the watermark has passed them. Append mode."""
    return in_order(log, "batch_id", F.col("action"), _check_transitions, "last string", "event_id bigint, from_action string, action string", late)


def _count_failures(threshold: int, open_seconds: int) -> Step:
    def run(streak: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        failed = rows["tag"] == "true"
        runs = (~failed).cumsum()
        streaks = failed.groupby(runs).cumsum() + (runs == 0) * (streak[0] if streak else 0)
        hit = failed & (streaks >= threshold)
        until = rows["us"] + open_seconds * 1_000_000
        return (int(streaks.iloc[-1]),), pd.DataFrame({"event_id": rows["event_id"][hit], "streak": streaks[hit], "open_until_us": until[hit]})

    return run


def breaker(log: DataFrame, failed: Column, threshold: int = 3, open_seconds: int = 60, late: str = LATE) -> DataFrame:
    """Failures that complete a streak, with the end of the pause they cause, once the watermark has passed them. Append mode."""
    step = _count_failures(threshold, open_seconds)
    return in_order(log, "batch_id", F.coalesce(failed, F.lit(False)), step, "streak bigint", "event_id bigint, streak bigint, open_until_us bigint", late)


def expiry(log: DataFrame, hours: int = 48, terminal=tuple(K.TERMINAL_STATUSES), late: str = LATE) -> DataFrame:
    """Batches without a terminal status within ``hours`` of their first event. Append mode."""
    return expiring(log, "batch_id", F.col("action").isin(list(terminal)), hours, late).withColumnRenamed("key", "batch_id")


def rule_work(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Work of one micro-batch of the validation stream: the format rules over all fields, one row per document with its results (at most one a rule) and its score, the share of rules
    that passed. A document is valid when no rule of severity ERROR failed."""
    result = F.struct("rule_id", "severity", "passed")
    per = document_rules(fields, rules).groupBy("batch_id", "doc_id").agg(F.array_sort(F.collect_list(result)).alias("results"))
    failed = F.filter("results", lambda r: ~r["passed"])
    blocking = F.exists("results", lambda r: ~r["passed"] & (r["severity"] == "ERROR"))
    share = (F.size("results") - F.size(failed)) / F.size("results")
    return per.select("batch_id", "doc_id", "results", F.size("results").alias("rules"), F.size(failed).alias("failed"), rnd(share * 100, 1).alias("score"), (~blocking).alias("valid"))


def rule_pass_rates(work: DataFrame) -> DataFrame:
    """Pass rate per rule over the documents of all micro-batches."""
    each = work.select(F.explode("results").alias("r")).groupBy(F.col("r.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("checked"), F.count_if("r.passed").alias("passed"))
    return each.withColumn("pass_rate", rnd(F.col("passed") / F.col("checked"), 6))
