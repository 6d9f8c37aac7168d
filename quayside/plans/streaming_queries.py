"""Streams drained over the whole event and line tables, next to the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.history_queries import ALLOWED, _STREAK
from quayside.plans.rules_queries import TYPED, fields_of, shape_typed
from quayside.sources.dims import load_rules
from quayside.sources.tables import read_table
from quayside.streaming import jobs as J
from quayside.streaming import runner as R


def event_stream(spark, base) -> DataFrame:
    return B.shape_events(R.table_stream(spark, base, "events"))


def closed_feed(spark, base) -> tuple[DataFrame, R.Closing]:
    """The events, and the row that closes a replay of them."""
    closing = R.closing_row(read_table(spark, base, "events"), "ts", "10 DAYS", "closing")
    return event_stream(spark, base).unionByName(B.shape_events(closing.stream)), closing


@query("audit_append", oracle("SELECT event_id, batch_id, action, strftime(ts, '%Y-%m-%d') AS day FROM b4", "b4"))
def _audit(spark, base):
    log = event_stream(spark, base).select("event_id", "batch_id", "action", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return R.append_to_table(log, "audit", ["day"]).select("event_id", "batch_id", "action", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("change_feed", oracle("SELECT event_id, batch_id, amount FROM b4 WHERE action = 'accepted'", "b4"))
def _feed(spark, base):
    return R.append_to_table(event_stream(spark, base).where("action = 'accepted'").select("event_id", "batch_id", "amount"), "feed")


@query("latest_status", oracle("SELECT batch_id, arg_max(action, (ts, event_id)) AS status, arg_max(amount, (ts, event_id)) FILTER (k % 3 > 0) AS amount, count(*) AS updates FROM b4 GROUP BY 1", "b4"))
def _latest(spark, base):
    feed = event_stream(spark, base).withColumn("amount", F.when(F.pmod("k", F.lit(3)) > 0, F.col("amount")))
    return J.latest_status(R.each_batch_to_table(feed, "status", J.status_changes))


@query("event_log", oracle("SELECT batch_id, count(*) AS events, bool_or(action = 'accepted') AS done FROM b4 GROUP BY 1", "b4"))
def _log(spark, base):
    log = R.append_to_table(event_stream(spark, base).select("batch_id", "event_id", "action"), "log")
    return J.done_batches(log, ["accepted"])


@query("status_machine_stream", oracle("""SELECT event_id, from_action, action FROM (SELECT *, lag(action) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS from_action FROM b4)
    WHERE from_action IS NOT NULL AND from_action <> action AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = from_action AND b = action)""", "b4", allowed=ALLOWED))
def _machine(spark, base):
    feed, closing = closed_feed(spark, base)
    return R.append_to_table(J.transition_violations(feed), "transitions", closing=closing)


@query("expiry_timer", oracle("""SELECT batch_id, born AS created_us, born + 172800000000 AS expired_us FROM (SELECT batch_id, min(epoch_us(ts)) AS born FROM b4 GROUP BY 1) f
    WHERE NOT EXISTS (SELECT 1 FROM b4 e WHERE e.batch_id = f.batch_id AND action = 'accepted' AND epoch_us(ts) <= born + 172800000000)""", "b4"))
def _expiry(spark, base):
    feed, closing = closed_feed(spark, base)
    return R.append_to_table(J.expiry(feed, 48, ("accepted",)), "expiry", closing=closing).where("batch_id is not null")


@query("poll_to_terminal", oracle("SELECT batch_id, arg_min(action, (ts, event_id)) AS status, arg_min(event_id, (ts, event_id)) AS event_id FROM b4 WHERE action IN ('accepted', 'rejected') GROUP BY 1", "b4"))
def _poll(spark, base):
    return J.first_terminal(R.each_batch_to_table(event_stream(spark, base), "terminal", J.terminal_changes))


@query("drift_stream", oracle("SELECT strftime(d, '%Y-%m-%d') AS start, field_name, count(*) AS corrections FROM (SELECT field_name, unnest(generate_series(ts::DATE::TIMESTAMP - INTERVAL 29 DAY, ts::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM b4) GROUP BY 1, 2 HAVING count(*) >= 50", "b4"))
def _drift(spark, base):
    return R.upsert_to_table(J.drift_windows(event_stream(spark, base)), "drift", ["start", "field_name"])


@query("quota_stream", oracle("SELECT strftime(ts, '%Y-%m') AS month, sum(pages)::BIGINT AS pages, count(*) AS requests FROM b4 GROUP BY 1", "b4"))
def _quota(spark, base):
    return J.quota_per_month(R.each_batch_to_table(event_stream(spark, base), "quota", J.quota_changes))


@query("breaker_stream", oracle("SELECT event_id, streak, epoch_us(ts) + 60000000 AS open_until_us FROM st WHERE failed AND streak >= 3", "b4", st=_STREAK))
def _breaker(spark, base):
    feed, closing = closed_feed(spark, base)
    return R.append_to_table(J.breaker(feed, F.col("action").isin("rejected", "preprocessing")), "breaker", closing=closing)


@query("idempotent_submit", oracle("SELECT DISTINCT idem_key FROM b4", "b4"))
def _idem(spark, base):
    return R.append_to_table(J.idempotent(event_stream(spark, base)), "idem").select("idem_key")


@query("position_ingest", oracle("SELECT DISTINCT imo, epoch_us(ts) AS at_us FROM positions WHERE heading BETWEEN 0 AND 359", "positions"))
def _positions(spark, base):
    feed = B.shape_positions(R.table_stream(spark, base, "events"))
    return R.append_to_table(J.ingest_positions(feed), "positions").select("imo", F.unix_micros("ts").alias("at_us"))


_CHECKED = """SELECT batch_id, doc_id, unnest(['CV001', 'CV003', 'CV004', 'CV011']) AS rule_id, unnest([length(hs_code) = 8, length(nib) = 13, length(npwp) = 15, true]) AS ok FROM typed"""


def validated(spark, base) -> DataFrame:
    """All fields of the arriving documents through all format rules."""
    rules = load_rules(spark)
    arriving = fields_of(shape_typed(B.shape_documents(R.table_stream(spark, base, "lineitem"))))
    return R.each_batch_to_table(arriving, "validate", lambda rows: J.rule_work(rows, rules))


@query("validate_stream", oracle("SELECT rule_id, count(*) AS checked, count(*) FILTER (ok) AS passed, round((count(*) FILTER (ok) / count(*)::DOUBLE)::DECIMAL(18,8), 6)::DOUBLE AS pass_rate FROM checked GROUP BY 1", "docs", typed=TYPED, checked=_CHECKED))
def _validate(spark, base):
    return J.rule_pass_rates(validated(spark, base))


@query("validate_stream_documents", oracle("SELECT batch_id, doc_id, count(*)::INT AS rules, count(*) FILTER (NOT ok)::INT AS failed, round((count(*) FILTER (ok) / count(*)::DOUBLE * 100)::DECIMAL(18,8), 1)::DOUBLE AS score, bool_and(ok) AS valid FROM checked GROUP BY 1, 2", "docs", typed=TYPED, checked=_CHECKED))
def _validate_documents(spark, base):
    return validated(spark, base).drop("results")


@query("latency_windows", oracle("""SELECT strftime(ts, '%Y-%m-%d') AS day, action, count(*) AS n, max(amount) AS slowest, quantile_disc(amount, 0.95) AS p95, count(*) FILTER (amount < 0) AS below, count(*) FILTER (amount >= 0 AND amount < 25) AS from_0, count(*) FILTER (amount >= 25 AND amount < 50) AS from_25,
    count(*) FILTER (amount >= 50 AND amount < 75) AS from_50, count(*) FILTER (amount >= 75 AND amount < 100) AS from_75, count(*) FILTER (amount >= 100) AS from_100 FROM b4 GROUP BY 1, 2""", "b4"))
def _latency(spark, base):
    return J.daily_latency(R.each_batch_to_table(event_stream(spark, base), "latency", J.latency_changes))


@query("outcome_join", oracle("""SELECT s.idem_key AS key, s.event_id AS submission, o.event_id AS decision, o.action AS outcome FROM b4 s JOIN b4 o ON s.idem_key = o.idem_key AND s.event_id % 2 = 0 AND o.event_id % 2 = 1
    AND o.ts >= s.ts AND o.ts <= s.ts + INTERVAL 1 DAY""", "b4"))
def _outcomes(spark, base):
    even = F.pmod("event_id", F.lit(2)) == 0
    return R.append_to_table(J.join_outcomes(event_stream(spark, base).where(even), event_stream(spark, base).where(~even)), "outcomes")


@query("review_sessions", oracle("""SELECT batch_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 1800000000 AS end_us, count(*) AS events FROM (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS prev FROM b4)) GROUP BY batch_id, s""", "b4"))
def _sessions(spark, base):
    feed, closing = closed_feed(spark, base)
    return R.append_to_table(J.review_sessions(feed), "sessions", closing=closing).where("batch_id is not null")
