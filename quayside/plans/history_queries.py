"""History, dashboard and ordered queries over batches and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import rnd
from quayside.functions.normalize import normalize_carrier_date
from quayside.operators import history as H
from quayside.operators.ordered import hour_bucket, neighbour
from quayside.operators.maritime import resolve_port
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.scalar_queries import pick
from quayside.plans.scoring_queries import AG, scored

EVENTS_AS_OF = "2024-01-31 00:00:00"


def _r(expr: str, n: int) -> str:
    return f"round(({expr})::DECIMAL(18,8), {n})::DOUBLE"


def at():
    return F.to_timestamp(F.lit(EVENTS_AS_OF))


@query("historical_rates", oracle(f"SELECT company_id, count(*) AS submissions, count(*) FILTER (rejected) AS rejections, {_r('count(*) FILTER (rejected) / count(*)::DOUBLE', 6)} AS rejection_rate FROM b1 GROUP BY 1", "b1"))
def _rates(spark, base):
    return H.rejection_rates(B.batches(spark, base), ["company_id"])


@query("drift_alerts", oracle(f"SELECT field_name, count(*) AS corrections FROM b4 WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1 HAVING count(*) >= 50", "b4"))
def _drift(spark, base):
    return H.drift_alerts(B.events(spark, base), at())


@query("drift_order", oracle("SELECT field_name, corrections, row_number() OVER (ORDER BY corrections DESC, field_name) AS place FROM (SELECT field_name, count(*) AS corrections FROM b4 GROUP BY 1)", "b4"))
def _order(spark, base):
    from pyspark.sql import Window

    counted = B.events(spark, base).groupBy("field_name").agg(F.count(F.lit(1)).alias("corrections"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("corrections"), "field_name")))


@query("retrain_trigger", oracle(f"""SELECT unused, last_day, unused >= 100 AS by_unused, last_day >= 100 AS by_last_day, unused >= 100 OR since >= 604800 AS by_either FROM (SELECT count(*) FILTER (action <> 'accepted') AS unused,
    count(*) FILTER (ts <= TIMESTAMP '{EVENTS_AS_OF}' AND ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR) AS last_day, epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(max(ts) FILTER (action = 'accepted')) AS since FROM b4)""", "b4"))
def _retrain(spark, base):
    return H.retrain_trigger(B.events(spark, base).withColumn("used", F.col("action") == "accepted"), at())


_DUR = "SELECT batch_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 AS seconds FROM b4 GROUP BY 1"


def durations(spark, base):
    span = F.floor((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1000000)
    return B.events(spark, base).groupBy("batch_id").agg(span.alias("seconds"))


@query("platform_kpis", oracle(f"""SELECT *, {_r('accepted / decided::DOUBLE', 6)} AS acceptance_rate FROM (SELECT count(*) AS declarations, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status IN ('accepted','rejected')) AS decided,
    count(*) FILTER (status = 'review_ready') AS pending_review, count(DISTINCT company_id) AS active_companies FROM b1), (SELECT {_r('sum(score)::DOUBLE / count(*)', 4)} AS mean_score FROM scored),
    (SELECT {_r('sum(seconds)::DOUBLE / count(*)', 3)} AS mean_seconds, {_r('quantile_cont(seconds, 0.95)', 3)} AS p95_seconds FROM dur)""", "b1", "b3", "b4", **AG, dur=_DUR))
def _kpis(spark, base):
    return H.platform_kpis(B.batches(spark, base), scored(spark, base), durations(spark, base))


@query("company_rollup", oracle("SELECT tier, month, count(*) AS declarations, count(*) FILTER (status = 'accepted') AS accepted, grouping_id(tier, month)::INT AS level FROM (SELECT *, strftime(created_at, '%Y-%m') AS month FROM b1) GROUP BY ROLLUP (tier, month)", "b1"))
def _rollup(spark, base):
    return H.company_rollup(B.batches(spark, base))


_DWELL = "SELECT *, lead(ts) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS next_ts FROM b4"
_LAT = "SELECT action, 'agent_' || (k % 4)::VARCHAR AS engine, (epoch_us(next_ts) - epoch_us(ts)) // 1000000 AS seconds FROM dwell WHERE next_ts IS NOT NULL"


def latencies(spark, base):
    d = H.dwell_time(B.events(spark, base)).where("not is_open")
    return d.select("action", F.concat(F.lit("agent_"), F.pmod("k", F.lit(4)).cast("string")).alias("engine"), F.floor(F.col("dwell_micros") / 1000000).alias("seconds"))


_SLOTS = ", ".join(f"count(*) FILTER ((seconds >= 60)::INT + (seconds >= 300)::INT + (seconds >= 900)::INT + (seconds >= 3600)::INT + (seconds >= 14400)::INT = {i}) AS slot_{i}" for i in range(6))


@query("stage_latency", oracle(f"SELECT action, engine, count(*) AS n, {_SLOTS}, grouping_id(action, engine)::INT AS level FROM lat GROUP BY CUBE (action, engine)", "b4", dwell=_DWELL, lat=_LAT))
def _latency(spark, base):
    return H.latency_histogram(latencies(spark, base))


@query("latency_p95", oracle(f"SELECT action, {_r('quantile_cont(seconds, 0.95)', 4)} AS p95 FROM lat GROUP BY 1", "b4", dwell=_DWELL, lat=_LAT))
def _p95(spark, base):
    q = H.exact_quantile(latencies(spark, base), ["action"], "seconds", 0.95, F.floor(F.col("v") / 600))
    return q.select("action", rnd(F.col("quantile"), 4).alias("p95"))


@query("monthly_quota", oracle("SELECT strftime(ts, '%Y-%m') AS month, sum(pages)::BIGINT AS pages, greatest(5000 - sum(pages), 0)::BIGINT AS remaining, sum(pages) < 5000 AS allowed FROM b4 GROUP BY 1", "b4"))
def _quota(spark, base):
    return H.monthly_quota(B.events(spark, base))


@query("quota_running", oracle("SELECT event_id, used, used <= 5000 AS admitted FROM (SELECT event_id, (sum(pages) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM b4)", "b4"))
def _quota_running(spark, base):
    return H.quota_running(B.events(spark, base)).select("event_id", "used", "admitted")


@query("score_trend", oracle(f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS declarations, {_r('sum(score)::DOUBLE / count(*)', 4)} AS mean_score FROM scored JOIN b1 USING (batch_id) GROUP BY 1", "b1", "b3", **AG))
def _trend(spark, base):
    return H.score_trend(scored(spark, base).select("batch_id", "score").join(B.batches(spark, base).select("batch_id", "created_at"), "batch_id"))


@query("analytics_breakdowns", oracle(f"SELECT tier, priority, chapter, count(*) AS n, {_r('count(*) FILTER (rejected) / count(*)::DOUBLE', 6)} AS rejection_rate, grouping_id(tier, priority, chapter)::INT AS level FROM (SELECT b1.*, left(goods_code, 2) AS chapter FROM b1 JOIN items USING (batch_id)) GROUP BY CUBE (tier, priority, chapter)", "b1", "items"))
def _breakdown(spark, base):
    items = B.tariff_items(spark, base).select("batch_id", F.left("goods_code", F.lit(2)).alias("chapter"))
    return H.rejection_cube(B.batches(spark, base).join(items, "batch_id"), ["tier", "priority", "chapter"])


@query("correction_heat_map", oracle("SELECT field_name, isoyear(ts)::INT AS iso_year, week(ts)::INT AS week, count(*) AS corrections FROM b4 GROUP BY ALL", "b4"))
def _heat(spark, base):
    return H.correction_heat_map(B.events(spark, base))


@query("first_attempt_rate", oracle(f"SELECT count(*) AS batches, {_r('count(*) FILTER (ok) / count(*)::DOUBLE', 6)} AS first_attempt_rate FROM (SELECT batch_id, arg_min(action = 'accepted', (ts, event_id)) AS ok FROM b4 WHERE action IN ('accepted','rejected') GROUP BY 1)", "b4"))
def _first(spark, base):
    e = B.events(spark, base).where(F.col("action").isin("accepted", "rejected")).withColumn("accepted", F.col("action") == "accepted")
    return H.first_attempt_rate(e)


@query("aju_sequence", oracle("SELECT batch_id, strftime(created_at, '%Y%m%d%H%M%S') || lpad(company_id::VARCHAR, 6, '0') || lpad(row_number() OVER (PARTITION BY company_id ORDER BY created_at, batch_id)::VARCHAR, 6, '0') AS aju FROM b1", "b1"))
def _aju(spark, base):
    return H.aju_sequence(B.batches(spark, base)).select("batch_id", "aju")


@query("rolling_rejection", oracle(f"""SELECT batch_id, coalesce(prior, 0) AS prior, {_r('coalesce(r / nullif(prior, 0)::DOUBLE, 0)', 6)} AS rolling_rate FROM (SELECT batch_id, count(*) OVER w AS prior, count(*) FILTER (rejected) OVER w AS r FROM b1
    WINDOW w AS (PARTITION BY company_id ORDER BY created_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING))""", "b1"))
def _rolling(spark, base):
    return H.rolling_rejection(B.batches(spark, base), ["company_id"]).select("batch_id", "prior", "rolling_rate")


@query("days_since_rejection", oracle("SELECT batch_id, floor((epoch(created_at) - epoch(lastr)) / 86400)::DOUBLE AS days FROM (SELECT *, max(CASE WHEN rejected THEN created_at END) OVER (PARTITION BY company_id ORDER BY created_at, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastr FROM b1)", "b1"))
def _since(spark, base):
    return H.days_since_rejection(B.batches(spark, base)).select("batch_id", "days")


@query("dwell_time", oracle("SELECT event_id, action, next_ts IS NULL AS is_open, coalesce(epoch_us(next_ts) - epoch_us(ts), 0) AS dwell_micros FROM dwell", "b4", dwell=_DWELL))
def _dwell(spark, base):
    return H.dwell_time(B.events(spark, base)).select("event_id", "action", "is_open", "dwell_micros")


@query("attempt_guard", oracle("SELECT event_id, attempt, attempt <= 5 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS attempt FROM b4 WHERE action IN ('accepted', 'rejected'))", "b4"))
def _guard(spark, base):
    return H.attempt_guard(B.events(spark, base).where(F.col("action").isin("accepted", "rejected"))).select("event_id", "attempt", "allowed")


@query("kpi_delta", oracle(f"SELECT month, n, rejections, coalesce(n - lag(n) OVER (ORDER BY month), 0) AS change, {_r('coalesce(n / (lag(n) OVER (ORDER BY month))::DOUBLE - 1, 0)', 6)} AS change_rate FROM (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (rejected) AS rejections FROM b1 GROUP BY 1)", "b1"))
def _delta(spark, base):
    return H.kpi_delta(B.batches(spark, base))


@query("stratified_split", oracle("SELECT batch_id, status, CASE WHEN row_number() OVER (PARTITION BY status ORDER BY md5(batch_id::VARCHAR)) <= floor(count(*) OVER (PARTITION BY status) * 0.8) THEN 'train' ELSE 'test' END AS split FROM b1", "b1"))
def _split(spark, base):
    return H.stratified_split(B.batches(spark, base).select("batch_id", "status"), "status", "batch_id")


_STREAK = """SELECT *, n - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY batch_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS streak
    FROM (SELECT *, action IN ('rejected', 'preprocessing') AS failed, row_number() OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS n FROM b4)"""


@query("failure_streak", oracle("SELECT event_id, streak, epoch_us(ts) + 60000000 AS open_until_us FROM st WHERE failed AND streak >= 3", "b4", st=_STREAK))
def _streak(spark, base):
    s = H.failure_streaks(B.events(spark, base), F.col("action").isin("rejected", "preprocessing"))
    return s.select("event_id", "streak", F.unix_micros("open_until").alias("open_until_us"))


@query("daily_cap", oracle("SELECT batch_id FROM (SELECT batch_id, row_number() OVER (PARTITION BY company_id, created_at::DATE ORDER BY created_at, batch_id) AS n FROM b1) WHERE n <= 1", "b1"))
def _cap(spark, base):
    return H.daily_cap(B.batches(spark, base), 1).select("batch_id")


@query("last_events", oracle("SELECT batch_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, event_id DESC) AS place FROM b4) WHERE place <= 6", "b4"))
def _last(spark, base):
    return H.last_events(B.events(spark, base)).select("batch_id", "event_id", "place")


ALLOWED = "SELECT unnest([" + ", ".join(f"'{a}'" for a, bs in K.LIFE_CYCLE.items() for _ in bs) + "]) AS a, unnest([" + ", ".join(f"'{b}'" for bs in K.LIFE_CYCLE.values() for b in bs) + "]) AS b"


@query("status_machine", oracle("""SELECT event_id, from_action, action FROM (SELECT *, lag(action) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS from_action FROM b4)
    WHERE from_action IS NOT NULL AND from_action <> action AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = from_action AND b = action)""", "b4", allowed=ALLOWED))
def _machine(spark, base):
    allowed = spark.createDataFrame([(a, b) for a, bs in K.LIFE_CYCLE.items() for b in bs], "from_state string, to_state string")
    return H.illegal_transitions(B.events(spark, base), allowed).select("event_id", "from_action", "action")


@query("outcome_label", oracle("""SELECT s.batch_id, attempts, outcome, coalesce(corrections, 0) AS corrections, outcome = 'accepted' AS approved FROM (SELECT batch_id, count(*) AS attempts FROM b4 WHERE action = 'validated' GROUP BY 1) s
    LEFT JOIN (SELECT batch_id, arg_max(action, (ts, event_id)) AS outcome FROM b4 WHERE action IN ('accepted', 'rejected') GROUP BY 1) o USING (batch_id) LEFT JOIN (SELECT batch_id, count(*) AS corrections FROM b4 WHERE action = 'preprocessing' GROUP BY 1) c USING (batch_id)""", "b4"))
def _labels(spark, base):
    e = B.events(spark, base)
    done = e.where(F.col("action").isin("accepted", "rejected")).withColumn("status", F.col("action"))
    return H.outcome_labels(e.where("action = 'validated'"), done, e.where("action = 'preprocessing'"))


# a batch that was not accepted is handed in again with its next event: chains end where the data ends them
_SUBS = "SELECT *, coalesce(lag(action) OVER w = 'accepted', true) AS is_root FROM b4 WINDOW w AS (PARTITION BY batch_id ORDER BY ts, event_id)"
_CHAIN = "SELECT *, last_value(CASE WHEN is_root THEN event_id END IGNORE NULLS) OVER w AS root, last_value(CASE WHEN is_root THEN n END IGNORE NULLS) OVER w AS first FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS n FROM subs) WINDOW w AS (PARTITION BY batch_id ORDER BY n)"


@query("submission_chain", oracle("SELECT root, max(n - first)::INT + 1 AS attempts, count(*) AS submissions FROM chain GROUP BY 1", "b4", subs=_SUBS, chain=_CHAIN))
def _chain(spark, base):
    before = neighbour(B.events(spark, base), ["batch_id"], ["ts", "event_id"], hour_bucket(F.col("ts")), ["action", "event_id"], -1, "last_")
    subs = before.select(F.col("event_id").alias("id"), F.when(F.col("last_action") != "accepted", F.col("last_event_id")).alias("parent"))
    return H.chain_summary(H.submission_chain(subs))


_FIX = """SELECT event_id, CASE k % 5 WHEN 0 THEN 'E007' WHEN 1 THEN 'E023' WHEN 2 THEN 'E007' WHEN 3 THEN 'E004' ELSE 'E099' END AS error_code,
    CASE k % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'DEHAM' WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'x' END AS value, CASE WHEN k % 5 IN (0, 1) THEN 'resubmit' ELSE 'operator' END AS action, 1 + CASE WHEN k % 5 IN (0, 1) THEN 1 ELSE 0 END AS attempt FROM b4 WHERE action = 'rejected'"""


@query("auto_fix", oracle(_FIX, "b4"))
def _fix(spark, base):
    e = B.events(spark, base).where("action = 'rejected'")
    k = F.pmod("k", F.lit(5))
    iso = F.date_format("ts", "yyyy-MM-dd")
    raw = e.select(
        "event_id", pick(k, F.lit("E007"), F.lit("E023"), F.lit("E007"), F.lit("E004"), F.lit("E099")).alias("error_code"),
        pick(k, F.upper(F.date_format("ts", "dd/MMM/yyyy")), F.lit("Hamburg"), iso, F.lit("x"), F.lit("x")).alias("value"), F.lit(1).alias("attempt"),
    )
    out = H.auto_fix(raw, {"E007": normalize_carrier_date(F.col("value")), "E023": resolve_port(F.col("value")), "E019": F.upper(F.trim("value"))})
    return out.select("event_id", "error_code", "value", "action", "attempt")
