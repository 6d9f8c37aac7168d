"""Streams over several files and micro-batches against their batch twins."""

import pytest
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.operators import history as H
from quayside.plans import bindings as B
from quayside.sources.files import landing_stream, within_batches
from quayside.sources.tables import read_table
from quayside.streaming import jobs as J
from quayside.streaming import runner as R


@pytest.fixture(scope="module")
def parts(spark, base, tmp_path_factory):
    """The event table in four files of consecutive time, read one file per micro-batch."""
    out = tmp_path_factory.mktemp("events")
    events = read_table(spark, base, "events")
    for day in (1, 9, 17, 25):  # one write after the other, so that the files are taken in this order
        first = F.dayofmonth("ts")
        events.where((first >= day) & ((first < day + 8) | F.lit(day == 25))).coalesce(1).write.mode("append").parquet(f"{out}/events.parquet")
    return str(out)


@pytest.fixture(scope="module")
def mixed(spark, base, tmp_path_factory):
    """The event table in three files that each hold a third of every day, in no order."""
    out = tmp_path_factory.mktemp("mixed")
    for third in (2, 0, 1):
        rows = read_table(spark, base, "events").where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == third)
        rows.orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1).write.mode("append").parquet(f"{out}/events.parquet")
    return str(out)


def feed(spark, parts):
    return B.shape_events(R.table_stream(spark, parts, "events", max_files=1))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_status_is_the_last_one(spark, base, parts):
    got = J.latest_status(R.each_batch_to_table(feed(spark, parts), "t", J.status_changes)).select("batch_id", "status", "updates")
    want = B.events(spark, base).groupBy("batch_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("updates"))
    same(got, want)


def test_running_views_do_not_depend_on_the_order_of_files(spark, base, mixed):
    events = B.events(spark, base)
    same(J.first_terminal(R.each_batch_to_table(feed(spark, mixed), "t", J.terminal_changes)), J.first_terminal(J.terminal_changes(events)))
    same(J.quota_per_month(R.each_batch_to_table(feed(spark, mixed), "t", J.quota_changes)), J.quota_per_month(J.quota_changes(events)))


def test_latency_sketch_keeps_its_error_and_the_last_bin_is_open(spark, tmp_path):
    """Forty micro-batches of skewed values; ranks of the merged sketch are held against the exact ones."""
    n = 400_000
    value = F.pow(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000.0, 2) - 10
    rows = spark.range(n).select(F.lit("x").alias("action"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 100).alias("ts"), value.alias("amount"))
    rows.repartition(40).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = J.daily_latency(R.each_batch_to_table(stream, "t", J.latency_changes)).first()
    rank = rows.where(F.col("amount") <= got.p95).count() / n
    assert abs(rank - 0.95) < 0.001 and got.n == n
    assert got.below + got.from_0 + got.from_25 + got.from_50 + got.from_75 + got.from_100 == n and got.below and got.from_100 > n / 2


def test_drift_windows_accumulate_over_batches(spark, base, parts):
    got = R.upsert_to_table(J.drift_windows(feed(spark, parts), 60), "t", ["start", "field_name"])
    e = B.events(spark, base).select("field_name", F.explode(F.sequence(F.date_sub(F.to_date("ts"), 29), F.to_date("ts"))).alias("d"))
    want = e.groupBy(F.date_format("d", "yyyy-MM-dd").alias("start"), "field_name").agg(F.count(F.lit(1)).alias("corrections")).where("corrections >= 60")
    same(got, want)


def failed():
    return F.col("action").isin("rejected", "preprocessing")


def closed(spark, base, files, max_files):
    closing = R.closing_row(read_table(spark, base, "events"), "ts", "70 DAYS", "closing")
    return B.shape_events(R.table_stream(spark, files, "events", max_files).unionByName(closing.stream)), closing


@pytest.mark.parametrize("max_files", [1, 2])
def test_ordered_state_equals_the_batch_twins_for_any_file_order(spark, base, mixed, max_files):
    """Every file holds events of the whole month, so that each micro-batch goes back behind the one before."""
    events = B.events(spark, base)
    rows, closing = closed(spark, base, mixed, max_files)
    got = R.append_to_table(J.breaker(rows, failed(), late="60 days"), "t", closing=closing).select("event_id", "streak")
    same(got, H.failure_streaks(events, failed()))
    rows, closing = closed(spark, base, mixed, max_files)
    got = R.append_to_table(J.transition_violations(rows, "60 days"), "t", closing=closing).where("event_id IS NOT NULL")
    allowed = spark.createDataFrame([(a, b) for a, bs in K.LIFE_CYCLE.items() for b in bs], "from_state string, to_state string")
    same(got, H.illegal_transitions(events, allowed).select("event_id", "from_action", "action"))


def test_a_key_larger_than_any_chunk_is_judged_in_order(spark, tmp_path):
    """One batch sends 35,000 rows of one key in shuffled order, all in one slot; another key alternates over many slots."""
    rows = spark.range(35_000).select(F.lit(1).cast("long").alias("batch_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 5 == 4).alias("fine"))
    other = spark.range(300).select(F.lit(2).cast("long").alias("batch_id"), F.timestamp_seconds(F.lit(1_690_000_000) + F.col("id") * 40_000).alias("ts"), (F.col("id") + 50_000).alias("event_id"), F.lit(False).alias("fine"))
    every = rows.unionByName(other)
    every.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{tmp_path}/in")
    closing = R.closing_row(every, "ts", "30 DAYS", "closing")
    stream = spark.readStream.schema(every.schema).parquet(f"{tmp_path}/in").unionByName(closing.stream)
    got = R.append_to_table(J.breaker(stream, ~F.col("fine"), late="20 days"), "t", closing=closing).select("event_id", "streak")
    same(got, H.failure_streaks(every, ~F.col("fine")))


def test_expired_batches_stay_expired_and_are_forgotten(spark, tmp_path):
    """Micro-batch by micro-batch: an end in time, an end too late, rows after the expiry, and a key that comes back after its tombstone is gone."""
    day = 86_400
    files = [
        [(1, 0, "uploaded"), (2, 0, "uploaded"), (3, 0, "uploaded"), (2, 1, "accepted")],
        [(9, 9, "uploaded")],  # the watermark passes the limit of 1 and 3: both expire
        [(1, 9, "validated"), (3, 9, "accepted"), (9, 10, "accepted")],  # too late to matter, and no second event
        [(9, 20, "uploaded"), (1, 20, "uploaded")],
        [(9, 90, "uploaded")],  # every tombstone is gone by now
        [(1, 95, "uploaded"), (9, 95, "accepted")],  # a new life of key 1
        [(9, 120, "uploaded")],
    ]
    stream_at = f"{tmp_path}/in"
    schema = "batch_id long, ts timestamp, event_id long, action string"
    spark.createDataFrame([], schema).write.parquet(stream_at)
    got, sizes = [], []
    for i, rows in enumerate(files):
        part = spark.createDataFrame([(k, d * day, i * 10 + n, a) for n, (k, d, a) in enumerate(rows)], "k long, at long, e long, a string")
        part.select(F.col("k").alias("batch_id"), F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), F.col("e").alias("event_id"), F.col("a").alias("action")).coalesce(1).write.mode("append").parquet(stream_at)
        stream = spark.readStream.schema(schema).parquet(stream_at)
        spark.conf.set(R.STATE_STORE, R.ON_DISK)
        q = J.expiry(stream, 48, ("accepted",), "1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.conf.unset(R.STATE_STORE)
        got.append(sorted(r[0] for r in spark.read.schema("batch_id long, created_us long, expired_us long").parquet(f"{tmp_path}/out").collect()))
        sizes.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert got == [[], [1, 3], [1, 3], [1, 3], [1, 3], [1, 3], [1, 1, 3]]
    assert sizes[4] <= sizes[0] and sizes[6] <= sizes[0]  # keys that are gone leave nothing behind


def test_append_is_complete_and_repeatable(spark, base, parts):
    got = R.append_to_table(feed(spark, parts).select("event_id"), "t")
    assert got.count() == read_table(spark, base, "events").count()


def test_every_landed_file_is_checked_once(spark, tmp_path):
    """Files arrive between two runs of the same stream; a batch that grows beyond its limit is turned away as a whole in the view."""
    root, out = tmp_path / "landing", tmp_path / "out"

    def land(name, content):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)

    def run():
        stream = landing_stream(spark, str(root), max_bytes=20, max_files_per_trigger=1)
        stream.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{out}/t")
        return rows.count(), {(r.batch, r.name): r.reject_reason for r in within_batches(rows, 2).collect()}

    land("b1/bl.pdf", b"%PDF-1.7 a")
    land("b1/pl.pdf", b"%PDF-1.7 b")
    land("b2/inv.png", b"%PDF-1.7 c")
    first = {("b1", "bl.pdf"): None, ("b1", "pl.pdf"): None, ("b2", "inv.png"): "content does not match claimed type"}
    assert run() == (3, first) and run() == (3, first)
    land("b1/inv.jpg", bytes.fromhex("FFD8FF") + b"x")
    land("b2/note.txt", b"hello")
    land("b3/bl.pdf", b"%PDF" + b"x" * 30)
    many = dict.fromkeys([("b1", "bl.pdf"), ("b1", "pl.pdf"), ("b1", "inv.jpg")], "too many files in batch")
    assert run() == (6, first | many | {("b2", "note.txt"): "unsupported file type", ("b3", "bl.pdf"): "exceeds 50MB limit"})
