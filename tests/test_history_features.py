"""Sums known at a point in time, the store of model versions, and writers that survive a crash."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators.asof import known_before, rates_at_arrival
from quayside.operators.assembly import decrypt_payload, encrypt_payload, primary_fields
from quayside.operators.model_store import ModelStore
from quayside.sources import writers as W

DAY = 86_400


def table(spark, rows):
    cols = "batch_id long, company_id long, carrier string, chapter string, s long, d long, rejected boolean, corrections int"
    df = spark.createDataFrame(rows, cols)
    return df.withColumn("submitted_at", F.timestamp_seconds("s")).withColumn("decided_at", F.timestamp_seconds("d")).drop("s", "d")


def brute(rows, key, days=None):
    """By request: cases of its key decided strictly before it, and not longer ago than ``days``."""
    out = {}
    for r in rows:
        if r[key] is not None and r[4] is not None:
            known = [h for h in rows if h[key] == r[key] and h[5] is not None and h[5] < r[4] and (days is None or h[5] >= r[4] - days * DAY)]
            out[r[0]] = (len(known), sum(bool(h[6]) for h in known), sum(h[7] or 0 for h in known))
    return out


def test_sums_are_those_known_at_arrival(spark):
    """Times meet exactly (a decision at the moment of a request, or just on the edge of the look-back), one key has most rows, some values are missing."""
    rnd = random.Random(5)
    rows = []
    for i in range(500):
        s = rnd.choice([None, *range(0, 60 * DAY, DAY // 2)])
        d = rnd.choice([None, s, (s or 0) + rnd.randint(0, 6) * DAY])
        rows.append((i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice("AB"), rnd.choice(["01", None]), s, d, rnd.choice([True, False, None]), rnd.choice([0, 1, 5, None])))
    df = table(spark, rows).repartition(3)
    values = {"n": F.lit(1), "bad": F.coalesce("rejected", F.lit(False)).cast("int"), "fixes": F.coalesce("corrections", F.lit(0))}
    for key, at, days in ((1, "company_id", None), (2, "carrier", 30), (3, "chapter", 7)):
        got = {r.batch_id: (r.n, r.bad, r.fixes) for r in known_before(df, df, [at], values, days).collect()}
        assert got == brute(rows, key, days)
    found = {r.batch_id: r for r in rates_at_arrival(df, df).collect()}
    assert len(found) == 500
    for i, (n, bad, fixes) in brute(rows, 1).items():
        assert found[i].importer_submissions == n and found[i].importer_rejection_rate == (bad / n if n else 0) and found[i].mean_corrections == (fixes / n if n else 0)
    assert rates_at_arrival(df.limit(0), df).count() == 0 and rates_at_arrival(df, df.limit(0)).where("importer_submissions = 0").count() == 500


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("batch_id")
    return spark.range(400).withColumnRenamed("id", "batch_id").select(
        "batch_id", (x % 7).cast("double").alias("a"), (x * 37 % 11).cast("double").alias("b"), F.when((x % 7 > 3) != (x % 10 == 0), 1.0).otherwise(0.0).alias("label")
    )


def test_versions_are_saved_compared_and_loaded(spark, rows, tmp_path):
    small = {"minimum": 50, "trees": 4, "depth": 2}
    store = ModelStore(spark, str(tmp_path))
    assert store.current() is None and store.load() is None and store.unused(rows).count() == 400
    first = store.train(rows.where("batch_id < 300"), ["a", "b"], **small).first()
    assert first.trained and first.promoted and store.current()["version"] == first.version
    assert store.unused(rows).count() == 100
    # another session loads the same model and scores alike
    from quayside.operators.models import score

    ready = rows.withColumn("weight", F.lit(1.0))
    mine = {r.batch_id: r.probability for r in score(store.load(), ready).collect()}
    other = ModelStore(spark.newSession(), str(tmp_path))
    assert {r.batch_id: r.probability for r in score(other.load(), ready).collect()} == mine and len(mine) == 400
    # a run that dies between saving and registering changes nothing, and can be repeated
    version = store.save(store.load(), rows)
    assert store.current()["version"] == first.version and store.unused(rows).count() == 100 and store.registry().count() == 1
    # a clearly worse version is registered but not used, a better one is
    assert not store.register(version, first.auc - 0.5, 400, ["a", "b"]) and store.current()["version"] == first.version
    again = store.save(store.load(), rows)
    assert store.register(again, first.auc - 0.01, 400, ["a", "b"]) and other.current()["version"] == again
    assert store.unused(rows).count() == 0 and [r.seq for r in store.registry().orderBy("seq").collect()] == [1, 2, 3]


def test_too_few_rows_register_nothing(spark, rows, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    told = store.train(rows.limit(10), ["a", "b"], minimum=50).first()
    assert (told.trained, told.reason, told.promoted) == (False, "not_enough_samples", False) and store.registry().count() == 0


def test_rows_count_only_once_they_are_marked(spark, tmp_path):
    schema, root = "id long, v string", str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, None)], schema)
    assert W.committed(spark, root, schema).count() == 0
    W.put(rows, root)  # a run that dies before its marker
    assert W.committed(spark, root, schema).count() == 0
    assert W.commit(rows, root) == 1 and W.commit(rows.where("id = 2"), root) == 2
    assert sorted((r.id, r.v or "", r.seq) for r in W.committed(spark, root, schema).collect()) == [(1, "a", 1), (2, "", 1), (2, "", 2)]


def test_keys_replaced_in_their_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    W.replace_keys(old, path, ["k"], buckets=16)
    before = {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    new = spark.createDataFrame([(5, "new"), (5, "twin"), (5000, "new")], "k long, v string")
    for _ in range(2):  # repeating a replacement changes nothing
        W.replace_keys(new, path, ["k"], buckets=16)
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).select("k", "v").collect())
    assert got == sorted([(i, "old") for i in range(1000) if i != 5] + [(5, "new"), (5, "twin"), (5000, "new")])
    after = {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert len(set(before) & set(after)) >= 14 and all(after[f] == before[f] for f in set(before) & set(after))


def test_no_plan_shows_the_key(spark):
    key = "fedcba9876543210"
    spark.conf.set(W.KEY_SETTING, key)
    try:
        df = spark.createDataFrame([("secret text",), ("",)], "p string").select("p", encrypt_payload(F.col("p"), W.payload_key(spark)).alias("c"))
        back = df.select("p", decrypt_payload(F.col("c"), W.payload_key(spark)).alias("o"))
        assert [(r.p, r.o) for r in back.collect()] == [("secret text", "secret text"), ("", "")]
        assert key not in back._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(W.KEY_SETTING)
    with pytest.raises(ValueError):
        W.payload_key(spark)


def test_corrections_take_the_place_of_the_first_document(spark):
    fields = spark.createDataFrame(
        [(1, "d1", "currency", "USD"), (1, "d1", "nib", None), (1, "d2", "nib", "2"), (1, "d2", "currency", "IDR"), (2, "d1", "currency", "USD")],
        "batch_id long, doc_id string, field string, value string",
    )
    fixes = spark.createDataFrame(
        [(1, "currency", "GBP", 1), (1, "currency", "EUR", 2), (1, "currency", None, 3), (1, "voyage_number", "V1", 1), (9, "nib", "7", 1)],
        "batch_id long, field string, corrected_value string, seq int",
    )
    got = sorted(((r.batch_id, r.field, r.value) for r in primary_fields(fields, fixes).collect()), key=lambda r: r[:2])
    assert got == [(1, "currency", "EUR"), (1, "nib", None), (1, "voyage_number", "V1"), (2, "currency", "USD")]
