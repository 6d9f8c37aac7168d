"""Votes on the boundary cases."""

import pytest
from pyspark.sql import functions as F

from quayside.operators import listing
from quayside.operators import voting as vote
from quayside.plans import bindings as B
from quayside.plans import gate_queries
from quayside.plans import load_catalog

SCHEMA = "batch_id bigint, doc_id string, doc_type string, engine string, engine_rank int, field string, value string, confidence double"


def readings(spark, field, values, confidences=None):
    rows = [(1, "d", "invoice", f"agent_{'abcd'[i]}", i + 1, field, v, (confidences or [0.9] * 4)[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_two_two_tie_goes_to_the_earliest_engine(spark):
    r = one(vote.majority_vote(readings(spark, "voyage_number", ["b", "a", "a", "B "])))
    assert (r["value"], r["confidence"], r["disagreement"], r["level"]) == ("B", 0.45, True, "LOW")


def test_all_differ_and_one_engine_only(spark):
    assert one(vote.majority_vote(readings(spark, "voyage_number", ["a", "b", "c", "d"])))["confidence"] == 0.225
    r = one(vote.majority_vote(readings(spark, "voyage_number", [None, None, "x", None])))
    assert (r["value"], r["confidence"], r["disagreement"], r["level"]) == ("X", 0.9, False, "HIGH")


def test_all_null_is_missing(spark):
    r = one(vote.majority_vote(readings(spark, "voyage_number", [None, " ", None, None])))
    assert (r["value"], r["confidence"], r["level"], r["disagreement"]) == (None, 0.0, "MISSING", False)


def test_rule_checked_field_takes_the_only_valid_engine(spark):
    r = one(vote.majority_vote(readings(spark, "nib", ["12", "12", "12", "8120012345678"], [0.8, 0.8, 0.8, 1.0])))
    assert (r["value"], r["source"], r["confidence"], r["disagreement"]) == ("8120012345678", "rule", 0.213, True)
    r = one(vote.majority_vote(readings(spark, "nib", [None, "12", "13", "14"])))
    assert (r["value"], r["confidence"], r["disagreement"]) == ("12", 0.3, True) and "nib" in r["flag_reason"]


def test_levels_at_the_bounds(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.69999,), (0.0,)], "c double")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(vote.confidence_level(F.col("c"))).collect()] == ["HIGH", "MEDIUM", "LOW", "MISSING"]


def test_tiers(spark):
    cases = {("a", "a", "a", "x"): (0.94, "HIGH"), ("a", "b", "c", "a"): (0.85, "MEDIUM"), ("a", "a", "b", "c"): (0.78, "MEDIUM"), ("a", "b", "c", "d"): (0.55, "LOW")}
    for values, want in cases.items():
        r = one(vote.tier_vote(readings(spark, "voyage_number", list(values))))
        assert (r["confidence"], r["level"]) == want
    assert one(vote.tier_vote(readings(spark, "voyage_number", ["a", "b", "c", "d"])))["value"] == "D"


def test_weighted_consensus_and_close_conflict(spark):
    same = spark.createDataFrame(
        [(1, "d", "invoice", "paddleocr", 1, "importer_npwp", "09.111.222.3-444.000", 0.86), (1, "d", "invoice", "azure-di", 2, "importer_npwp", "091112223444000", 0.83)], SCHEMA
    )
    r = one(vote.weighted_vote(same))
    assert (r["value"], r["confidence"], r["conflict"]) == ("09.111.222.3-444.000", 0.99, False)
    close = spark.createDataFrame(
        [(1, "d", "invoice", "paddleocr", 1, "total_packages", "200", 0.88), (1, "d", "invoice", "azure-di", 2, "total_packages", "208", 0.84)], SCHEMA
    )
    r = one(vote.weighted_vote(close, margin=0.2))
    assert (r["value"], r["conflict"], r["reason"]) == ("208", True, "engine_disagreement")


def test_every_expected_field_comes_out_once(spark):
    docs = spark.createDataFrame([(1, "d", "invoice"), (1, "e", "bill_of_lading")], "batch_id bigint, doc_id string, doc_type string")
    rec = vote.majority_vote(readings(spark, "hs_code", ["84821000"] * 4))
    rows = vote.align(rec, docs).collect()
    assert len(rows) == 24 + 10
    assert {r["level"] for r in rows if r["field"] != "hs_code"} == {"MISSING"}


def test_correction_of_an_unread_field(spark):
    rec = vote.majority_vote(readings(spark, "hs_code", ["84821000"] * 4))
    fix = spark.createDataFrame(
        [(1, "d", "hs_code", "1", 1, 1), (1, "d", "hs_code", "2", 2, 1), (1, "d", "seal", "S", 1, 1)],
        "batch_id bigint, doc_id string, field string, corrected_value string, ts int, correction_id int",
    )
    got = {r["field"]: (r["value"], r["source"], r["confidence"]) for r in vote.apply_corrections(rec, fix).collect()}
    assert got == {"hs_code": ("2", "operator", 0.9), "seal": ("S", "operator", 1.0)}


def test_a_reading_without_confidence_has_the_default(spark):
    r = vote.scored_forms(readings(spark, "voyage_number", ["a", "b"], [None, 1.0])).collect()
    scores = {x["form"]: float(x["score"]) for x in r}
    assert abs(scores["a"] - 0.75 * scores["b"]) < 1e-9  # both engines are unknown to the weights


def test_a_field_entering_by_correction_is_logged(spark):
    keys = "batch_id int, doc_id string, field string, value string"
    before = spark.createDataFrame([(1, "d", "kept", "x"), (1, "d", "changed", "y")], keys)
    after = spark.createDataFrame([(1, "d", "kept", "x"), (1, "d", "changed", "z"), (1, "d", "new", "n")], keys)
    got = {(r.field, r.before_state, r.after_state) for r in vote.correction_log(before, after).collect()}
    assert got == {("changed", "y", "z"), ("new", None, "n")}


def test_a_field_nobody_read_is_missing(spark):
    r = one(vote.tier_vote(readings(spark, "voyage_number", [None, None, None, None])))
    assert (r["value"], r["confidence"], r["level"], r["disagreement"]) == (None, 0.0, "MISSING", False)
    r = one(vote.tier_vote(readings(spark, "hs_code", [None, None, None, None])))
    assert (r["value"], r["confidence"], r["level"], r["source"], r["disagreement"]) == (None, 0.0, "MISSING", "ensemble", False)


@pytest.mark.parametrize("name", ["majority_vote", "tier_vote", "weighted_vote", "rank_candidates", "avg_confidence", "disputed_values"])
def test_readings_of_large_inputs_are_not_shuffled(spark, base, tmp_path, name):
    """An input with more partitions than cores: only the documents are dealt out, before they become readings."""
    spark.read.parquet(f"{base}/lineitem.parquet").repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load_catalog().QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = [line for line in plan.splitlines() if "Exchange " in line and "Reused" not in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)


def test_fields_of_large_inputs_are_not_shuffled(spark, base, tmp_path):
    """The same for the typed fields of a batch and the headers made of them."""
    spark.read.parquet(f"{base}/lineitem.parquet").repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = load_catalog().QUERIES["declaration_hash"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line and "Reused" not in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line and "Reused" not in line]


@pytest.mark.parametrize("name", ["apply_corrections", "correction_log"])
def test_corrections_meet_the_fields_where_both_lie(spark, base, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanges(load_catalog().QUERIES[name](spark, base))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)


def test_fields_without_a_batch_are_not_matched(spark):
    rec = spark.createDataFrame([(None, "d", "a", "x", 0.5, "ensemble")], "batch_id bigint, doc_id string, field string, value string, confidence double, source string")
    fix = spark.createDataFrame([(None, "d", "a", "y", 1, 1)], "batch_id bigint, doc_id string, field string, corrected_value string, ts int, correction_id int")
    assert sorted((r["value"], r["source"]) for r in vote.apply_corrections(rec, fix).collect()) == [("x", "ensemble"), ("y", "operator")]


BY_BATCH = {
    "distinct_values": lambda obs: vote.distinct_values(vote.majority_vote(obs)),
    "completeness": lambda obs: listing.completeness(vote.majority_vote(obs)),
    "last_write": lambda obs: listing.last_write(obs, ["batch_id", "field"], ["value", "engine"], ["doc_id", "engine"]),
}


@pytest.mark.parametrize("name", BY_BATCH)
def test_fields_of_whole_batches_are_not_moved_again(spark, base, name):
    """The one exchange beside the dealing counts the documents of a batch."""
    moved = exchanges(BY_BATCH[name](B.observations_by_batch(spark, base)[0]))
    assert len([line for line in moved if "ENSURE_REQUIREMENTS" in line]) == 1


def test_crowded_batches_give_the_same_rows(spark, base, monkeypatch):
    want = sorted(map(tuple, vote.distinct_values(vote.majority_vote(B.observations(spark, base))).collect()))
    monkeypatch.setattr(B, "CROWDED", 4)
    few, many = (BY_BATCH["distinct_values"](obs).collect() for obs in B.observations_by_batch(spark, base))
    assert few and many and sorted(map(tuple, few + many)) == want


def lines(spark, rows):
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date, l_returnflag string"
    return spark.createDataFrame([(*r, 0.0, 0.0, None, "N") for r in rows], names)


@pytest.mark.parametrize("fields", [["total_packages"], ["hs_code", "vessel_name"]])
def test_readings_of_some_fields_are_those_of_all(spark, fields):
    docs = B.shape_documents(lines(spark, [(1, 1, 7, 3, 5.0, 10.0), (1, 2, 9, 3, 6.0, None), (1, 2, 9, 3, 6.0, None), (17, 1, None, 4, 2.0, 1.5), (34, 3, 17, 5, None, 2.0)]))
    every, some = B.shape_observations(docs), B.shape_observations(docs, fields)
    key = lambda df: sorted(map(str, df.collect()))
    assert some.schema == every.schema and key(some) == key(every.where(every["field"].isin(fields)))
    assert key(vote.majority_vote(some)) == key(vote.majority_vote(every).where(F.col("field").isin(fields)))


@pytest.mark.parametrize("part", [gate_queries.validation_recall, gate_queries.flagging_rate])
def test_gates_of_the_package_numbers_vote_no_other_field(spark, base, part):
    plan = part(spark, base)._jdf.queryExecution().optimizedPlan().toString()
    vote_and_below = plan[plan.index("row_number") :]
    assert not [x for x in ("KGS", "M/V", "gross_weight", "inline(") if x in vote_and_below]
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Join") and " = " not in line]
