"""Each value is cleaned once, and each vote is taken once, however many results are drawn from it."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quayside.functions.common import dec, millionths
from quayside.functions.normalize import normalize_field
from quayside.operators import rules as R
from quayside.operators import voting as vote
from quayside.sources.dims import load_rules


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def votes_in(df) -> int:
    """Times that readings are made out of documents."""
    return plan_of(df).count("Generate inline(array(struct(field, ")


@pytest.mark.parametrize("field,pattern,times", [("gross_weight", "[,\\s]", 1), ("gross_weight", "TON", 1), ("cif_value", "USD|EUR", 1), ("hs_code", "[.\\s\\-]", 1), ("vessel_name", "NMV\\s+", 1)])
def test_a_reading_is_cleaned_once(spark, field, pattern, times):
    df = spark.range(3).select(F.col("id").cast("string").alias("value")).select(normalize_field(F.lit(field), F.col("value")).alias("norm"))
    plan = df._jdf.queryExecution().optimizedPlan().expressions().mkString()
    assert plan.count(pattern) == times


def test_normal_forms(spark):
    cases = {
        ("gross_weight", " 1,234.50 KGS"): "1234.5", ("gross_weight", "9"): "9.0", ("gross_weight", "12.0005"): "12.001", ("gross_weight", "12 TON."): "12.0", ("gross_weight", "5d"): "5d",
        ("gross_weight", "x7"): "x7", ("gross_weight", "  "): None, ("gross_weight", None): None, ("gross_weight", "1e3"): "1000.0", ("gross_weight", "100"): "100.0", ("cif_value", "USD 1,000.10"): "1000.1",
        ("hs_code", "12.34-56"): "12345600", ("hs_code", "123456789"): "12345678", ("hs_code", "."): "", ("vessel_name", "m/v  nmv x"): "NMV X", ("vessel_name", "MVP 1"): "MVP 1",
        ("vessel_name", "MV MT  Sea "): "SEA", ("vessel_name", "MV"): "MV", ("note", " a "): "A",
    }
    rows = spark.createDataFrame([(f, v, w) for (f, v), w in cases.items()], "field string, value string, want string")
    got = rows.select("field", "value", "want", normalize_field(F.col("field"), F.col("value")).alias("norm")).collect()
    assert [r for r in got if r["norm"] != r["want"]] == []


def test_millionths_are_the_decimal_image(spark):
    odd = [0.0, 0.63, 0.1234565, 0.1234575, 0.0000005, -0.0000005, 1.0000015, 0.3333333333, 123456.7890125, 2e6, 1234567.1234565, -5e11, float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in odd], "c double").select("c", millionths(F.col("c")).alias("got"), (dec(F.col("c"), 6) * 1000000).cast("bigint").alias("want"))
    assert [r for r in rows.collect() if r["got"] != r["want"]] == []


def test_both_means_come_from_one_vote(spark, base):
    assert votes_in(queries()["avg_confidence"](spark, base)) == 1
    rows = spark.createDataFrame([(1, "d", "hs_code", 0.9), (1, "d", "seal", 0.6), (1, "e", "seal", None)], "batch_id int, doc_id string, field string, confidence double")
    got = {r["doc_id"]: (r["avg_confidence"], r["weighted_confidence"]) for r in vote.average_confidence(rows, both=True).collect()}
    assert got == {"d": (0.75, 0.8), "e": (None, None)}


def test_a_capped_vote_is_taken_once(spark, base):
    assert votes_in(queries()["confidence_cap"](spark, base)) == 1
    fields = "batch_id int, doc_id string, doc_type string, field string, value string, confidence double"
    rec = spark.createDataFrame([(1, "d", "bill_of_lading", f, "x", 0.9) for f in ("bl_number", "bl_date", "gross_weight", "vessel_name")] + [(1, "d", "bill_of_lading", "seal", "x", 0.9), (1, "e", "bill_of_lading", "bl_date", None, 0.95), (None, "f", "invoice", "bl_date", "x", 1.0)], fields)
    docs = spark.createDataFrame([(1, "d", "bill_of_lading"), (1, "e", "bill_of_lading"), (1, "e", "bill_of_lading"), (None, "f", "invoice")], "batch_id int, doc_id string, doc_type string")
    got = sorted((r["doc_id"], r["field"], r["route"], r["confidence"]) for r in vote.cap_confidence(rec, docs).collect())
    assert got == sorted([("d", f, "STANDARD", 0.9) for f in ("bl_number", "bl_date", "gross_weight", "vessel_name", "seal")] + [("e", "bl_date", "DEGRADED", 0.8)] * 2)


def test_the_log_reads_the_values_that_corrections_kept(spark, base):
    assert votes_in(queries()["correction_log"](spark, base)) == 1
    rec = spark.createDataFrame([(1, "d", "a", "1"), (1, "d", "a", "2"), (1, "d", "b", None), (2, "e", "a", "1"), (None, "f", "a", "1")], "batch_id int, doc_id string, field string, value string")
    rec = rec.withColumn("confidence", F.lit(0.5)).withColumn("source", F.lit("ensemble"))
    fixes = [(1, "d", "a", "1", 1, 1), (1, "d", "b", "9", 1, 1), (2, "e", "c", "7", 1, 1), (None, "f", "a", "3", 1, 1)]
    corr = spark.createDataFrame(fixes, "batch_id int, doc_id string, field string, corrected_value string, ts int, correction_id int")
    met = vote.correction_log(rec, vote.apply_corrections(rec, corr))
    kept = vote.correction_log(rec, vote.apply_corrections(rec, corr, keep_before=True))
    assert met.columns == kept.columns and sorted(map(str, met.collect())) == sorted(map(str, kept.collect())) and met.count() == 6


@pytest.mark.parametrize("name,wanted", [("cross_doc_tolerance", "= gross_weight"), ("cross_doc_match", "IN (bl_number,total_packages,vessel_name,voyage_number)"), ("cross_doc_match_scoped", "= total_packages")])
def test_only_fields_that_a_rule_looks_at_are_voted(spark, base, name, wanted):
    lines = plan_of(queries()[name](spark, base)).splitlines()
    votes = [i for i, line in enumerate(lines) if "Generate inline(array(struct(field, " in line]
    assert votes and all(f"Filter (field#" in lines[i - 1] + lines[i - 2] or f"Filter field#" in lines[i - 1] + lines[i - 2] for i in votes) and wanted in "".join(lines)


def test_fields_that_no_rule_looks_at_change_nothing(spark):
    rows = [(1, "a", "invoice", "gross_weight", "10"), (1, "b", "invoice", "gross_weight", "20"), (1, "b", "invoice", "net_weight", "99"), (1, "b", "invoice", None, "5")]
    fields, rules = spark.createDataFrame(rows, "batch_id int, doc_id string, doc_type string, field string, value string"), load_rules(spark)
    assert [(r["field"], r["values"], r["pct"]) for r in R.cross_document_tolerance(fields, rules).collect()] == [("gross_weight", 2, 50.0)]
    assert R.looked_at(rules.where("fields is null")) == []


def test_mismatches_of_batches_that_fit_a_piece_are_found_in_one_pass(spark):
    rows = [(1, "a", "total_packages", "5"), (1, "b", "total_packages", "6"), (1, "c", "total_packages", "6"), (1, "d", "total_packages", " "), (2, "a", "total_packages", "5"), (2, "b", "total_packages", "5"),
            (2, "a", "gross_weight", "5"), (2, "b", "gross_weight", "6"), (None, "a", "vessel_name", "X"), (None, "b", "vessel_name", "Y"), (3, "a", "vessel_name", "X"), (3, "b", "vessel_name", "MV Y")]
    fields, rules = spark.createDataFrame(rows, "batch_id int, doc_id string, field string, value string").withColumn("doc_type", F.lit("invoice")), load_rules(spark)
    one, two = R.mismatched_values(fields, rules, crowded=False), R.mismatched_values(fields, rules)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert sorted(map(str, [(r["batch_id"], r["form"], r["documents"]) for r in one.collect()])) == sorted(map(str, [(1, "5", 1), (1, "6", 2), (1, None, 1), (3, "X", 1), (3, "Y", 1)]))
    assert plan_of(one).count("Window") and "SortMergeJoin" not in plan_of(one)


def test_pages_of_batches_that_fit_a_piece_are_made_in_one_pass(spark, base):
    from quayside.operators.ordered import pages

    rows = [(b, f"d{n % 7}", n) for b in (1, 2, None) for n in range(23)] + [(1, None, 99)]
    df = spark.createDataFrame(rows, "batch_id int, doc_id string, place int")
    made = [pages(df, ["batch_id"], [F.col("doc_id"), F.col("place")], F.col("doc_id"), F.col("place"), 5, crowded) for crowded in (True, False)]
    assert plan_of(made[1]).count("Scan") == 1
    assert made[0].columns == made[1].columns and sorted(map(str, made[0].collect())) == sorted(map(str, made[1].collect())) and made[1].count() == 10
    assert votes_in(queries()["batch_detail_pages"](spark, base)) == 3  # one of the small batches, two of the crowded ones


def test_first_documents_and_their_corrections_meet_by_batch(spark):
    from quayside.operators import assembly as A

    rows = [(1, "b", "x", "1"), (1, "a", "x", "2"), (1, "a", "y", "3"), (1, "a", "x", "4"), (1, None, "x", "5"), (1, "a", None, "6"), (2, None, "x", "7"), (None, "a", "x", "8"), (3, "c", "x", None)]
    fields = spark.createDataFrame(rows, "batch_id int, doc_id string, field string, value string")
    corr = spark.createDataFrame([(1, "y", "30", 1), (1, "y", "31", 2), (1, "z", "40", 1), (1, "x", None, 9), (2, "x", "70", 1), (4, "x", "90", 1), (None, "x", "80", 1)], "batch_id int, field string, corrected_value string, seq int")
    plain = [(1, "a", "x", "2"), (1, "a", "x", "4"), (1, "a", "y", "3"), (1, "a", None, "6"), (3, "c", "x", None)]
    assert sorted(map(str, A.primary_fields(fields).collect())) == sorted(map(str, spark.createDataFrame(plain, fields.schema).collect()))
    want = [(1, "a", "x", "2"), (1, "a", "x", "4"), (1, "a", "y", "31"), (1, "a", "z", "40"), (1, "a", None, "6"), (2, None, "x", "70"), (3, "c", "x", None)]
    assert sorted(map(str, A.primary_fields(fields, corr).collect())) == sorted(map(str, spark.createDataFrame(want, fields.schema).collect()))


def test_fields_of_a_declaration_are_not_moved_by_document(spark):
    from quayside.operators import assembly as A

    fields = spark.range(10).selectExpr("id AS batch_id", "'a' AS doc_id", "'x' AS field", "'1' AS value").repartition(64, "batch_id")
    corr = spark.range(10).selectExpr("id AS batch_id", "'x' AS field", "'2' AS corrected_value", "1 AS seq")
    moved = [line for line in plan_of(A.primary_fields(fields, corr)).splitlines() if "Exchange" in line]
    assert not [line for line in moved if "doc_id" in line] and sum("ENSURE" in line for line in moved) <= 2  # the corrections only
