"""Ratios under a limit, captured values that are used more than once, sentences that stay with their document."""

import random

from pyspark.sql import functions as F

from quayside.functions import extract as X
from quayside.functions import similarity as sim
from quayside.plans import load_catalog


def test_ratio_within_a_limit(spark):
    random.seed(2)
    text = lambda: "".join(random.choice("abcé ") for _ in range(random.randint(0, 30)))
    rows = [(a, random.choice([a[:-2], a.replace("a", "b"), text()]), random.random()) for a in (text() for _ in range(500))]
    df = spark.createDataFrame(rows, "a string, b string, least double").withColumn("whole", sim.levenshtein_ratio(F.col("a"), F.col("b")))
    limited = df.withColumn("part", sim.levenshtein_ratio(F.col("a"), F.col("b"), F.col("least")))
    assert limited.where("whole >= least and whole <> part or whole < least and part > whole").count() == 0


def test_common_subsequence_of_shared_ends():
    for a, b in [("", "x"), ("abc", "abc"), ("bc", "abcd"), ("abXcd", "abYYcd"), ("aXbYc", "aYbXc"), ("aa", "aaa"), ("ab", "ba")]:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sim.lcs(a, b) == sim.lcs(b, a) == table[-1][-1]


def test_a_pattern_is_searched_once(spark):
    df = spark.createDataFrame([("CIF Value USD 1,200.50", "invoice")], "text string, doc_type string")
    found = df.select(X.document_fields(F.col("text"), F.col("doc_type"))["cif_value"].alias("cif"))
    assert found.first()["cif"] == "1200.5"
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_sentences_are_matched_where_they_are_cut(spark, base):
    plan = load_catalog().QUERIES["gt_vs_pred"](spark, base)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line and "Reused" not in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved if "Broadcast" not in line)


def test_a_prediction_is_cleaned_once(spark):
    df = spark.createDataFrame([(["Jakarta Port"], " JAKARTA port ")], "gt array<string>, pred string")
    found = df.select(sim.anls(F.col("gt"), F.col("pred")).alias("score"))
    assert found.first()["score"] == 1.0
    assert found._jdf.queryExecution().analyzed().toString().count("lower(pred") == 2  # compared with none, else taken
