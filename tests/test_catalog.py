"""Registered queries: contract, plans, and rows against the checking SQL on the smallest tables."""

import sys
from contextlib import contextmanager
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import TABLES, bag  # noqa: E402
from quayside.plans import load_catalog  # noqa: E402
from quayside.plans import streaming_queries as streams  # noqa: E402

CHECKED = [
    "majority_vote", "weighted_vote", "agreement_rate", "normalize_field", "doc_rules", "expression_rules", "latest_position", "rolling_rejection",
    "submission_chain", "platform_kpis", "hs_topk", "merkle_root",
]
# joins of single-row results are planned as nested loops over one row
SINGLE_ROW_JOINS = {"platform_kpis"}
MODELS = {"train_rejection", "score_rejection", "feature_importance"}  # minutes of training; run by check.py
RUNS_WHEN_BUILT = {"train_rejection", "score_rejection", "feature_importance", "hs_topk", "hs_accuracy", "text_knn", "merkle_root", "submission_chain", "replace_by_key", "declaration_sink", "revalidate_batches"}


@contextmanager
def executed_plans(spark):
    """Physical plans of all SQL executions inside the block, as the status store keeps them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    plans: list[str] = []
    yield plans
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    done = store.executionsList(int(before), 10_000)
    plans += [done.apply(i).physicalPlanDescription() for i in range(done.size())]


@pytest.fixture(scope="module")
def duck(base):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert {"batch_id", "doc_id", "field", "value", "confidence", "level"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_rows(spark, base, duck, name):
    df = queries()[name](spark, base)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(oracle_sql()[name])
    assert got == bag([d[0] for d in cur.description], cur.fetchall())


def core():
    """The library's own queries; those of optional parts have plan tests of their own."""
    return load_catalog().QUERIES


def test_no_plan_has_a_cross_join(spark, base):
    streamed = {n for n, fn in core().items() if fn.__wrapped__.__module__ == streams.__name__}
    bad = []
    for name, fn in core().items():
        if name in streamed | SINGLE_ROW_JOINS | RUNS_WHEN_BUILT:
            continue
        plan = fn(spark, base)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


@pytest.mark.parametrize("name", sorted(RUNS_WHEN_BUILT - MODELS))
def test_no_job_of_a_query_that_runs_while_built_has_a_cross_join(spark, base, name):
    """Their plans are taken from the jobs that they run, the last one from the result."""
    with executed_plans(spark) as plans:
        core()[name](spark, base).collect()
    assert plans and not [p for p in plans if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
