"""Operators against plain computations on small, skewed fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside.operators import assembly as A
from quayside.operators import history as H
from quayside.operators import maritime as M
from quayside.operators import rules as R
from quayside.operators import scoring as S
from quayside.operators import search
from quayside.operators.matching import best_containing
from quayside.operators.ordered import neighbour, numbered, pages, running
from quayside.sources.dims import rule_list
from quayside.sources.files import ingest_files


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(60), i, rng.randrange(-5, 9)) for i in range(600)]
    return spark.createDataFrame(rows, "k string, t int, id int, v int").cache()


def test_bucketed_windows_equal_plain_windows(skewed):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select("id", F.row_number().over(w).alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                         F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.lead("id").over(w).alias("nx"), F.lag("id").over(w).alias("pv"))
    order, bucket = [F.col("t"), F.col("id")], F.floor(F.col("t") / 7)
    n = numbered(skewed, ["k"], order, bucket).select("id", "n")
    s = running(skewed, ["k"], order, bucket, {"s": ("sum", F.col("v"))}).select("id", "s")
    m = running(skewed, ["k"], order, bucket, {"m": ("max", F.col("v"))}, include_current=False).select("id", "m")
    nx = neighbour(skewed, ["k"], ["t", "id"], bucket, ["id"], 1, "nx_").select("id", F.col("nx_id").alias("nx"))
    pv = neighbour(skewed, ["k"], ["t", "id"], bucket, ["id"], -1, "pv_").select("id", F.col("pv_id").alias("pv"))
    got = n.join(s, "id").join(m, "id").join(nx, "id").join(pv, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pages_are_bounded_and_whole(skewed):
    rows = pages(skewed, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 7), F.col("id"), size=50).collect()
    assert max(len(r["items"]) for r in rows) == 50
    hot = [i for r in sorted((r for r in rows if r["k"] == "hot"), key=lambda r: r["page"]) for i in r["items"]]
    assert hot == [r["id"] for r in skewed.where("k = 'hot'").orderBy("t", "id").collect()]


def test_exact_quantile(skewed):
    got = {r["k"]: r["quantile"] for r in H.exact_quantile(skewed, ["k"], "v", 0.95, F.floor(F.col("v") / 4)).collect()}
    for k, vs in {r["k"]: r["vs"] for r in skewed.groupBy("k").agg(F.collect_list("v").alias("vs")).collect()}.items():
        assert got[k] == pytest.approx(float(np.quantile(vs, 0.95)))


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(8) / 8, rng.random() < 0.4) for _ in range(120)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert S.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()["auc"] == pytest.approx(want, abs=1e-6)
    assert S.auc(spark.createDataFrame([(0.1, True)], "s double, y boolean"), "s", "y").first()["auc"] == 0.5


def test_promotions_compare_with_the_model_in_use(spark):
    runs = [("1", 0.80), ("2", 0.70), ("3", 0.785), ("4", 0.77), ("5", 0.764)]
    got = [r["promoted"] for r in S.promotions(spark.createDataFrame(runs, "version string, auc double")).orderBy("version").collect()]
    assert got == [True, False, True, True, True]


@pytest.mark.parametrize("profile,score,want", [
    ("agents", 85.0, "A"), ("agents", 70.0, "B"), ("agents", 55.0, "C"), ("agents", 40.0, "D"), ("agents", 39.9, "F"),
    ("api", 90.0, "A"), ("api", 80.0, "B"), ("api", 60.0, "D"), ("api", 59.9, "F"), ("spec", 55.0, "C"), ("spec", 54.9, "D")])
def test_grade_bounds(spark, profile, score, want):
    assert spark.range(1).select(S.grade(F.lit(score), profile)).first()[0] == want


def test_containment_against_all_pairs(spark):
    known = ["EVER GIVEN", "EVER GREEN", "GIVE", "AB", "CAP VERDE", "RDE", "X", "", None]
    want = ["EVER", "GIVE", "E", "RDE", "AB", "ZZZ", "X", "VER", "EVER", "", None, "longer than any of them"]
    names = spark.createDataFrame([(k,) for k in known], "name string")
    got = best_containing(spark.createDataFrame([(w,) for w in want], "want string"), names, F.sort_array(F.collect_set("name")))
    held = {w: sorted(k for k in known if k and w in k) for w in want if w}
    assert {r.want: r.best for r in got.collect()} == {w: ks for w, ks in held.items() if ks}


def test_a_word_that_every_vessel_shares_is_one_row_per_task(spark):
    """100,000 names with a common word: a batch that names only this word gets the newest position, and no pairs are made."""
    fleet = spark.range(0, 100_000, 1, 4).select(
        F.concat(F.lit("Vessel "), F.col("id").cast("string")).alias("vessel_name"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 100_003).alias("ts"),
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp").alias("eta"), F.col("id").cast("double").alias("speed"),
    )
    batches = spark.createDataFrame([(1, "VESSEL"), (2, "vessel 99999"), (3, "l 4242"), (4, "none"), (5, None)], "batch_id long, vessel_name string")
    got = {r.batch_id: r.ais_name for r in M.latest_position(batches, fleet).collect()}
    newest = max(range(100_000), key=lambda i: (i * 7919 % 100_003, i))
    near = max((i for i in range(100_000) if str(i).startswith("4242")), key=lambda i: i * 7919 % 100_003)
    assert got == {1: f"Vessel {newest}", 2: "Vessel 99999", 3: f"Vessel {near}", 4: None, 5: None}


def test_every_grid_and_brute_force_agree(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, embedding array<double>").repartition(3)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = sorted((q, c, p + 1) for q in range(90) for p, c in enumerate(sorted((c for c in range(90) if c != q), key=lambda c: (-sims[q, c], c))[:4]))
    for grid in ({}, {"tile_bytes": 16 * 64, "slices": 3}, {"tile_bytes": 4 * 64}, {"slices": 1}):
        got = search.nearest(df, df, 4, **grid).select("query_id", "match_id", "place").collect()
        assert sorted(map(tuple, got)) == want
    assert search.nearest(df, df.limit(0), 4).count() == 0 and search.nearest(df.limit(0), df, 4).count() == 0


def brute_texts(requests, catalogue, k):
    import math
    import re
    from collections import Counter

    held = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in catalogue}
    df, n = Counter(t for c in held.values() for t in c), len(held)
    idf = {t: math.log((n + 1) / (d + 1)) for t, d in df.items()}
    unit = lambda c: {t: v * idf[t] for t, v in c.items() if idf.get(t)}
    length = lambda w: math.sqrt(sum(v * v for v in w.values()))
    out = []
    for q, text in requests:
        w = unit(Counter(re.findall("[a-z0-9]+", (text or "").lower())))
        found = []
        for i, c in held.items():
            v = unit(c)
            p = sum(w[t] * v[t] for t in w if t in v)
            if p:
                found.append((-round(p / length(w) / length(v), 6), i))
        out += [(q, i, place, -sim) for place, (sim, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("grid", [{}, {"tile_entries": 7, "slices": 3}, {"tile_entries": 40, "slices": 1}])
def test_token_search_against_all_pairs(spark, grid):
    """Words of very unequal frequency, one in every entry, many equal entries; empty, missing and unheard-of texts."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    text = lambda n: " ".join(["everywhere", *rnd.choices(words, weights, k=n)])
    catalogue = [(i, text(rnd.randint(1, 12))) for i in range(80)] + [(100 + i, "everywhere same W1-w2") for i in range(12)]
    requests = [(i, text(rnd.randint(0, 20))) for i in range(50)] + [(60, None), (61, ""), (62, "nothing known"), (63, "everywhere"), (64, "same"), (65, "w3 " * 5000)]
    got = search.text_nearest(spark.createDataFrame(requests, "id bigint, text string").repartition(3), spark.createDataFrame(catalogue, "id bigint, text string").repartition(2), 4, **grid).collect()
    want = brute_texts(requests, catalogue, 4)
    assert sorted((r.query_id, r.match_id, r.place) for r in got) == sorted(w[:3] for w in want)
    assert max(abs(r.similarity - w[3]) for r, w in zip(sorted(got, key=lambda r: (r.query_id, r.place)), sorted(want, key=lambda w: (w[0], w[2])))) < 1e-9


def test_token_search_without_catalogue_or_requests(spark):
    some, none = spark.createDataFrame([(1, "a b")], "id bigint, text string"), spark.createDataFrame([], "id bigint, text string")
    assert search.text_nearest(some, none).count() == 0 and search.text_nearest(none, some).count() == 0


def test_ids_that_repeat_do_not_gather_in_one_tile(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.lit(7).cast("long").alias("id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, embedding array<double>")
    got = search.nearest(asked, rows, 5, tile_bytes=500 * 16, slices=2)
    assert got.count() == 5 and {r.match_id for r in got.collect()} == {7}


def _root(leaves):
    nodes = leaves
    while len(nodes) > 1:
        nodes = nodes + nodes[-1:] if len(nodes) % 2 else nodes
        nodes = [hashlib.sha256(nodes[i] + nodes[i + 1]).digest() for i in range(0, len(nodes), 2)]
    return nodes[0].hex()


def test_merkle_roots_in_small_blocks(spark):
    leaves = {b: [hashlib.sha256(f"{b}-{i}".encode()).digest() for i in range(b)] for b in range(1, 24)}
    rows = [(b, i + 1, d.hex()) for b, ds in leaves.items() for i, d in enumerate(ds)]
    got = {r["batch_id"]: r["merkle_root"] for r in A.merkle_roots(spark.createDataFrame(rows, "batch_id bigint, n bigint, digest string"), levels=2).collect()}
    assert got == {b: _root(ds) for b, ds in leaves.items()}


def test_failure_streaks_reset_on_success(spark):
    flags = [1, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, i, i * 4000, f == 1) for i, f in enumerate(flags)], "batch_id int, event_id int, s int, failed boolean")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = H.failure_streaks(df, F.col("failed")).orderBy("event_id").collect()
    assert [(r["event_id"], r["streak"]) for r in got] == [(2, 3), (3, 4), (10, 3)]


CLEAN = {
    "bill_of_lading": {"total_packages": "500", "gross_weight": "8,960.0", "currency": "USD", "bl_date": "2026-07-03", "arrival_date": "2026-07-09", "port_discharge_code": "IDJBK"},
    "packing_list": {"total_packages": "500", "gross_weight": "8960", "currency": "USD"},
    "invoice": {"currency": "USD", "fob_value": "11000", "freight": "900", "insurance": "100", "cif_value": "12000", "nib": "8120012345678", "npwp": "02.345.678.9-408.000", "hs_code": "73199000"},
}


def _pair(spark):
    bad = {k: dict(v) for k, v in CLEAN.items()}
    bad["packing_list"]["total_packages"] = "480"
    bad["invoice"].update(cif_value="10500", hs_code="731990", nib="812001234567")
    rows = [(b, f"{b}-{k}", k, f, v) for b, docs in ((1, CLEAN), (2, bad)) for k, fs in docs.items() for f, v in fs.items()]
    fields = spark.createDataFrame(rows, "batch_id bigint, doc_id string, doc_type string, field string, value string")
    items = spark.createDataFrame([(b, k, 4480.0) for b in (1, 2) for k in ("packing_list", "invoice") for _ in range(2)], "batch_id bigint, doc_type string, gross_weight double")
    return fields, items


def test_contrastive_pair_fails_exactly_the_planted_rules(spark):
    fields, items = _pair(spark)
    got = R.expression_rules(R.rule_scopes(fields, items), rule_list("rules_spec")).where("not passed").collect()
    assert sorted((r["batch_id"], r["rule_id"], r["severity"]) for r in got) == [
        (2, "CV001", "CRITICAL_FAIL"), (2, "CV002", "WARNING"), (2, "CV006", "CRITICAL_FAIL"), (2, "CV008", "CRITICAL_FAIL")]
    assert next(r["message"] for r in got if r["rule_id"] == "CV001") == "Package count B/L (500) differs from packing list (480)"


def test_missing_values_fail_a_rule(spark):
    fields = spark.createDataFrame([(1, "x", "invoice", "currency", "USD")], "batch_id bigint, doc_id string, doc_type string, field string, value string")
    rows = R.expression_rules(R.rule_scopes(fields), [r for r in rule_list("rules_spec") if "items" not in r["check"]]).collect()
    assert not any(r["passed"] for r in rows)


@pytest.mark.parametrize("pct,passed", [(1.0, True), (1.01, False)])
def test_tolerance_bound(spark, pct, passed):
    from quayside.sources.dims import load_rules

    rows = [(1, "a", "bill_of_lading", "gross_weight", "1000"), (1, "b", "packing_list", "gross_weight", str(1000 - 10 * pct))]
    fields = spark.createDataFrame(rows, "batch_id bigint, doc_id string, doc_type string, field string, value string")
    assert R.cross_document_tolerance(fields, load_rules(spark)).first()["passed"] is passed


def test_landing_folder(spark, tmp_path):
    for name, content in {"b1/bl_1.pdf": b"%PDF-1.7 x", "b1/inv.png": b"%PDF-1.7", "b1/note.txt": b"hi", "b2/packing.jpg": b"\xff\xd8\xff\xe0", "b2/big.pdf": b"%PDF" + b"x" * 100}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    got = {r["name"]: (r["accepted"], r["reject_reason"], r["doc_type"], r["file_hash"]) for r in ingest_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert got["bl_1.pdf"] == (True, None, "bill_of_lading", hashlib.sha256(b"%PDF-1.7 x").hexdigest())
    assert got["inv.png"][1] == "content does not match claimed type" and got["note.txt"][1] == "unsupported file type"
    assert got["packing.jpg"][:3] == (True, None, "packing_list") and got["big.pdf"][:2] == (False, "exceeds 50MB limit")


def test_first_present_field_of_a_rule_counts(spark):
    from quayside.sources.dims import load_rules

    rows = [(1, "a", "port_loading_code", None), (1, "a", "port_discharge_code", "IDJKT"), (1, "b", "port_loading_code", "x"), (1, "b", "port_discharge_code", "IDJKT"), (1, "b", "nib", None)]
    fields = spark.createDataFrame(rows, "batch_id bigint, doc_id string, field string, value string")
    got = sorted((r["doc_id"], r["rule_id"], r["passed"], r["error_message"]) for r in R.document_rules(fields, load_rules(spark)).collect())
    assert got == [("a", "CV011", True, None), ("b", "CV003", False, "Field 'nib' is missing"), ("b", "CV011", False, "Field 'port_loading_code' value 'x' failed CV011")]


def test_a_failing_rule_is_a_row(spark):
    rows = [(b, "d1", "invoice", f, v) for b, cif in (("b1", "0"), ("b2", "100")) for f, v in (("cif_value", cif), ("fob_value", "90"), ("freight", "9"), ("insurance", "1"), ("seal_number", "S1"))]
    fields = spark.createDataFrame(rows, "batch_id string, doc_id string, doc_type string, field string, value string")
    rules = [
        {"id": "ratio", "name": "ratio", "severity": "WARNING", "check": "abs(inv.fob_value + inv.freight + inv.insurance - inv.cif_value) / inv.cif_value <= 0.05"},
        {"id": "bracket", "name": "bracket", "severity": "WARNING", "check": "1 / (inv.cif_value - inv.cif_value) > 0 OR 1 / abs(inv.cif_value) > 0"},
        {"id": "seal", "name": "seal", "severity": "CRITICAL", "check": "inv.seal_number == 'S1'"},
        {"id": "quoted", "name": "quoted", "severity": "CRITICAL", "check": "inv.currency IS NULL AND 'a/inv.b' == 'a/inv.b'"},
    ]
    passed = lambda scopes: {(r.batch_id, r.rule_id) for r in R.expression_rules(scopes, rules).where("passed").collect()}
    assert passed(R.rule_scopes(fields)) == {("b2", "ratio"), ("b2", "bracket"), ("b1", "quoted"), ("b2", "quoted")}
    assert passed(R.rule_scopes(fields, extra=["seal_number"])) >= {("b1", "seal"), ("b2", "seal")}


def test_no_division_by_zero(spark):
    items = spark.createDataFrame([("b1", "packing_list", 5.0)], "batch_id string, doc_type string, gross_weight double")
    headers = spark.createDataFrame([("b1", 0.0, "IDJBK")], "batch_id string, bill_weight double, port string")
    assert [r.weight_ok for r in R.item_rules(items, headers).collect()] == [False]
    none = spark.createDataFrame([], "batch_id string, accepted boolean, ts timestamp, event_id long")
    assert [tuple(r) for r in H.first_attempt_rate(none).collect()] == [(0, None)]


def test_model_queries_train_the_full_model_once_on_the_tables(spark, base, monkeypatch, tmp_path):
    from quayside import constants as K
    from quayside.operators import models
    from quayside.plans import model_queries

    whole, asked = models.rejection_pipeline, []

    def small(features, **params):
        asked.append((list(features), params))
        return whole(features, trees=2, depth=2)

    monkeypatch.setattr(models, "rejection_pipeline", small)
    monkeypatch.setattr(model_queries, "store_of", lambda spark, base: model_queries.ModelStore(spark, str(tmp_path)))
    got = model_queries._importance(spark, base).collect()  # there is no model yet: one is trained, and found from then on
    assert model_queries._importance(spark, base).collect() == got and model_queries._score(spark, base).count() > 0
    assert len(asked) == 1 and model_queries._train(spark, base).first().trained
    assert asked == [(list(K.API_FEATURES), {})] * 2 and got and {r.feature for r in got} <= {*K.API_FEATURES}
    assert models.feature_importance(None, K.API_FEATURES, spark).count() == 0


def test_submission_chains_of_any_length_and_circles(spark):
    """Chains of 1 to 5,000, forks, an unknown parent, a repeated row, a circle of three and a tail that runs into it."""
    long = spark.range(5000).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    few = spark.createDataFrame(
        [(10_000, None), (10_001, 10_000), (10_002, 10_000), (10_003, 99_999), (10_003, 99_999), (20_000, 20_002), (20_001, 20_000), (20_002, 20_001), (20_003, 20_001), (30_000, 30_000)],
        "id long, parent long",
    )
    got = {r.id: (r.root, r.depth, r.cyclic) for r in H.submission_chain(long.unionByName(few)).collect()}
    assert len(got) == 5009 and all(got[i] == (0, i, False) for i in range(5000))
    assert got[10_000] == (10_000, 0, False) and got[10_001] == got[10_002] == (10_000, 1, False) and got[10_003] == (10_003, 0, False)
    assert {got[i] for i in (20_000, 20_001, 20_002, 20_003, 30_000)} == {(None, None, True)}
    assert H.submission_chain(long.limit(0)).count() == 0


def test_heat_map_keeps_years_apart(spark):
    days = ["2024-12-30", "2025-01-02", "2025-12-28", "2023-01-01"]
    rows = spark.createDataFrame([(d, "f") for d in days], "d string, field_name string").select(F.to_timestamp("d").alias("ts"), "field_name")
    assert sorted(map(tuple, H.correction_heat_map(rows).collect())) == [("f", 2022, 52, 1), ("f", 2025, 1, 2), ("f", 2025, 52, 1)]


def test_code_after_the_label_may_be_far_away(spark):
    from quayside.functions import extract as X

    text = "11112222 HS code: see below. " + "x " * 5000 + "848079 then 84807900"
    assert spark.createDataFrame([(text,)], "t string").select(X.hs_near_label(F.col("t"))).first()[0] == "84807900"
