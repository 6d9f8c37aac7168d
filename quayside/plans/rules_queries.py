"""Rule queries over typed fields of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.common import rnd
from quayside.functions.normalize import normalize_field
from quayside.operators import rules as R
from quayside.operators.voting import majority_vote
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.scalar_queries import CODE8, long_fields
from quayside.plans.voting_queries import by_batch, rec_sql, reconciled
from quayside.sources.dims import load_rules, rule_list
from quayside.sources.tables import dealt

# Wide reading of a document; the checking engine uses the same columns.
TYPED = f"""SELECT *, total_c + CASE l_partkey % 4 WHEN 1 THEN total_c * 3 // 100 WHEN 2 THEN total_c * 10 // 100 ELSE 0 END AS cif_c FROM (
    SELECT batch_id, doc_id, doc_type, l_partkey, l_linenumber, fob_c, fob_c * tax_p // 100 AS freight_c, fob_c * disc_p // 100 AS insurance_c, fob_c + fob_c * tax_p // 100 + fob_c * disc_p // 100 AS total_c,
      l_quantity::BIGINT AS packages, CASE WHEN l_partkey % 10 = 0 THEN 'IDR' ELSE 'USD' END AS currency, CASE WHEN l_partkey % 25 = 0 THEN left({CODE8}, 6) ELSE {CODE8} END AS hs_code,
      lpad(l_partkey::VARCHAR, CASE WHEN l_partkey % 6 = 0 THEN 12 ELSE 13 END, '8') AS nib, lpad(l_partkey::VARCHAR, CASE WHEN l_partkey % 9 = 0 THEN 14 ELSE 15 END, '7') AS npwp,
      l_shipdate AS bl_date, l_shipdate + to_days(CASE WHEN l_partkey % 8 = 0 THEN -2 ELSE 5 END) AS arrival, CASE WHEN l_partkey % 5 = 0 THEN 'IDJKT' ELSE 'IDJBK' END AS port
    FROM (SELECT *, (l_extendedprice::DECIMAL(18,2) * 100)::BIGINT AS fob_c, (l_tax::DECIMAL(6,2) * 100)::BIGINT AS tax_p, (l_discount::DECIMAL(6,2) * 100)::BIGINT AS disc_p FROM docs))"""


def typed_documents(spark, base) -> DataFrame:
    return shape_typed(B.documents_of_batches(spark, base))


def shape_typed(d: DataFrame) -> DataFrame:
    """Wide fields of every document, money in cents; serves batch reads and streams alike."""
    pk = F.col("l_partkey")
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    d = d.withColumn("fob_c", cents)
    d = d.withColumn("freight_c", F.floor(F.col("fob_c") * (F.col("l_tax").cast("decimal(6,2)") * 100).cast("bigint") / 100).cast("bigint"))
    d = d.withColumn("insurance_c", F.floor(F.col("fob_c") * (F.col("l_discount").cast("decimal(6,2)") * 100).cast("bigint") / 100).cast("bigint"))
    total = F.col("fob_c") + F.col("freight_c") + F.col("insurance_c")
    extra = F.when(F.pmod(pk, F.lit(4)) == 1, F.floor(total * 3 / 100)).when(F.pmod(pk, F.lit(4)) == 2, F.floor(total * 10 / 100)).otherwise(0)
    tariff = F.lpad(pk.cast("string"), 8, "0")
    ship = F.col("l_shipdate").cast("date")
    return d.select(
        "batch_id", "doc_id", "doc_type", "l_partkey", "l_linenumber", "fob_c", "freight_c", "insurance_c", (total + extra).cast("bigint").alias("cif_c"),
        F.col("l_quantity").cast("bigint").alias("packages"), F.when(F.pmod(pk, F.lit(10)) == 0, "IDR").otherwise("USD").alias("currency"),
        F.when(F.pmod(pk, F.lit(25)) == 0, F.left(tariff, F.lit(6))).otherwise(tariff).alias("hs_code"),
        F.when(F.pmod(pk, F.lit(6)) == 0, F.lpad(pk.cast("string"), 12, "8")).otherwise(F.lpad(pk.cast("string"), 13, "8")).alias("nib"),
        F.when(F.pmod(pk, F.lit(9)) == 0, F.lpad(pk.cast("string"), 14, "7")).otherwise(F.lpad(pk.cast("string"), 15, "7")).alias("npwp"),
        ship.alias("bl_date"), F.date_add(ship, F.when(F.pmod(pk, F.lit(8)) == 0, -2).otherwise(5)).alias("arrival"),
        F.when(F.pmod(pk, F.lit(5)) == 0, "IDJKT").otherwise("IDJBK").alias("port"),
    )


def _money(c: str):
    return (F.col(c).cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")


def typed_fields(spark, base) -> DataFrame:
    # dealt out before the texts of the wide reading are made, which would be moved along
    return fields_of(shape_typed(dealt(B.documents_of_batches(spark, base), "batch_id")))


def fields_of(d: DataFrame) -> DataFrame:
    """The wide fields as rows."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    cells = {
        "total_packages": F.col("packages").cast("string"), "gross_weight": _money("fob_c"), "currency": F.col("currency"), "hs_code": F.col("hs_code"),
        "nib": F.col("nib"), "npwp": F.col("npwp"), "bl_date": day("bl_date"), "etd": day("bl_date"), "arrival_date": day("arrival"), "eta": day("arrival"),
        "cif_value": _money("cif_c"), "fob_value": _money("fob_c"), "freight": _money("freight_c"), "insurance": _money("insurance_c"),
        "port_discharge_code": F.col("port"),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in cells.items()])
    return d.select("batch_id", "doc_id", "doc_type", F.inline(rows))


def items_of(spark, base) -> DataFrame:
    return typed_documents(spark, base).select("batch_id", "doc_type", (F.col("fob_c") / 100).alias("gross_weight"))


_DOC_RULES = """SELECT batch_id, doc_id, unnest(['CV001','CV003','CV004','CV005','CV011']) AS rule_id, unnest(['ERROR','ERROR','ERROR','WARNING','ERROR']) AS severity,
    unnest([true, true, true, true, l_partkey % 4 <> 0]) AS passed,
    unnest([NULL, NULL, NULL, NULL, CASE WHEN l_partkey % 4 = 0 THEN 'Field ''port_loading_code'' value ''IDJKT1'' failed CV011' END]) AS error_message FROM docs"""


@query("doc_rules", oracle(_DOC_RULES, "docs"))
def _doc_rules(spark, base):
    fields = long_fields(spark, base).select("batch_id", "doc_id", "field", normalize_field(F.col("field"), F.col("raw")).alias("value"))
    return R.document_rules(fields, load_rules(spark)).select("batch_id", "doc_id", "rule_id", "severity", "passed", "error_message")


@query("rules_dim", rec_sql("""SELECT rule_id, severity, field, count(*) AS readings, count(DISTINCT batch_id) AS batches FROM rec JOIN
    (SELECT unnest(['CV001','CV007','CV008','CV009']) AS rule_id, unnest(['ERROR','WARNING','WARNING','ERROR']) AS severity, unnest(['hs_code','gross_weight','total_packages','vessel_name']) AS field) USING (field) GROUP BY 1, 2, 3"""))
def _rules_dim(spark, base):
    from quayside.sources.dims import rule_fields

    dim = rule_fields(load_rules(spark)).select(F.col("id").alias("rule_id"), "severity", "field")
    return by_batch(spark, base, majority_vote).join(F.broadcast(dim), "field").groupBy("rule_id", "severity", "field").agg(
        F.count(F.lit(1)).alias("readings"), F.count_distinct("batch_id").alias("batches")
    )


@query("cross_doc_match", rec_sql("""SELECT batch_id, CASE field WHEN 'total_packages' THEN 'CV008' ELSE 'CV009' END AS rule_id, CASE field WHEN 'total_packages' THEN 'WARNING' ELSE 'ERROR' END AS severity, field,
    count(*) AS values, count(DISTINCT value) AS forms, count(DISTINCT value) <= 1 AS passed FROM rec WHERE field IN ('total_packages', 'vessel_name') AND value IS NOT NULL GROUP BY batch_id, field HAVING count(*) >= 2"""))
def _match(spark, base):
    found = by_batch(spark, base, lambda obs: R.cross_document_match(majority_vote(obs), load_rules(spark)))
    return found.select("batch_id", "rule_id", "severity", "field", "values", "forms", "passed")


@query("cross_doc_match_scoped", rec_sql("""SELECT batch_id, 'CV008' AS rule_id, count(*) AS values, count(DISTINCT value) <= 1 AS passed FROM rec WHERE field = 'total_packages' AND value IS NOT NULL AND doc_type <> 'invoice' GROUP BY batch_id HAVING count(*) >= 2"""))
def _match_scoped(spark, base):
    rules = load_rules(spark).where("id = 'CV008'")
    return R.cross_document_match(reconciled(spark, base), rules, scoped=True).select("batch_id", "rule_id", "values", "passed")


@query("mismatched_values", rec_sql("""SELECT batch_id, field, value AS form, count(*) AS documents FROM rec WHERE field IN ('total_packages', 'vessel_name') AND value IS NOT NULL
    AND (batch_id, field) IN (SELECT (batch_id, field) FROM rec WHERE value IS NOT NULL GROUP BY batch_id, field HAVING count(DISTINCT value) > 1) GROUP BY 1, 2, 3"""))
def _mismatch(spark, base):
    few, many = B.observations_by_batch(spark, base)
    rules = load_rules(spark)
    found = R.mismatched_values(majority_vote(few), rules, crowded=False).unionByName(R.mismatched_values(majority_vote(many), rules))
    return found.select("batch_id", "field", "form", "documents")


@query("cross_doc_tolerance", rec_sql("""SELECT batch_id, 'CV007' AS rule_id, values, round(a::DECIMAL(18,8), 4)::DOUBLE AS agents_pct, a <= 1.0 AS agents_passed, round(b::DECIMAL(18,8), 4)::DOUBLE AS api_pct, b <= 1.0 AS api_passed FROM
    (SELECT batch_id, count(*) AS values, abs(max(v) - min(v)) / max(v) * 100 AS a FROM w GROUP BY 1 HAVING count(*) >= 2) x LEFT JOIN
    (SELECT batch_id, greatest(abs(max(v) - arg_min(v, doc_id)), abs(min(v) - arg_min(v, doc_id))) / abs(arg_min(v, doc_id)) * 100 AS b FROM w WHERE doc_type <> 'invoice' GROUP BY 1 HAVING count(*) >= 2) y USING (batch_id)""",
    w="SELECT batch_id, doc_id, doc_type, value::DOUBLE AS v FROM rec WHERE field = 'gross_weight' AND value IS NOT NULL"))
def _tolerance(spark, base):
    rec, rules = reconciled(spark, base), load_rules(spark)
    a = R.cross_document_tolerance(rec, rules).select("batch_id", "rule_id", "values", rnd(F.col("pct"), 4).alias("agents_pct"), F.col("passed").alias("agents_passed"))
    b = R.cross_document_tolerance(rec, rules, "api").select("batch_id", rnd(F.col("pct"), 4).alias("api_pct"), F.col("passed").alias("api_passed"))
    return a.join(b, "batch_id", "left")


@query("cif_consistency", oracle("""SELECT batch_id, doc_id, round((abs(cif_c / 100.0::DOUBLE - (fob_c / 100.0::DOUBLE + freight_c / 100.0::DOUBLE + insurance_c / 100.0::DOUBLE)) / (cif_c / 100.0::DOUBLE) * 100)::DECIMAL(18,8), 3)::DOUBLE AS diff_pct,
    abs(cif_c / 100.0::DOUBLE - (fob_c / 100.0::DOUBLE + freight_c / 100.0::DOUBLE + insurance_c / 100.0::DOUBLE)) / (cif_c / 100.0::DOUBLE) * 100 <= 5.0 AS passed FROM typed""", "docs", typed=TYPED))
def _cif(spark, base):
    out = R.cif_consistency(typed_fields(spark, base), 5.0)
    return out.select("batch_id", "doc_id", rnd(F.col("diff_pct"), 3).alias("diff_pct"), "passed")


@query("date_sequence", oracle("SELECT batch_id, doc_id, bl_date <= arrival AS passed FROM typed", "docs", typed=TYPED))
def _dates(spark, base):
    return R.date_sequence(typed_fields(spark, base))


_SCOPES = {
    "typed": TYPED,
    "last": """SELECT batch_id, doc_type, arg_max(packages, doc_id) AS packages, arg_max(fob_c, doc_id) / 100.0::DOUBLE AS fob, arg_max(freight_c, doc_id) / 100.0::DOUBLE AS freight, arg_max(insurance_c, doc_id) / 100.0::DOUBLE AS insurance,
        arg_max(cif_c, doc_id) / 100.0::DOUBLE AS cif, arg_max(currency, doc_id) AS currency, arg_max(nib, doc_id) AS nib, arg_max(bl_date, doc_id) AS bl_date, arg_max(arrival, doc_id) AS arrival, arg_max(port, doc_id) AS port,
        count(*) AS n, sum((fob_c / 100.0::DOUBLE)::DECIMAL(18,4))::DOUBLE AS w FROM typed GROUP BY 1, 2""",
    "alls": "SELECT batch_id, arg_max(hs_code, doc_id) AS hs_code, arg_max(npwp, doc_id) AS npwp FROM typed GROUP BY 1",
    "j": """SELECT a.*, bl.packages AS bl_packages, pl.packages AS pl_packages, bl.fob AS bl_weight, bl.bl_date, bl.arrival, bl.port, inv.fob, inv.freight, inv.insurance, inv.cif, inv.currency AS inv_currency, inv.nib, pl.currency AS pl_currency,
        coalesce(pl.w, 0) AS pl_w, coalesce(pl.n, 0) AS pl_n, coalesce(inv.n, 0) AS inv_n FROM alls a LEFT JOIN last bl ON a.batch_id = bl.batch_id AND bl.doc_type = 'bill_of_lading'
        LEFT JOIN last pl ON a.batch_id = pl.batch_id AND pl.doc_type = 'packing_list' LEFT JOIN last inv ON a.batch_id = inv.batch_id AND inv.doc_type = 'invoice'""",
    "checks": """SELECT batch_id, unnest(['CV001','CV002','CV003','CV004','CV005','CV006','CV007','CV008','CV009','CV010']) AS rule_id, unnest([true,false,true,true,false,true,true,true,true,false]) AS crit,
        unnest([coalesce(abs(bl_packages - pl_packages) <= 0, false), coalesce(abs((fob + freight + insurance) - cif) / cif <= 0.05, false), coalesce(bl_date <= arrival, false), coalesce(inv_currency = pl_currency, false),
        coalesce(abs(bl_weight - pl_w) / bl_weight <= 0.02, false), length(hs_code) = 8, length(npwp) = 15, coalesce(length(nib) = 13, false), coalesce(port = 'IDJBK', false), abs(pl_n - inv_n) <= 1]) AS passed FROM j""",
}


def rule_results(spark, base) -> DataFrame:
    scopes = R.rule_scopes(typed_fields(spark, base), items_of(spark, base))
    return R.expression_rules(scopes, rule_list("rules_spec"))


@query("expression_rules", oracle("SELECT batch_id, rule_id, passed, CASE WHEN passed THEN 'PASS' WHEN crit THEN 'CRITICAL_FAIL' ELSE 'WARNING' END AS severity FROM checks", "docs", **_SCOPES))
def _expression(spark, base):
    return rule_results(spark, base).select("batch_id", "rule_id", "passed", "severity")


@query("item_rules", oracle("""SELECT batch_id, coalesce(abs(bl_weight - CASE WHEN pl_n > 0 THEN pl_w END) / bl_weight <= 0.02, false) AS weight_ok, abs(pl_n - inv_n) <= 1 AS lines_ok, coalesce(port = 'IDJBK', false) AS port_ok FROM j WHERE bl_weight IS NOT NULL""", "docs", **_SCOPES))
def _items(spark, base):
    bills = typed_documents(spark, base).where("doc_type = 'bill_of_lading'").groupBy("batch_id").agg(F.max(F.struct("doc_id", (F.col("fob_c") / 100).alias("w"), "port")).alias("b"))
    headers = bills.select("batch_id", F.col("b.w").alias("bill_weight"), F.col("b.port").alias("port"))
    return R.item_rules(items_of(spark, base), headers)


@query("schema_validate", oracle("""SELECT batch_id, field, code FROM (SELECT batch_id, unnest(['nib', 'npwp', 'cif', 'aju_number']) AS field, unnest(['E031', 'E032', 'E015', 'REQUIRED_FIELD_MISSING']) AS code,
      unnest([length(nib) <> 13, false, abs(t - cif) / greatest(t, 1.0) > 0.05, packages % 10 = 0]) AS bad
      FROM (SELECT *, fob + freight + insurance AS t FROM last WHERE doc_type = 'invoice')) WHERE bad
    UNION ALL SELECT batch_id, 'items[' || l_linenumber::VARCHAR || '].hs_code', 'E004' FROM typed WHERE length(hs_code) <> 8""", "docs", **_SCOPES))
def _schema(spark, base):
    d = typed_documents(spark, base)
    inv = d.where("doc_type = 'invoice'").groupBy("batch_id").agg(F.max(F.struct("doc_id", "packages", "fob_c", "freight_c", "insurance_c", "cif_c", "nib", "npwp")).alias("i"))
    header = inv.select(
        "batch_id", F.when(F.pmod("i.packages", F.lit(10)) != 0, F.col("i.doc_id")).alias("aju_number"), (F.col("i.fob_c") / 100).alias("fob"), (F.col("i.freight_c") / 100).alias("freight"),
        (F.col("i.insurance_c") / 100).alias("insurance"), (F.col("i.cif_c") / 100).alias("cif"), F.col("i.nib").alias("nib"), F.col("i.npwp").alias("npwp"),
    )
    return R.schema_errors(header, d.select("batch_id", F.col("l_linenumber").alias("line"), "hs_code")).select("batch_id", "field", "code")


@query("validation_summary", oracle("""SELECT batch_id, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (NOT passed AND crit) AS blocking,
    count(*) FILTER (NOT passed AND NOT crit) AS warnings, count(*) FILTER (NOT passed AND crit) = 0 AS valid FROM checks GROUP BY 1""", "docs", **_SCOPES))
def _summary(spark, base):
    return R.validation_summary(rule_results(spark, base))
