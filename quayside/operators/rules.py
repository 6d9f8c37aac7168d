"""Declarative checks within and across the documents of a batch."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import validate as V
from quayside.functions.common import as_number
from quayside.functions.normalize import normalize_field
from quayside.sources.dims import rule_fields



def _named_check(rule: Column, value: Column, regex: Column) -> Column:
    """Validator of a numbered rule, else its pattern."""
    return (
        F.when(rule == "CV001", V.valid_hs(value))
        .when(rule == "CV003", V.valid_nib(value))
        .when(rule == "CV004", V.valid_npwp(value))
        .when(rule == "CV005", V.valid_container(value))
        .when(rule == "CV011", V.valid_unlocode(value))
        .otherwise(F.coalesce(F.regexp_like(F.trim(value), regex), F.lit(True)))
    )


def document_rules(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Format rules per document: an absent field gives no row, an empty one fails; of several fields the first present counts.

    Rules over one field (nearly all) are decided where the field row lies, without a shuffle; only
    rules that choose among several fields group by document. The rules are configuration of a few
    rows, so their field names are read first and reach the scan as a filter.
    """
    rules = rules.where(F.col("type").isin("regex", "regex_and_lookup", "lookup"))
    names = [r["fields"] for r in rules.select("fields").collect()]
    dim = rule_fields(rules)
    alone = F.size("fields") == 1

    def tested(wanted: list[str], which: Column) -> DataFrame:
        rows = fields.where(F.col("field").isin(wanted)).join(F.broadcast(dim.where(which).drop("scope", "tolerance_pct", "fields")), "field")
        # a lookup passes over empty values, a pattern rule fails on them
        return rows.where((F.col("type") != "lookup") | F.col("value").isNotNull())

    keys = ["batch_id", "doc_id", "id", "name", "severity", "regex"]
    first = tested([n[0] for n in names if len(n) == 1], alone).select(*keys, "field", "value")
    several = sorted({f for n in names if len(n) > 1 for f in n})
    if several:
        chosen = tested(several, ~alone).groupBy(*keys).agg(F.min_by(F.struct("field", "value"), "place").alias("f"))
        first = first.unionByName(chosen.select(*keys, "f.field", "f.value"))
    value, field = F.col("value"), F.col("field")
    # the verdict is a column of its own before it is used twice, so the checks are generated once
    judged = first.withColumn("passed", value.isNotNull() & _named_check(F.col("id"), value, F.col("regex")))
    message = F.when(value.isNull(), F.concat(F.lit("Field '"), field, F.lit("' is missing"))).when(
        ~F.col("passed"), F.concat(F.lit("Field '"), field, F.lit("' value '"), value, F.lit("' failed "), F.col("id"))
    )
    return judged.select(
        "batch_id", "doc_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity",
        "passed", message.alias("error_message"), F.array(field).alias("affected_fields"),
    )


def looked_at(rules: DataFrame) -> list[str]:
    """Names of the fields that the rules look at, for a filter next to the scan; rules are configuration of a few rows."""
    return sorted({f for r in rules.select("fields").collect() for f in r["fields"] or []})


def _in_scope(doc_type: Column, scope: Column) -> Column:
    return (F.size(scope) == 0) | F.array_contains(scope, doc_type)


def cross_document_match(fields: DataFrame, rules: DataFrame, scoped: bool = False) -> DataFrame:
    """Per batch, rule and field: at least two filled values of which all have one normal form, else failed.

    Values are first reduced to one row per normal form, so a batch with very many documents costs
    no more memory than its distinct values.
    """
    rules = rules.where("type = 'cross_document_match'")
    dim = rule_fields(rules)
    seen = fields.where(F.col("field").isin(looked_at(rules))).where("value is not null and value <> ''").join(F.broadcast(dim), "field")
    if scoped:
        seen = seen.where(_in_scope(F.col("doc_type"), F.col("scope")))
    forms = seen.groupBy("batch_id", "id", "name", "severity", "field", normalize_field(F.col("field"), F.col("value")).alias("form")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        forms.groupBy("batch_id", "id", "name", "severity", "field")
        .agg(F.sum("n").alias("values"), F.count("form").alias("forms"), F.min("form").alias("least"), F.max("form").alias("most"))
        .where("values >= 2")
        .select(
            "batch_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity", "field",
            (F.col("forms") <= 1).alias("passed"), "values", "forms",
            F.when(F.col("forms") > 1, F.concat(F.col("field"), F.lit(" mismatch across documents: "), F.col("forms").cast("string"), F.lit(" values from "), F.col("least"), F.lit(" to "), F.col("most"))).alias("error_message"),
        )
    )


def mismatched_values(fields: DataFrame, rules: DataFrame, crowded: bool = True) -> DataFrame:
    """The differing normal forms behind failed match rules, one row each with its documents counted.

    A rule fails where a field has more than one form. Where no batch is ``crowded`` the forms of a batch are counted where they lie, in one pass over the
    fields; else the rules are judged first, which needs no task that holds all forms of a batch."""
    rules = rules.where("type = 'cross_document_match'")
    fields = fields.where(F.col("field").isin(looked_at(rules)))
    dim = rule_fields(rules).select(F.col("id").alias("rule_id"), "field")
    forms = (
        fields.where("value is not null and value <> ''").join(F.broadcast(dim), "field")
        .groupBy("batch_id", "rule_id", "field", normalize_field(F.col("field"), F.col("value")).alias("form")).agg(F.count(F.lit(1)).alias("documents"))
    )
    if not crowded:
        among = Window.partitionBy("batch_id", "rule_id", "field")
        return forms.where("batch_id is not null").withColumn("forms", F.count("form").over(among)).where("forms > 1").drop("forms")
    failed = cross_document_match(fields, rules).where("not passed").select("batch_id", "rule_id", "field")
    # the few failed fields of a batch are packed: forms that lie by batch are not moved again
    packed = failed.groupBy("batch_id").agg(F.collect_set(F.struct("rule_id", "field")).alias("failed"))
    own = F.exists("failed", lambda f: (f["rule_id"] == F.col("rule_id")) & (f["field"] == F.col("field")))
    return forms.join(packed, "batch_id").where(own).drop("failed")


def cross_document_tolerance(fields: DataFrame, rules: DataFrame, profile: str = "agents") -> DataFrame:
    """Numeric agreement across documents: spread against the maximum, or every value against the first one."""
    rules = rules.where("type = 'cross_document' and tolerance_pct > 0")
    dim = rule_fields(rules)
    seen = fields.where(F.col("field").isin(looked_at(rules))).withColumn("number", as_number(F.col("value"))).where("number is not null").join(F.broadcast(dim), "field")
    if profile == "api":
        seen = seen.where(_in_scope(F.col("doc_type"), F.col("scope")))
    lo_hi = seen.groupBy("batch_id", "id", "name", "severity", "field", "tolerance_pct").agg(
        F.count(F.lit(1)).alias("values"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.min_by("number", "doc_id").alias("first"),
    ).where("values >= 2")
    if profile == "agents":
        lo_hi = lo_hi.where("high <> 0")
        pct = F.abs(F.col("high") - F.col("low")) / F.col("high") * 100
    else:
        far = F.greatest(F.abs(F.col("high") - F.col("first")), F.abs(F.col("low") - F.col("first")))
        pct = F.when(F.col("first") != 0, far / F.abs(F.col("first")) * 100).otherwise(
            F.when((F.col("low") == 0) & (F.col("high") == 0), F.lit(0.0)).otherwise(F.lit(float("inf")))
        )
    return lo_hi.withColumn("pct", pct).select(
        "batch_id", F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity", "field", "values",
        (F.col("pct") <= F.col("tolerance_pct")).alias("passed"), "pct",
    )


def cif_consistency(fields: DataFrame, tolerance_pct: float = 0.5, keys: Sequence[str] = ("batch_id", "doc_id")) -> DataFrame:
    """CIF against FOB + freight + insurance; a missing part or a zero CIF fails."""
    parts = ["cif_value", "fob_value", "freight", "insurance"]
    wide = fields.where(F.col("field").isin(parts)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == p, as_number(F.col("value")))).alias(p) for p in parts]
    )
    total = F.col("fob_value") + F.col("freight") + F.col("insurance")
    pct = F.when(F.col("cif_value") != 0, F.abs(F.col("cif_value") - total) / F.col("cif_value") * 100)
    return wide.select(*keys, pct.alias("diff_pct"), F.coalesce(pct <= tolerance_pct, F.lit(False)).alias("passed"))


def date_sequence(fields: DataFrame, names: Sequence[str] = ("bl_date", "etd", "eta"), keys: Sequence[str] = ("batch_id", "doc_id")) -> DataFrame:
    """Dates must not run backwards; a missing date is passed over."""
    wide = fields.where(F.col("field").isin(list(names))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == n, F.to_date(F.try_to_timestamp("value", F.lit("yyyy-MM-dd"))))).alias(n) for n in names]
    )
    ok = F.lit(True)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            ok = ok & F.coalesce(F.col(a) <= F.col(b), F.lit(True))
    return wide.select(*keys, ok.alias("passed"))


# --- expression rules ---------------------------------------------------------------------------------------

SCOPES = {"bl": "bill_of_lading", "pl": "packing_list", "inv": "invoice"}
NUMBERS = ["total_packages", "gross_weight", "net_weight", "cif_value", "fob_value", "freight", "insurance"]
TEXTS = ["currency", "hs_code", "nib", "npwp", "bl_date", "arrival_date", "port_discharge_code", "port_discharge", "vessel_name", "voyage_number", "bl_number"]


def register_rule_functions(spark) -> None:
    """Functions rule texts may call, as SQL functions so that their bodies are optimised with the rule."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION regex_match(v STRING, p STRING) RETURNS BOOLEAN "
        "RETURN coalesce(regexp_like(v, concat('^(?:', p, ')$')), false)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION npwp_checksum_valid(v STRING) RETURNS BOOLEAN "
        "RETURN coalesce(length(regexp_replace(v, '[^0-9]', '')) IN (15, 16), false)"
    )


def rule_text(check: str) -> str:
    """Rule text in Spark SQL: item sums and counts are columns of the scope, computed before; a divisor of zero gives
    null, so that the rule fails for that batch instead of ending the job."""
    check = re.sub(r"sum\((\w+)\.items\.?\[\*\]\.(\w+)\)", r"\1.items_\2", check)
    check = re.sub(r"count\((\w+)\.items\)", r"\1.items_count", check)
    return _outside_quotes(check, r"/\s*([\w.]*\([^()]*\)|[\w.]++(?!\s*\())", r"/ nullif(\1, 0)")


def _outside_quotes(check: str, pattern: str, by) -> str:
    parts = re.split(r"('[^']*')", check)
    return "".join(p if i % 2 else re.sub(pattern, by, p) for i, p in enumerate(parts))


def _known_fields(check: str, scopes: DataFrame) -> str:
    """The rule with null in place of fields that the scopes do not have."""
    known = {f.name: set(f.dataType.names) for f in scopes.schema if hasattr(f.dataType, "names")}

    def field(m: re.Match) -> str:
        return m[0] if m[1] not in known or m[2] in known[m[1]] else "CAST(NULL AS STRING)"

    return _outside_quotes(check, r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\b", field)


def rule_scopes(fields: DataFrame, items: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per batch with a struct per document type, the combined fields, the item and the importer.

    Reduced in two steps: first the last value per (batch, type, field) on the map side, then one list per batch, whose length is bounded by the types and
    the fixed field list with the ``extra`` text fields that rules name. Structs look their values up in it; those that no rule reads are
    never looked up, as the optimiser drops them.
    """
    texts = list(dict.fromkeys([*TEXTS, *(e for e in extra if e not in NUMBERS)]))
    kept = fields.where(F.col("field").isin(NUMBERS + texts) & F.col("value").isNotNull())
    kind_of = F.when(F.col("doc_type").isin(list(SCOPES.values())), F.col("doc_type")).otherwise("other").alias("doc_type")
    last = kept.groupBy("batch_id", kind_of, "field").agg(F.max(F.struct("doc_id", "value")).alias("last"))
    per = last.groupBy("batch_id").agg(F.collect_list(F.struct("doc_type", "field", F.col("last.doc_id").alias("doc_id"), F.col("last.value").alias("value"))).alias("read"))
    by_type = F.map_from_entries(F.transform("read", lambda r: F.struct(F.concat_ws(":", r["doc_type"], r["field"]), F.struct(r["doc_id"], r["value"].alias("value")))))
    held = per.select("batch_id", by_type.alias("by_type"))

    def cell(name: str, kind: str | None) -> Column:
        found = [F.try_element_at("by_type", F.lit(f"{k}:{name}")) for k in ([kind] if kind else [*SCOPES.values(), "other"])]
        value = (F.greatest(*found) if len(found) > 1 else found[0])["value"]  # of several types the last document decides
        return (as_number(value) if name in NUMBERS else value).alias(name)

    scope = {s: F.struct(*[cell(n, kind) for n in NUMBERS + texts]).alias(s) for s, kind in SCOPES.items()}
    wide = held.select("batch_id", *scope.values(), F.struct(*[cell(n, None) for n in NUMBERS + texts]).alias("data"))
    wide = wide.withColumn("item", F.col("data")).withColumn("importir", F.col("data"))
    if items is not None:
        per_type = items.groupBy("batch_id", "doc_type").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("gross_weight").cast("decimal(18,4)")).cast("double").alias("w")
        )
        sums = per_type.groupBy("batch_id").agg(
            *[F.max(F.when(F.col("doc_type") == kind, F.struct("n", "w"))).alias(f"_{s}") for s, kind in SCOPES.items()]
        )
        wide = wide.join(sums, "batch_id", "left")
        for s in SCOPES:
            wide = wide.withColumn(
                s, F.col(s).withField("items_count", F.coalesce(F.col(f"_{s}.n"), F.lit(0.0))).withField("items_gross_weight", F.coalesce(F.col(f"_{s}.w"), F.lit(0.0)))
            ).drop(f"_{s}")
    return wide


def _message(template: str | None, name: str) -> Column:
    holes = {
        "bl": F.col("bl.total_packages").cast("bigint").cast("string"), "pl": F.col("pl.total_packages").cast("bigint").cast("string"),
        "inv": F.col("inv.currency"), "npwp": F.col("importir.npwp"), "hs_code": F.col("item.hs_code"),
        "bl_date": F.col("bl.bl_date"), "arrival_date": F.col("bl.arrival_date"), "diff": F.lit("n/a"),
    }
    parts = re.split(r"(\{\w+\})", template or name)
    return F.concat(*[F.coalesce(holes[p[1:-1]], F.lit("None")) if p.startswith("{") and p[1:-1] in holes else F.lit(p) for p in parts])


def expression_rules(scopes: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """All rules of a set in one pass over the scopes; a missing value, an unknown field or a divisor of zero fails the rule."""
    register_rule_functions(scopes.sparkSession)
    cells = []
    for r in rules:
        passed = F.coalesce(F.expr(_known_fields(rule_text(r["check"]), scopes)), F.lit(False))
        cells.append(
            F.struct(
                F.lit(r["id"]).alias("rule_id"), F.lit(r["name"]).alias("rule_name"),
                F.when(passed, "PASS").otherwise("CRITICAL_FAIL" if r["severity"] in ("CRITICAL", "ERROR") else "WARNING").alias("severity"),
                passed.alias("passed"),
                F.when(passed, F.lit(r["name"])).otherwise(_message(r.get("error_message"), r["name"])).alias("message"),
            )
        )
    # SQL functions may not sit inside a generator, so the results are a column first
    return scopes.select("batch_id", F.array(*cells).alias("results")).select("batch_id", F.inline("results"))


def item_rules(items: DataFrame, headers: DataFrame, home_port: str = "IDJBK") -> DataFrame:
    """Sum of the packing weights against the bill, line counts of list and invoice, port of delivery."""
    per = items.groupBy("batch_id").agg(
        F.sum(F.when(F.col("doc_type") == "packing_list", F.col("gross_weight").cast("decimal(18,4)"))).cast("double").alias("packed"),
        F.count_if(F.col("doc_type") == "packing_list").alias("packing_lines"), F.count_if(F.col("doc_type") == "invoice").alias("invoice_lines"),
    )
    joined = headers.join(per, "batch_id", "left")
    return joined.select(
        "batch_id",
        F.coalesce(F.try_divide(F.abs(F.col("bill_weight") - F.col("packed")), F.col("bill_weight")) <= 0.02, F.lit(False)).alias("weight_ok"),
        (F.abs(F.coalesce("packing_lines", F.lit(0)) - F.coalesce("invoice_lines", F.lit(0))) <= 1).alias("lines_ok"),
        F.coalesce(F.col("port") == home_port, F.lit(False)).alias("port_ok"),
    )


def schema_errors(declarations: DataFrame, items: DataFrame) -> DataFrame:
    """Errors of assembled declarations as rows: missing header parts, entity numbers, tariff codes, CIF within 5 %."""
    c = F.col
    required = ["aju_number", "fob", "freight", "insurance", "cif"]
    computed = F.coalesce("fob", F.lit(0.0)) + F.coalesce("freight", F.lit(0.0)) + F.coalesce("insurance", F.lit(0.0))

    def err(test: Column, field: str, code: str, text: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(text).alias("message")))

    checks = [err(c(f).isNull(), f, "REQUIRED_FIELD_MISSING", f"Field {f} is required") for f in required]
    checks += [
        err(F.length(F.coalesce("nib", F.lit(""))) != 13, "nib", "E031", "NIB must have 13 digits"),
        err(F.coalesce("npwp", F.lit("")) == "", "npwp", "E032", "NPWP is required"),
        err(F.abs(computed - F.coalesce("cif", F.lit(0.0))) / F.greatest(computed, F.lit(1.0)) > 0.05, "cif", "E015", "CIF differs from FOB + freight + insurance"),
    ]
    header = declarations.select("batch_id", F.inline(F.array_compact(F.array(*checks))))
    bad = items.where(~V.valid_hs(c("hs_code")) | c("hs_code").contains(".")).select(
        "batch_id", F.concat(F.lit("items["), c("line").cast("string"), F.lit("].hs_code")).alias("field"), F.lit("E004").alias("code"),
        F.concat(F.lit("Tariff code is not valid: "), F.coalesce("hs_code", F.lit(""))).alias("message"),
    )
    return header.unionByName(bad)


def validation_summary(results: DataFrame) -> DataFrame:
    """Counts per batch by outcome and severity; a failed ERROR or CRITICAL blocks."""
    blocking = ~F.col("passed") & F.col("severity").isin("ERROR", "CRITICAL", "CRITICAL_FAIL")
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(blocking).alias("blocking"), F.count_if(~F.col("passed") & (F.col("severity") == "WARNING")).alias("warnings"),
    ).withColumn("valid", F.col("blocking") == 0)


