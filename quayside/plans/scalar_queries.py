"""Round-trip queries of the column builders: values of the tables printed in raw forms and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions import extract as X
from quayside.functions import normalize as N
from quayside.functions import validate as V
from quayside.functions.common import rnd
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.sources.tables import read_table, spread


def pick(selector: Column, *forms: Column) -> Column:
    """Form number ``selector`` of the list, evaluated lazily."""
    chain = F.when(selector == 0, forms[0])
    for i, form in enumerate(forms[1:], start=1):
        chain = chain.when(selector == i, form)
    return chain


def lines(spark, base) -> DataFrame:
    return B.documents_of_batches(spark, base).withColumn("pk", F.col("l_partkey"))


# --- dates -------------------------------------------------------------------------------------------------

def raw_dates(spark, base) -> DataFrame:
    orders = read_table(spark, base, "orders", ["o_orderkey", "o_orderdate"])
    d = F.col("o_orderdate").cast("timestamp")
    late = F.dayofmonth(d) > 12
    plain = [F.date_format(d, p) for p in K.DATE_LAYOUTS[:9]]
    month_first = F.when(late, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "d/M/yyyy"))
    iso = F.date_format(d, "yyyy-MM-dd HH:mm:ss")
    carrier = [F.upper(F.date_format(d, p)) for _, p in K.CARRIER_DATE_LAYOUTS]
    hidden = F.upper(F.concat(F.date_format(d, "MMM"), F.lit("-XX-"), F.date_format(d, "yyyy")))
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("batch_id"),
        pick(F.pmod(key, F.lit(11)), *plain, month_first, iso).alias("raw"),
        pick(F.pmod(key, F.lit(9)), *carrier, hidden).alias("carrier_raw"),
    )


@query("normalize_date", "SELECT o_orderkey AS batch_id, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def _date(spark, base):
    return raw_dates(spark, base).select("batch_id", N.normalize_date(F.col("raw")).alias("iso"))


@query("normalize_carrier_date", """SELECT o_orderkey AS batch_id, strftime(CASE WHEN o_orderkey % 9 = 8 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS iso FROM orders""")
def _carrier_date(spark, base):
    return raw_dates(spark, base).select("batch_id", N.normalize_carrier_date(F.col("carrier_raw")).alias("iso"))


@query("valid_date", "SELECT o_orderkey AS batch_id, o_orderkey % 11 IN (0, 1, 3, 4) OR (o_orderkey % 11 = 9 AND day(o_orderdate) <= 12) OR (o_orderkey % 11 IN (5, 6) AND month(o_orderdate) = 5) AS ok FROM orders")
def _valid_date(spark, base):
    return raw_dates(spark, base).select("batch_id", V.valid_date(F.col("raw")).alias("ok"))


# --- codes and numbers ------------------------------------------------------------------------------------

SERIAL = "lpad((l_orderkey % 1000000)::VARCHAR, 6, '0')"
CHECK = "((441 + " + " + ".join(f"substr({SERIAL}, {i + 1}, 1)::INT * {2 ** (4 + i)}" for i in range(6)) + ") % 11 % 10)"
CODE8 = "lpad(l_partkey::VARCHAR, 8, '0')"
TAX15 = "lpad((l_orderkey * 7919 + l_partkey)::VARCHAR, 15, '0')"
NIB13 = "lpad((l_orderkey * 104729 + l_partkey)::VARCHAR, 13, '0')"


def _serial() -> Column:
    return F.lpad(F.pmod("l_orderkey", F.lit(1000000)).cast("string"), 6, "0")


def _check_digit(serial: Column) -> Column:
    total = F.lit(441)
    for i in range(6):
        total = total + F.substring(serial, i + 1, 1).cast("int") * F.lit(2 ** (4 + i))
    return F.pmod(F.pmod(total, F.lit(11)), F.lit(10))


def raw_codes(spark, base) -> DataFrame:
    li = lines(spark, base)
    pk, serial = F.col("pk"), _serial()
    tariff = F.lpad(pk.cast("string"), 8, "0")
    tax = F.lpad((F.col("l_orderkey") * 7919 + pk).cast("string"), 15, "0")
    nib = F.lpad((F.col("l_orderkey") * 104729 + pk).cast("string"), 13, "0")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    grouped = F.format_number(money, 2)
    s = F.substring
    return li.select(
        "batch_id", "doc_id", "doc_type", "pk", "l_suppkey", "l_quantity", money.alias("money"), serial.alias("serial"),
        F.concat(F.lit("csqu "), serial, F.lit("-"), _check_digit(serial).cast("string")).alias("container_raw"),
        F.concat(F.lit("CSQU"), serial, F.pmod(pk, F.lit(10)).cast("string")).alias("container_any"),
        pick(
            F.pmod(pk, F.lit(3)),
            F.concat(s(tariff, 1, 4), F.lit("."), s(tariff, 5, 2), F.lit("."), s(tariff, 7, 2)),
            F.concat(tariff, F.lit("00")), s(tariff, 1, 6),
        ).alias("hs_raw"),
        F.concat(tariff, F.lit(", "), s(tariff, 1, 6), F.lit(";"), s(tariff, 1, 4), F.lit(";"), tariff, F.lit("99")).alias("hs_list"),
        F.concat(pick(F.pmod(pk, F.lit(4)), *[F.concat(grouped, F.lit(u)) for u in (" KGS", " KG.", " MT", " LBS")])).alias("weight_raw"),
        F.concat(grouped, pick(F.pmod(pk, F.lit(5)), *[F.lit(u) for u in (" KGS", " KGM", " MTS", " LBS", "")])).alias("unit_raw"),
        pick(F.pmod(pk, F.lit(3)), F.lit(" usd "), F.lit("U.S.D"), F.lit("(USD) 12")).alias("currency_raw"),
        pick(F.pmod(pk, F.lit(3)), F.concat(F.lit("USD "), grouped), F.concat(F.lit("$"), grouped), F.concat(grouped, F.lit(" eur."))).alias("money_raw"),
        F.concat(s(tax, 1, 2), F.lit("."), s(tax, 3, 3), F.lit("."), s(tax, 6, 3), F.lit("."), s(tax, 9, 1), F.lit("-"), s(tax, 10, 3), F.lit("."), s(tax, 13, 3)).alias("npwp_raw"),
        F.concat(s(nib, 1, 4), F.lit(" "), s(nib, 5, 5), F.lit("-"), s(nib, 10, 4)).alias("nib_raw"),
        F.concat(
            pick(F.pmod(pk, F.lit(8)), *[F.lit(x) for x in ("nmv ", "M/V ", "MV  ", "S.S. ", "ss ", "MT ", "M.T. ", "")]),
            F.lit("Ever Given "), F.col("l_suppkey").cast("string"),
        ).alias("vessel_raw"),
        F.concat(F.lit("  idjkt"), F.when(F.pmod(pk, F.lit(4)) == 0, "1").otherwise("")).alias("port_raw"),
    )


HS_TRUTH = f"CASE l_partkey % 3 WHEN 2 THEN left({CODE8}, 6) || '00' ELSE {CODE8} END"
PLAIN2 = "CASE WHEN m LIKE '%.00' THEN left(m, length(m) - 1) WHEN m LIKE '%0' THEN left(m, length(m) - 1) ELSE m END"
MONEY = f"(SELECT {PLAIN2} FROM (SELECT l_extendedprice::DECIMAL(18,2)::VARCHAR AS m))"


@query("normalize_container", oracle(f"SELECT doc_id, 'CSQU' || {SERIAL} || {CHECK}::VARCHAR AS container FROM docs", "docs"))
def _container(spark, base):
    return raw_codes(spark, base).select("doc_id", N.normalize_container(F.col("container_raw")).alias("container"))


@query("valid_container", oracle(f"SELECT doc_id, true AS own, {CHECK} = l_partkey % 10 AS other FROM docs", "docs"))
def _valid_container(spark, base):
    return raw_codes(spark, base).select("doc_id", V.valid_container(F.col("container_raw")).alias("own"), V.valid_container(F.col("container_any")).alias("other"))


@query("normalize_hs", oracle(f"SELECT doc_id, {HS_TRUTH} AS hs_code FROM docs", "docs"))
def _hs(spark, base):
    return raw_codes(spark, base).select("doc_id", N.normalize_hs(F.col("hs_raw")).alias("hs_code"))


@query("split_hs_codes", oracle(f"SELECT doc_id, unnest([{CODE8}, left({CODE8}, 6) || '00', {CODE8}]) AS hs_code FROM docs", "docs"))
def _split(spark, base):
    return raw_codes(spark, base).select("doc_id", F.explode(N.split_hs_codes(F.col("hs_list"))).alias("hs_code"))


@query("valid_hs", oracle("SELECT doc_id, l_partkey % 3 = 0 AS ok FROM docs", "docs"))
def _valid_hs(spark, base):
    return raw_codes(spark, base).select("doc_id", V.valid_hs(F.col("hs_raw")).alias("ok"))


@query("normalize_weight", oracle(f"SELECT doc_id, {MONEY} AS weight FROM docs", "docs"))
def _weight(spark, base):
    return raw_codes(spark, base).select("doc_id", N.normalize_weight(F.col("weight_raw")).alias("weight"))


@query("weight_to_kg", oracle("""SELECT doc_id, round((l_extendedprice * CASE l_partkey % 5 WHEN 2 THEN 1000.0 WHEN 3 THEN 0.453592 ELSE 1.0 END)::DECIMAL(30,8), 3)::DOUBLE AS kg FROM docs""", "docs"))
def _kg(spark, base):
    return raw_codes(spark, base).select("doc_id", N.weight_to_kg(F.col("unit_raw")).alias("kg"))


@query("normalize_currency", oracle("SELECT doc_id, 'USD' AS currency, true AS ok FROM docs", "docs"))
def _currency(spark, base):
    df = raw_codes(spark, base).select("doc_id", N.normalize_currency(F.col("currency_raw")).alias("currency"))
    return df.withColumn("ok", V.valid_currency(F.col("currency")))


@query("valid_currency", oracle("SELECT doc_id, l_partkey % 3 = 0 AS ok FROM docs", "docs"))
def _valid_currency(spark, base):
    return raw_codes(spark, base).select("doc_id", V.valid_currency(F.col("currency_raw")).alias("ok"))


@query("normalize_money", oracle(f"SELECT doc_id, {MONEY} AS money FROM docs", "docs"))
def _money(spark, base):
    return raw_codes(spark, base).select("doc_id", N.normalize_money(F.col("money_raw")).alias("money"))


@query("normalize_tax_ids", oracle(f"SELECT doc_id, {TAX15} AS npwp, {NIB13} AS nib FROM docs", "docs"))
def _tax(spark, base):
    return raw_codes(spark, base).select("doc_id", N.normalize_npwp(F.col("npwp_raw")).alias("npwp"), N.normalize_nib(F.col("nib_raw")).alias("nib"))


@query("valid_npwp", oracle("SELECT doc_id, true AS raw_ok, false AS short_ok, true AS long_ok, false AS long_strict FROM docs", "docs"))
def _valid_npwp(spark, base):
    c = F.col("npwp_raw")
    longer = F.concat(c, F.lit("7"))
    return raw_codes(spark, base).select(
        "doc_id", V.valid_npwp(c).alias("raw_ok"), V.valid_npwp(F.substring(c, 1, 18)).alias("short_ok"),
        V.valid_npwp(longer, (15, 16)).alias("long_ok"), V.valid_npwp(longer).alias("long_strict"),
    )


@query("valid_nib", oracle("SELECT doc_id, true AS ok, false AS raw_ok FROM docs", "docs"))
def _valid_nib(spark, base):
    return raw_codes(spark, base).select("doc_id", V.valid_nib(N.normalize_nib(F.col("nib_raw"))).alias("ok"), V.valid_nib(F.col("nib_raw")).alias("raw_ok"))


@query("known_unlocode", oracle("SELECT doc_id, (l_partkey % 8) IN (0, 1, 4) AS known, (l_partkey % 8) IN (0, 1, 2, 4) AS well_formed, (l_partkey % 8) IN (1, 2, 6) AS inside FROM docs", "docs"))
def _known_locode(spark, base):
    """Codes as printed: padded, in lower case, unknown, broken, too long, inside a text, missing."""
    c = pick(F.pmod("pk", F.lit(8)), *map(F.lit, (" idjkt", "DEHAM ", "XXABC", "ID JKT", "usnyc", "IDJKT1", "MV at SGSIN", None))).cast("string")
    return lines(spark, base).select("doc_id", V.known_unlocode(c).alias("known"), V.valid_unlocode(c).alias("well_formed"), V.contains_locode(c).alias("inside"))


@query("valid_unlocode", oracle("SELECT doc_id, l_partkey % 4 <> 0 AS ok FROM docs", "docs"))
def _valid_port(spark, base):
    return raw_codes(spark, base).select("doc_id", V.valid_unlocode(F.col("port_raw")).alias("ok"))


@query("normalize_vessel", oracle("SELECT doc_id, 'EVER GIVEN ' || l_suppkey::VARCHAR AS vessel FROM docs", "docs"))
def _vessel(spark, base):
    return raw_codes(spark, base).select("doc_id", N.normalize_vessel(F.col("vessel_raw")).alias("vessel"))


LONG_FIELDS = {
    "container_number": "container_raw", "hs_code": "hs_raw", "gross_weight": "weight_raw", "currency": "currency_raw",
    "cif_value": "money_raw", "npwp": "npwp_raw", "nib": "nib_raw", "vessel_name": "vessel_raw", "port_loading_code": "port_raw",
}


def long_fields(spark, base) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("raw")) for f, c in LONG_FIELDS.items()])
    return spread(raw_codes(spark, base), "doc_id").select("batch_id", "doc_id", F.inline(cells))


_LONG_TRUTH = oracle(f"""SELECT doc_id, unnest(['container_number','hs_code','gross_weight','currency','cif_value','npwp','nib','vessel_name','port_loading_code']) AS field,
    unnest(['CSQU' || {SERIAL} || {CHECK}::VARCHAR, {HS_TRUTH}, {MONEY}, 'USD', {MONEY}, {TAX15}, {NIB13}, 'EVER GIVEN ' || l_suppkey::VARCHAR,
            'IDJKT' || CASE WHEN l_partkey % 4 = 0 THEN '1' ELSE '' END]) AS value FROM docs""", "docs")


@query("normalize_field", _LONG_TRUTH)
def _field(spark, base):
    return long_fields(spark, base).select("doc_id", "field", N.normalize_field(F.col("field"), F.col("raw")).alias("value"))


@query("field_format_valid", oracle("""SELECT doc_id, unnest(['importer_npwp','importer_nib','hs_code','currency','gross_weight','total_packages','bl_number']) AS field,
    unnest([true, true, l_partkey % 3 <> 2 AND l_partkey % 3 <> 0 AND false, false, false, l_quantity >= 1, true]) AS ok FROM docs""", "docs"))
def _format(spark, base):
    raw = raw_codes(spark, base)
    cells = {
        "importer_npwp": F.col("npwp_raw"), "importer_nib": F.col("nib_raw"), "hs_code": F.col("hs_raw"), "currency": F.lower("currency_raw"),
        "gross_weight": F.col("weight_raw"), "total_packages": F.col("l_quantity").cast("string"), "bl_number": F.col("doc_id"),
    }
    long = raw.select("doc_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in cells.items()])))
    return long.select("doc_id", "field", V.field_format_valid(F.col("field"), F.col("value")).alias("ok"))


@query("compare_normalize", oracle("""SELECT doc_id, engine, field,
    CASE WHEN field = 'gross_weight' THEN rtrim(rtrim(replace(replace(value, ',', ''), ' KGS', ''), '0'), '.') WHEN field = 'total_packages' THEN value ELSE lower(value) END AS form,
    coalesce(try_cast(value AS DECIMAL(30,4))::VARCHAR, upper(value)) AS across,
    regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS bare FROM b2""", "b2"))
def _compare(spark, base):
    f, v = F.col("field"), F.col("value")
    return B.observations(spark, base).select(
        "doc_id", "engine", "field", N.compare_form(f, v).alias("form"), N.cross_document_form(v).alias("across"), N.folded(v).alias("bare")
    )


@query("safe_numbers", oracle("""SELECT doc_id, l_extendedprice AS amount, l_extendedprice::DECIMAL(18,2)::DOUBLE AS grouped, floor(l_extendedprice)::BIGINT AS whole,
    l_extendedprice AS european, l_quantity AS packages, NULL::DOUBLE AS junk FROM docs""", "docs"))
def _numbers(spark, base):
    raw = raw_codes(spark, base)
    grouped = F.format_number("money", 2)
    european = F.translate(grouped, ".,", ",.")
    return raw.select(
        "doc_id", N.safe_float(F.col("money").cast("string")).alias("amount"), N.safe_float(grouped).alias("grouped"), N.safe_int(grouped).alias("whole"),
        F.when(F.col("money") >= 1000, N.locale_float(european)).otherwise(F.col("money").cast("double")).alias("european"),
        N.typed_number(F.lit("total_packages"), F.col("l_quantity").cast("string")).alias("packages"), N.safe_float(F.col("vessel_raw")).alias("junk"),
    )


@query("extract_aju", oracle("SELECT doc_id, lpad((l_orderkey * 1000 + l_linenumber)::VARCHAR, 18, '2') AS aju FROM docs", "docs"))
def _aju(spark, base):
    number = F.lpad((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("string"), 18, "2")
    even = F.pmod("l_partkey", F.lit(2)) == 0
    return lines(spark, base).select(
        "doc_id",
        X.aju_number(F.when(even, number), F.lit("received"), F.concat(F.lit("ref AJU/"), number, F.lit(" ok"))).alias("aju"),
    )


@query("classify_error", oracle("""SELECT event_id, CASE WHEN k % 7 = 0 THEN 'AUTO_RECOVERABLE' WHEN k % 40 IN (7, 19, 23) THEN 'AUTO_RECOVERABLE' WHEN k % 40 IN (1, 4, 15, 31) THEN 'OPERATOR_REQUIRED' ELSE 'ADMIN_ESCALATION' END AS spec,
    CASE WHEN k % 7 = 0 OR k % 40 IN (1, 2, 3, 4, 5, 10) THEN 'AUTO_RECOVERABLE' ELSE 'ADMIN_ESCALATION' END AS service FROM b4""", "b4"))
def _errors(spark, base):
    code = F.when(F.pmod("k", F.lit(7)) != 0, F.concat(F.lit("E"), F.lpad(F.pmod("k", F.lit(40)).cast("string"), 3, "0")))
    return B.events(spark, base).select("event_id", V.error_class(code).alias("spec"), V.error_class(code, "service").alias("service"))


# --- text ---------------------------------------------------------------------------------------------------

def text_blocks(spark, base) -> DataFrame:
    raw = raw_codes(spark, base)
    grouped = F.format_number("money", 2)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Consignee: PT IMPORT "), F.col("l_suppkey").cast("string")),
        F.concat(F.lit("NPWP: "), F.col("npwp_raw")),
        F.concat(F.lit("Total Packages: "), F.col("l_quantity").cast("int").cast("string"), F.lit(" CTN")),
        F.concat(F.lit("Gross Weight: "), grouped, F.lit(" KGS")),
        F.concat(F.lit("Currency: USD")),
        F.concat(F.lit("CIF: USD "), grouped),
    )
    return raw.select("doc_id", "pk", "money", block.alias("text"))


_GROUPED_VALUE = "CASE WHEN l_extendedprice >= 1000 THEN l_extendedprice ELSE round(l_extendedprice * 100) END"
_TAXRAW = f"(SELECT substr(t,1,2)||'.'||substr(t,3,3)||'.'||substr(t,6,3)||'.'||substr(t,9,1)||'-'||substr(t,10,3)||'.'||substr(t,13,3) FROM (SELECT {TAX15} AS t))"


@query("extract_fields", oracle(f"""SELECT doc_id, {_TAXRAW} AS importer_npwp, l_quantity::BIGINT AS total_packages, {_GROUPED_VALUE} AS gross_weight, {_GROUPED_VALUE} AS cif_value,
    'USD' AS currency, 'PT IMPORT ' || l_suppkey::VARCHAR AS importer_name FROM docs""", "docs"))
def _extract(spark, base):
    blocks = text_blocks(spark, base)
    return blocks.select("doc_id", *[c.alias(f) for f, c in X.general_fields(F.col("text")).items()])


@query("rule_based_candidates", oracle(f"""SELECT doc_id, 'rule_based' AS engine, field, value, 0.68::DOUBLE AS confidence FROM (SELECT doc_id,
    unnest(['importer_npwp','total_packages','gross_weight','cif_value']) AS field, unnest([{_TAXRAW}, l_quantity::BIGINT::VARCHAR, l_extendedprice::VARCHAR, l_extendedprice::VARCHAR]) AS value FROM docs)""", "docs"))
def _candidates(spark, base):
    return X.as_observations(text_blocks(spark, base), ["doc_id"], X.fallback_fields(F.col("text")), "rule_based", X.FALLBACK_CONFIDENCE)


def typed_blocks(spark, base) -> DataFrame:
    raw = raw_codes(spark, base)
    money, packages = F.format_number("money", 2), F.col("l_quantity").cast("int").cast("string")
    bl = F.concat(
        F.lit("Shipper ACME EXPORT B/L No. HLCU"), F.col("serial"), F.lit("\nConsignee PT MAJU Vessel CAP "), F.col("l_suppkey").cast("string"),
        F.lit("\nVoyage No. V"), F.col("pk").cast("string"), F.lit("\nPort of Loading SHEKOU Port of Discharge JAKARTA\nPlace of Delivery\nIncoterm CIF\nHS CODE 12 ref 99 "),
        F.lpad(F.col("pk").cast("string"), 8, "0"), F.lit("\nTOTAL: "), packages, F.lit(" CTNS gross "), money, F.lit(" KGS\n"),
    )
    pl = F.concat(
        F.lit("Date 05-MAR-2024\nCSQU1234567 then csqu7654321 and CSQU1234567\nTOTAL (all) "), packages, F.lit(" CARTONS net "), money, F.lit(" "), money, F.lit(" 1.5"),
    )
    inv = F.concat(
        F.lit("Invoice Date 07-APR-2024\nImporter NIB "), F.lpad(F.col("pk").cast("string"), 13, "1"), F.lit("\nCurrency USD\nFOB Value USD "), money,
        F.lit("\nFreight USD 10.00\nInsurance USD 2.50\nCIF Value USD "), money, F.lit("\n"),
    )
    kind = F.col("doc_type")
    return raw.select("doc_id", "doc_type", F.when(kind == "bill_of_lading", bl).when(kind == "packing_list", pl).otherwise(inv).alias("text"))


@query("extract_by_doc_type", oracle(f"""SELECT doc_id, doc_type, CASE doc_type WHEN 'bill_of_lading' THEN 'CAP ' || l_suppkey::VARCHAR END AS vessel_name,
    CASE doc_type WHEN 'bill_of_lading' THEN 'HLCU' || {SERIAL} END AS bl_number, CASE doc_type WHEN 'bill_of_lading' THEN 'V' || l_partkey::VARCHAR END AS voyage_number,
    CASE doc_type WHEN 'bill_of_lading' THEN 'ACME EXPORT' END AS exporter_name, CASE doc_type WHEN 'bill_of_lading' THEN 'PT MAJU' END AS importer_name,
    CASE doc_type WHEN 'bill_of_lading' THEN 'SHEKOU' END AS port_of_loading, CASE doc_type WHEN 'bill_of_lading' THEN 'JAKARTA' END AS port_of_discharge,
    CASE doc_type WHEN 'bill_of_lading' THEN {CODE8} END AS hs_code, CASE doc_type WHEN 'packing_list' THEN 'CSQU1234567, CSQU7654321' END AS container_numbers,
    CASE WHEN doc_type <> 'invoice' THEN l_quantity::BIGINT::VARCHAR END AS total_packages, CASE WHEN doc_type <> 'invoice' THEN l_extendedprice END AS gross_weight,
    CASE doc_type WHEN 'packing_list' THEN '05-MAR-2024' WHEN 'invoice' THEN '07-APR-2024' END AS bl_date, CASE doc_type WHEN 'invoice' THEN lpad(l_partkey::VARCHAR, 13, '1') END AS importer_nib,
    CASE doc_type WHEN 'invoice' THEN 'USD' END AS currency, CASE doc_type WHEN 'invoice' THEN l_extendedprice END AS fob_value, CASE doc_type WHEN 'invoice' THEN l_extendedprice END AS cif_value,
    CASE doc_type WHEN 'invoice' THEN 2.5::DOUBLE END AS insurance_value FROM docs""", "docs"))
def _by_type(spark, base):
    fields = X.document_fields(F.col("text"), F.col("doc_type"))
    text = ["vessel_name", "bl_number", "voyage_number", "exporter_name", "importer_name", "port_of_loading", "port_of_discharge", "hs_code", "container_numbers", "total_packages", "bl_date", "importer_nib", "currency"]
    numbers = ["gross_weight", "fob_value", "cif_value", "insurance_value"]
    return typed_blocks(spark, base).select("doc_id", "doc_type", *[fields[f].alias(f) for f in text], *[fields[f].cast("double").alias(f) for f in numbers])


@query("find_hs_near_label", oracle(f"SELECT doc_id, {CODE8} AS hs_code FROM docs WHERE doc_type = 'bill_of_lading'", "docs"))
def _near(spark, base):
    return typed_blocks(spark, base).select("doc_id", X.hs_near_label(F.col("text")).alias("hs_code")).where("hs_code is not null")


@query("container_list", oracle("SELECT doc_id, unnest(['CSQU1234567', 'CSQU7654321']) AS container, unnest([1, 2]) AS place FROM docs WHERE doc_type = 'packing_list'", "docs"))
def _container_list(spark, base):
    found = typed_blocks(spark, base).select("doc_id", F.posexplode(X.container_list(F.col("text"))).alias("pos", "container"))
    return found.select("doc_id", "container", (F.col("pos") + 1).alias("place"))


@query("json_from_text", oracle("""SELECT doc_id, CASE WHEN l_partkey % 4 < 3 THEN l_quantity::BIGINT::VARCHAR END AS packages, CASE WHEN l_partkey % 4 < 3 THEN l_suppkey::VARCHAR END AS supplier FROM docs""", "docs"))
def _json(spark, base):
    obj = F.to_json(F.struct(F.col("l_quantity").cast("bigint").alias("packages"), F.col("l_suppkey").alias("supplier")))
    text = pick(
        F.pmod("l_partkey", F.lit(4)),
        F.concat(F.lit("<think>try {\n}</think>"), obj),
        F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\nDone")),
        F.concat(F.lit("result "), obj, F.lit(" end")),
        F.concat(F.lit("broken {"), F.col("doc_id"), F.lit(": ")),
    )
    parsed = X.json_from_text(F.col("text"))
    return lines(spark, base).select("doc_id", text.alias("text")).select(
        "doc_id", F.try_element_at(parsed, F.lit("packages")).alias("packages"), F.try_element_at(parsed, F.lit("supplier")).alias("supplier")
    )


@query("infer_doc_type", oracle("""SELECT doc_id, CASE l_partkey % 4 WHEN 0 THEN 'bill_of_lading' WHEN 1 THEN 'packing_list' WHEN 2 THEN 'bill_of_lading' ELSE 'invoice' END AS kind FROM docs""", "docs"))
def _kind(spark, base):
    name = F.concat(pick(F.pmod("l_partkey", F.lit(4)), F.lit("BL_"), F.lit("Packing-"), F.lit("konosemen "), F.lit("INV")), F.col("doc_id"), F.lit(".pdf"))
    return lines(spark, base).select("doc_id", X.infer_doc_type(name).alias("kind"))


_PAYLOAD = """SELECT doc_id, 'agent_' || CASE l_partkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'b' ELSE 'a' END AS engine,
    CASE l_partkey % 3 WHEN 2 THEN 'bl_number' ELSE 'gross_weight' END AS field,
    CASE l_partkey % 3 WHEN 2 THEN 'HLCU' || l_suppkey::VARCHAR ELSE l_quantity::BIGINT::VARCHAR END AS value,
    (CASE l_partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.7 END)::DOUBLE AS confidence FROM docs"""


@query("engine_output", oracle(_PAYLOAD, "docs"))
def _payload(spark, base):
    from quayside.sources.payloads import payload_observations

    value = F.col("l_quantity").cast("bigint").cast("string")
    payload = pick(
        F.pmod("l_partkey", F.lit(3)),
        F.concat(F.lit('{"fields":{"gross_weight":{"value":"'), value, F.lit('","confidence":0.9}}}')),
        F.concat(F.lit('{"regions":[],"table_cells":[{"key":"Gross Weight","value":"'), value, F.lit('"},{"key":"","value":"x"}]}')),
        F.concat(F.lit('{"text_blocks":["SHIPPER ACME","B/L: HLCU'), F.col("l_suppkey").cast("string"), F.lit('"]}')),
    )
    engine = pick(F.pmod("l_partkey", F.lit(3)), F.lit("agent_d"), F.lit("agent_b"), F.lit("agent_a"))
    return payload_observations(lines(spark, base).select("doc_id", engine.alias("engine"), payload.alias("payload")), ["doc_id", "engine"])


@query("text_evidence", oracle("""SELECT doc_id, strpos(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(word), '[^a-z0-9]+', '', 'g')) > 0 AND regexp_replace(lower(word), '[^a-z0-9]+', '', 'g') <> '' AS word_found,
    strpos(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), n_chars::VARCHAR) > 0 AS count_found FROM (SELECT *, substr(text, 11, 12) AS word FROM b5)""", "b5"))
def _evidence(spark, base):
    docs = B.text_documents(spark, base)
    return docs.select(
        "doc_id", X.text_evidence(F.lit("importer_name"), F.substring("text", 11, 12), F.col("text")).alias("word_found"),
        X.text_evidence(F.lit("gross_weight"), F.concat(F.col("n_chars").cast("string"), F.lit(" KGS")), F.col("text")).alias("count_found"),
    )


_CONF = """SELECT doc_id, engine, field, round(greatest(0.35, least(0.99, greatest(CASE WHEN digital THEN 0.88 ELSE 0.82 END, least(0.96, confidence * 0.94)) + CASE WHEN evidence THEN 0.05 ELSE -0.12 END
    + CASE WHEN ok THEN 0.0 ELSE -0.25 END))::DECIMAL(18,8), 4)::DOUBLE AS confidence
    FROM (SELECT doc_id, engine, field, confidence::DOUBLE AS confidence, doc_type = 'invoice' AS digital, engine_rank % 2 = 1 AS evidence,
      CASE field WHEN 'hs_code' THEN length(value) = 8 WHEN 'gross_weight' THEN value NOT LIKE '%KGS' ELSE true END AND value IS NOT NULL AS ok FROM b2)"""


@query("field_confidence", oracle(_CONF, "b2"))
def _confidence(spark, base):
    obs = B.observations(spark, base)
    return obs.select(
        "doc_id", "engine", "field",
        X.estimate_confidence(F.col("field"), F.col("value"), F.pmod("engine_rank", F.lit(2)) == 1, F.col("doc_type") == "invoice", F.col("confidence")).alias("confidence"),
    )


@query("recompute_confidences", oracle(f"""SELECT doc_id, count(*) AS fields, round((sum(confidence::DECIMAL(18,6))::DOUBLE / count(*))::DECIMAL(18,8), 4)::DOUBLE AS avg_confidence FROM ({_CONF}) GROUP BY 1""", "b2"))
def _recompute(spark, base):
    from quayside.operators.jobs import document_means

    return document_means(_confidence(spark, base))


@query("text_stats", oracle("""SELECT doc_id, length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) AS chars, page_count, round((length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) / page_count::DOUBLE)::DECIMAL(18,8), 2)::DOUBLE AS per_page,
    CASE WHEN length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) / page_count::DOUBLE >= 79.995 THEN 1.0::DOUBLE ELSE 0.0 END AS confidence FROM b5""", "b5"))
def _stats(spark, base):
    docs = B.text_documents(spark, base).withColumn("chars", X.text_chars(F.col("text")))
    return docs.select(
        "doc_id", "chars", "page_count", rnd(F.col("chars") / F.col("page_count"), 2).alias("per_page"),
        X.layer_confidence(F.col("chars"), F.col("page_count")).alias("confidence"),
    )


@query("alias_coalesce", oracle("""SELECT batch_id, doc_id, CASE engine_rank WHEN 4 THEN 'importer_name' ELSE field END AS field, arg_min(value, engine_rank) AS value
    FROM b2 WHERE value IS NOT NULL AND field = 'gross_weight' GROUP BY 1, 2, 3""", "b2"))
def _alias(spark, base):
    from quayside.operators.aliases import canonical_fields

    named = (
        B.observations(spark, base).where("field = 'gross_weight' and value is not null")
        .withColumn("field", pick(F.col("engine_rank") - 1, F.lit("gross_weight"), F.lit("beratKotor"), F.lit("beratKotor"), F.lit("namaEntitas")))
    )
    return canonical_fields(named, ["batch_id", "doc_id"], F.col("engine_rank"))


@query("hash_anonymise", oracle("SELECT batch_id, sha256(importer) AS digest, left(sha256(importer), 16) AS pseudonym FROM b1", "b1"))
def _hash(spark, base):
    from quayside.functions.hashing import digest, pseudonym

    return B.batches(spark, base).select("batch_id", digest(F.col("importer")).alias("digest"), pseudonym(F.col("importer")).alias("pseudonym"))


