"""Column builders on hand-written values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.functions import extract as X
from quayside.functions import normalize as N
from quayside.functions import validate as V
from quayside.functions.common import rnd
from quayside.functions.similarity import anls, indel_ratios, lcs
from quayside.operators import maritime as M


def apply(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


CASES = [
    (N.normalize_date, [("2024-03-05T10:00", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("3-6-2024", "2024-06-03"), ("12/25/2024", "2024-12-25"), ("7 MAR 2013", "2013-03-07"),
                        ("March 7, 2013", "2013-03-07"), ("20240229", "2024-02-29"), ("31/12/98", "1998-12-31"), ("1/1/05", "2005-01-01"), ("soon", "soon"), (None, None)]),
    (N.normalize_carrier_date, [("27/FEB/2013", "2013-02-27"), ("FEB-20-2012", "2012-02-20"), ("14/09/2016", "2016-09-14"), ("03-06-2024", "2024-06-03"), ("APR.15,2015", "2015-04-15"),
                                ("18.09.2021", "2021-09-18"), ("29-mar-2023", "2023-03-29"), ("FEB-XX-2012", "2012-02-01"), ("nothing", None), ("31/FEB/2013", None)]),
    (N.normalize_container, [("csqu 305438-3", "CSQU3054383"), ("no CSQU3054383 here", "CSQU3054383"), ("abc", "ABC")]),
    (N.normalize_hs, [("8482.10.00", "84821000"), ("848210", "84821000"), ("8482100099", "84821000"), ("8482", "8482")]),
    (N.normalize_weight, [("1,234.5 KGS", "1234.5"), ("128,500 kg", "128500.0"), ("25 MT", "25.0"), ("0.1239", "0.124"), ("heavy", "heavy")]),
    (N.weight_to_kg, [("1,234.5 KGS", 1234.5), ("2 MTS", 2000.0), ("3T", 3000.0), ("10 LBS", 4.536), ("77", 77.0), ("n/a", None)]),
    (N.normalize_money, [("USD 12,345.60", "12345.6"), ("€7", "7.0"), ("free", "free")]),
    (N.normalize_vessel, [("m/v nmv Rio", "NMV RIO"), ("NMV  MAERSK", "MAERSK"), ("S.S. ANNE", "ANNE")]),
    (N.locale_float, [("11,603.000", 11603.0), ("11.603,00", 11603.0), ("11.603,000", 11.603), ("1,234", 1234.0), ("5,5", 5.5), ("x", None)]),
    (N.safe_int, [("1,234.9", 1234), ("x", None)]),
    # readings that are no figures of a declaration must not end a job
    (N.normalize_weight, [("1E25", "1E25"), ("5d", "5d"), ("12f", "12f"), ("1E400", "1E400")]),
    (N.normalize_money, [("1E25", "1E25"), ("5d", "5d")]),
    (N.weight_to_kg, [("1E25", None), ("99999999999999999999999999 KG", 1e26)]),
    (N.safe_float, [("1E25", 1e25), ("5d", None), ("20,000,000,000.005", 20000000000.01), ("1E40", 1e40)]),
    (N.cross_document_form, [("1E25", "1E25"), ("2.50", "2.5000"), ("5d", "5D")]),
    (V.valid_container, [("CSQU3054383", True), ("CPSU1311627", True), ("TGCU2288744", True), ("CSQU3054384", False), ("CSQ3054383", False), (None, False)]),
    (V.valid_date, [("2024-02-30", False), ("30/01/2024", True), ("1 March 2024", True), ("2024/01/01", False)]),
    (X.hs_near_label, [("pay 12345678", None), ("HS Code: x 84807900", "84807900"), ("hs code 848079", "848079")]),
    (M.resolve_port, [("Hamburg", "DEHAM"), ("port of mundra", "INMUN"), ("TILB", "GBTIL"), ("Nowhere", None)]),
]


@pytest.mark.parametrize("build,pairs", CASES, ids=[c[0].__name__ for c in CASES])
def test_values(spark, build, pairs):
    assert apply(spark, build, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_rounding_of_large_figures(spark):
    assert apply(spark, lambda c: rnd(c, 2), [2e10, 1.005, 1e40, None], "double") == [2e10, 1.01, 1e40, None]


def test_check_digit_ten_counts_as_zero(spark):
    # search a serial whose remainder is ten
    values = {c: 10 + k + (k + 9) // 10 for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    head = sum(values[c] * 2**i for i, c in enumerate("CSQU"))
    serial = next(s for s in (f"{n:06d}" for n in range(1000)) if (head + sum(int(d) * 2 ** (4 + i) for i, d in enumerate(s))) % 11 == 10)
    assert apply(spark, V.valid_container, [f"CSQU{serial}0"]) == [True]


def test_split_hs_codes(spark):
    assert apply(spark, N.split_hs_codes, ["84821000, 7219.35;12", "x", None]) == [["84821000", "72193500"], [], []]


def test_unmatched_fields_default(spark):
    df = spark.createDataFrame([("seal", " ab "), ("seal", "  "), ("hs_code", "8482.10")], "f string, v string")
    assert [r[0] for r in df.select(N.normalize_field(F.col("f"), F.col("v"))).collect()] == ["AB", None, "84821000"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@given(st.text("abcé ", max_size=90), st.text("abcé ", max_size=90))
def test_lcs_against_table(a, b):
    assert lcs(a, b) == _lcs(a, b)


def test_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting", ["1,000.0", "x"], "1000"), ("", "", ["abcdef"], "none")], "a string, b string, gt array<string>, pred string")
    rows = df.select(F.round(indel_ratios(F.array("a"), F.col("b"))[0], 4), anls(F.col("gt"), F.col("pred")), anls(F.col("gt"), F.col("pred"), metric="indel")).collect()
    assert [tuple(r) for r in rows] == [(0.6154, 1.0, 1.0), (1.0, 0.0, 0.0)]


def test_general_text_block(spark):
    text = "Importer: PT CONTOH ABADI\nTax ID: 01.222.333.4-555.000\nJumlah koli: 42\nGross wt 1,250.500 KGS\nCurrency: usd\nTotal amount EUR 9,999.00"
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in X.general_fields(F.col("t")).items()]).first().asDict()
    assert got == {"importer_npwp": "01.222.333.4-555.000", "total_packages": 42, "gross_weight": 1250.5, "cif_value": 9999.0, "currency": "USD", "importer_name": "PT CONTOH ABADI"}
