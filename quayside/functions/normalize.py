"""Canonical forms of raw readings, so that equal values compare equal."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import as_double, digits, ends_in_digit, once, plain_number, rnd

Normalizer = Callable[[Column], Column]


def _parsed(c: Column, layout: str) -> Column:
    stamp = F.try_to_timestamp(c, F.lit(layout))
    if layout.endswith("/yy"):
        # two-digit years 69..99 belong to the last century
        stamp = F.when(F.year(stamp) >= 2069, F.add_months(stamp, -1200).cast("timestamp")).otherwise(stamp)
    return F.date_format(stamp, "yyyy-MM-dd")


def normalize_date(c: Column, layouts: Sequence[str] = tuple(K.DATE_LAYOUTS)) -> Column:
    """ISO day; an ISO start is kept, then the layouts in order, else the trimmed text."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10))).otherwise(
        F.coalesce(*[_parsed(text, layout) for layout in layouts], text)
    )


def normalize_carrier_date(c: Column) -> Column:
    """ISO day from a carrier print; a blacked-out day becomes the first, unreadable text null."""
    text = F.regexp_replace(F.upper(F.trim(c)), r"([-/])XX([-/])", "$101$2")
    return F.coalesce(
        *[
            F.date_format(F.try_to_timestamp(F.nullif(F.regexp_extract(text, shape, 0), F.lit("")), F.lit(layout)), "yyyy-MM-dd")
            for shape, layout in K.CARRIER_DATE_LAYOUTS
        ]
    )


def normalize_container(c: Column) -> Column:
    bare = F.regexp_replace(F.upper(c), r"[\s\-./]", "")
    found = F.regexp_extract(bare, r"[A-Z]{4}\d{7}", 0)
    return F.when(found != "", found).otherwise(bare)


def normalize_hs(c: Column) -> Column:
    whole = lambda bare: F.when(F.length(bare) == 6, F.concat(bare, F.lit("00"))).otherwise(F.left(bare, F.lit(8)))
    return once(F.regexp_replace(c, r"[.\s\-]", ""), whole)


def split_hs_codes(c: Column) -> Column:
    """All 8-digit codes in a comma or semicolon list, as an array."""
    parts = F.transform(F.split(c, "[,;]"), digits)
    full = F.transform(
        parts,
        lambda p: F.when(F.length(p) >= 8, F.left(p, F.lit(8))).when(F.length(p) == 6, F.concat(p, F.lit("00"))),
    )
    return F.coalesce(F.array_compact(full), F.array().cast("array<string>"))


def normalize_weight(c: Column) -> Column:
    """Bare figure with up to three decimals; the unit is dropped, not converted."""
    figure = once(F.regexp_replace(c, r"[,\s]", ""), lambda b: F.when(ends_in_digit(b), b).otherwise(F.regexp_replace(b, r"(?i)(KGS?|MT|LBS?|G|TON)\.?$", "")))
    return F.coalesce(plain_number(once(figure, as_double), 3), F.trim(c))


def weight_to_kg(c: Column) -> Column:
    """Weight in kilograms by unit; a bare figure is taken as kilograms."""
    text = F.upper(F.regexp_replace(F.trim(c), r",(?=\d{3})", ""))
    figure = F.regexp_extract(text, r"^([\d.]+)\s*([A-Z]*)", 1)
    unit = F.regexp_extract(text, r"^([\d.]+)\s*([A-Z]*)", 2)
    table = F.create_map(*[F.lit(x) for pair in K.KILOGRAMS_PER_UNIT.items() for x in pair])
    per_unit = F.coalesce(F.try_element_at(table, unit), F.try_element_at(table, F.regexp_replace(unit, "S+$", "")))
    scaled = F.round((as_double(figure) * per_unit).try_cast("decimal(30,8)"), 3).cast("double")
    # a figure with an exponent is no weight: without its letters it would read as another number
    return F.coalesce(scaled, F.when(~text.rlike(r"^[\d.]+E[+-]?\d"), as_double(F.regexp_replace(text, r"[^\d.]", ""))))


def normalize_currency(c: Column) -> Column:
    return F.left(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(3))


def normalize_money(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"[,$€£¥₹\s]", ""), r"(?i)(USD|EUR|GBP|IDR|CNY|SGD)\.?", "")
    return F.coalesce(plain_number(once(bare, as_double), 2), F.trim(c))


def normalize_npwp(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[.\-\s]", "")
    return F.when(bare.rlike(r"^\d{15}$"), bare).otherwise(F.trim(c))


def normalize_nib(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[\s\-]", "")
    return F.when(bare.rlike(r"^\d{13}$"), bare).otherwise(F.trim(c))


def normalize_vessel(c: Column) -> Column:
    """Upper case without ship prefixes; each known prefix is dropped once, in the order of the list. Only names that start like a prefix are searched."""
    prefixes = "".join(f"(?:{p})?" for p in K.VESSEL_PREFIXES)
    heads = [p.removesuffix(r"\s+").replace("\\", "") for p in K.VESSEL_PREFIXES]

    def bare(name: Column) -> Column:
        prefixed = functools.reduce(operator.or_, [F.startswith(name, F.lit(h)) for h in heads])
        return F.when(prefixed, F.trim(F.regexp_replace(name, f"^{prefixes}", ""))).otherwise(name)

    return once(F.upper(F.trim(c)), bare)


def normalize_vessel_for_carrier(c: Column, prefixes: Column, suffixes: Column) -> Column:
    """Carrier form: drop the carrier's own prefixes and suffixes (array columns of the carrier dimension)."""
    name = F.upper(F.trim(c))
    name = F.aggregate(
        F.coalesce(prefixes, F.array().cast("array<string>")), name,
        lambda acc, p: F.when(F.startswith(acc, p), F.substr(acc, F.length(p) + 1)).otherwise(acc),
    )
    return F.trim(
        F.aggregate(
            F.coalesce(suffixes, F.array().cast("array<string>")), name,
            lambda acc, s: F.when(F.endswith(acc, s), F.left(acc, F.length(acc) - F.length(s))).otherwise(acc),
        )
    )


def normalize_text(c: Column) -> Column:
    return F.upper(F.trim(c))


# field family -> normaliser; extend with register_normalizer
_FAMILIES: list[tuple[list[str], Normalizer]] = [
    (list(K.DATE_FIELDS), normalize_date),
    (list(K.CONTAINER_FIELDS), normalize_container),
    (list(K.HS_FIELDS), normalize_hs),
    (list(K.WEIGHT_FIELDS), normalize_weight),
    (list(K.CURRENCY_FIELDS), normalize_currency),
    (list(K.MONEY_FIELDS), normalize_money),
    (list(K.NPWP_FIELDS), normalize_npwp),
    (list(K.NIB_FIELDS), normalize_nib),
    (list(K.VESSEL_FIELDS), normalize_vessel),
]


def register_normalizer(fields: Sequence[str], fn: Normalizer) -> None:
    """Serve extra fields with an own normaliser; later registrations win."""
    _FAMILIES.insert(0, (list(fields), fn))


def normalize_field(field: Column, value: Column) -> Column:
    """Normal form of ``value`` by the field's family, in one pass over the long table; blank becomes null."""
    text = F.trim(value)
    chain = None
    for fields, fn in _FAMILIES:
        test = field.isin(fields)
        chain = F.when(test, fn(text)) if chain is None else chain.when(test, fn(text))
    return F.when(text != "", chain.otherwise(normalize_text(text)))


# --- forms used only for comparing -----------------------------------------------------------------

def compare_form(field: Column, value: Column, numeric=("total_packages", "gross_weight", "cif_value")) -> Column:
    """Comparison key of the service variant: number without trailing zeros, tax digits, or folded text."""
    text = F.trim(value)
    bare = F.regexp_replace(text, r"[^0-9.\-]", "")
    number = F.rtrim(F.rtrim(bare.try_cast("decimal(30,8)").cast("string"), F.lit("0")), F.lit("."))  # eight decimals, so that no whole figure ends here
    return (
        F.when(field.isin(list(numeric)), F.coalesce(number, F.lower(bare)))
        .when(field == "importer_npwp", digits(text))
        .when(field == "currency", F.left(F.upper(text), F.lit(3)))
        .otherwise(F.lower(F.regexp_replace(text, r"\s+", " ")))
    )


def cross_document_form(value: Column) -> Column:
    """Comparison key across documents: numbers at four decimals, text with single spaces in upper case."""
    number = F.round(as_double(value).try_cast("decimal(30,8)"), 4).try_cast("decimal(30,4)").cast("string")
    return F.coalesce(number, F.upper(F.trim(F.regexp_replace(value, r"\s+", " "))))


def folded(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


# --- safe numbers --------------------------------------------------------------------------------------

def safe_float(c: Column) -> Column:
    return rnd(as_double(F.regexp_replace(c, ",", "")), 2)


def safe_int(c: Column) -> Column:
    return as_double(F.regexp_replace(c, ",", "")).try_cast("bigint")


def locale_float(c: Column) -> Column:
    """Reads both 11,603.000 (comma groups thousands) and 11.603,00 (comma is the decimal mark); a comma before three last digits groups."""
    text = F.trim(c)
    grouped = F.regexp_replace(text, ",", "")
    decimal_comma = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    return F.when(text.rlike(r"\d,\d{3}(\.|$)"), as_double(grouped)).otherwise(as_double(decimal_comma))


def typed_number(field: Column, value: Column) -> Column:
    """Numeric reading of a stored field by its kind: whole packages, money and weight at two decimals, else null."""
    money = ["gross_weight", "net_weight", "cif_value", "fob_value", "freight_value", "insurance_value"]
    return F.when(field == "total_packages", safe_int(value).cast("double")).when(field.isin(money), safe_float(value))
