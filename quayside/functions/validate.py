"""Format checks; each returns a boolean that is never null."""

from __future__ import annotations

from collections.abc import Callable

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import as_double, digits

Validator = Callable[[Column], Column]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_npwp(c: Column, lengths=(15,)) -> Column:
    """Taxpayer number: 15 digits (15 or 16 in the service variant) after dropping punctuation."""
    bare = F.regexp_replace(c, r"[.\-\s]", "")
    return _sure(bare.rlike("^\\d+$") & F.length(bare).isin(list(lengths)))


def valid_nib(c: Column) -> Column:
    return _sure(F.regexp_replace(c, r"\s", "").rlike(r"^\d{13}$"))


def valid_hs(c: Column) -> Column:
    return _sure(F.regexp_replace(c, r"[.\s]", "").rlike(r"^\d{8}$"))


def valid_unlocode(c: Column) -> Column:
    return _sure(F.upper(F.trim(c)).rlike("^[A-Z]{2}[A-Z0-9]{3}$"))


def known_unlocode(c: Column, codes: Sequence[str] = tuple(K.KNOWN_LOCODES)) -> Column:
    """A well-formed code that is also in the list of ports; a full port table is a ``left_semi`` join instead."""
    return valid_unlocode(c) & _sure(F.upper(F.trim(c)).isin(list(codes)))


def contains_locode(c: Column) -> Column:
    return _sure(c.rlike(r"\b[A-Z]{5}\b"))


def valid_date(c: Column) -> Column:
    layouts = ["yyyy-M-d", *K.ACCEPTED_DATE_LAYOUTS]
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(layout)) for layout in layouts]).isNotNull()


def valid_currency(c: Column) -> Column:
    return _sure(F.upper(F.trim(c)).rlike("^[A-Z]{3}$"))


def valid_container(c: Column) -> Column:
    """Owner code, serial and check digit of a freight container (letter values skip multiples of 11)."""
    code = F.regexp_replace(F.upper(F.trim(c)), r"[\s\-]", "")
    sound = code.rlike(r"^[A-Z]{4}\d{7}$")
    total = F.lit(0)
    for place in range(10):
        point = F.ascii(F.substring(code, place + 1, 1))
        order = point - F.lit(65)
        letter = F.lit(10) + order + F.floor((order + F.lit(9)) / F.lit(10))
        total = total + F.when(point >= 65, letter).otherwise(point - F.lit(48)) * F.lit(2**place)
    check = F.pmod(F.pmod(total, F.lit(11)), F.lit(10))
    return _sure(F.when(sound, check == F.substring(code, 11, 1).try_cast("int")))


def matches_pattern(c: Column, pattern: Column) -> Column:
    """Full text against a pattern held in another column (carrier-specific numbers)."""
    return _sure(F.regexp_like(c, pattern))


def field_format_valid(field: Column, value: Column) -> Column:
    """Format check by field family, as used when estimating confidence."""
    text = F.trim(value)
    number = as_double(F.regexp_replace(text, ",", ""))
    money = ["gross_weight", "cif_value", "fob_value", "freight_value", "insurance_value"]
    check = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(False))
        .when(field == "importer_npwp", F.length(digits(text)).isin(15, 16))
        .when(field == "importer_nib", F.length(digits(text)) == 13)
        .when(field == "hs_code", text.rlike(r"^\d{8}$"))
        .when(field == "currency", text.rlike("^[A-Z]{3}$"))
        .when(field.isin(money), number >= 0)
        .when(field == "total_packages", number >= 1)
        .otherwise(F.lit(True))
    )
    return _sure(check)


# fields whose value is taken from the first engine that passes the check
RULE_CHECKS: dict[str, Validator] = {
    **{name: valid_npwp for name in K.NPWP_FIELDS},
    **{name: valid_nib for name in K.NIB_FIELDS},
    **{name: valid_hs for name in K.HS_FIELDS},
    **{name: valid_unlocode for name in K.PORT_FIELDS},
    **{name: valid_date for name in ["bl_date", "tglBl", "invoice_date", "tglArrival"]},
    "currency": valid_currency,
}


def register_rule_check(field: str, fn: Validator) -> None:
    RULE_CHECKS[field] = fn


def is_rule_checked(field: Column) -> Column:
    return field.isin(list(RULE_CHECKS))


def passes_rule_check(field: Column, value: Column) -> Column:
    """True when the field has a check and the value passes it."""
    chain = None
    for check in dict.fromkeys(RULE_CHECKS.values()):
        fields = [name for name, fn in RULE_CHECKS.items() if fn is check]
        chain = F.when(field.isin(fields), check(value)) if chain is None else chain.when(field.isin(fields), check(value))
    return _sure(chain.otherwise(F.lit(False)))


def error_class(code: Column, profile: str = "spec") -> Column:
    """Handling class of a customs error code; a missing code recovers by itself, an unknown one escalates."""
    table = {k: v[0] for k, v in K.ERROR_CODES.items()} if profile == "spec" else K.SERVICE_ERROR_CODES
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    blank = F.coalesce(F.trim(code), F.lit("")) == ""
    return F.when(blank, F.lit("AUTO_RECOVERABLE")).otherwise(
        F.coalesce(F.try_element_at(mapping, code), F.lit("ADMIN_ESCALATION"))
    )
