"""Small helpers shared by all column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, places: int) -> Column:
    """Round half up on the image of a double with eight digits, so float noise never decides a tie. Any magnitude; what is not finite stays.

    The argument occurs once: copies of a long expression swell the generated code beyond what is compiled.
    """
    return F.round(F.round(c.cast("double"), 8), places)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, also inside a branch."""
    return F.transform(F.array(c), use)[0]


def dec(c: Column, scale: int = 4, precision: int = 18) -> Column:
    """Exact fixed-point copy, for sums whose order must not matter."""
    return c.cast(f"decimal({precision},{scale})")


def millionths(c: Column) -> Column:
    """The double in millionths as a whole number, rounded like ``dec(c, 6)``: sums of it are as exact and need no big decimals.

    Only a value near the middle between two millionths, a large one, or one that is not finite takes the way over its decimal image."""
    scaled = c * F.lit(1e6)
    near = (F.abs(c) < 1e6) & (F.abs(scaled - F.rint(scaled)) < 0.25)
    return F.when(near, F.rint(scaled).cast("bigint")).otherwise((dec(c, 6) * F.lit(1000000)).cast("bigint"))


def is_filled(c: Column) -> Column:
    """Present, not blank and not zero: the sense in which a required field counts as filled."""
    text = F.trim(c.cast("string"))
    return F.coalesce((text != "") & ~text.rlike(r"^-?0+(\.0+)?$"), F.lit(False))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def plain_number(c: Column, places: int) -> Column:
    """Decimal text with at least one fraction digit and no trailing zeros (12.50 -> 12.5, 9.000 -> 9.0); null beyond 22 digits."""
    text = F.rtrim(F.round(c.try_cast("decimal(30,8)"), places).try_cast(f"decimal(30,{places})").cast("string"), F.lit("0"))
    # the mark behind the text stands for its end, so that the text, a long expression, occurs once
    return F.rtrim(F.replace(F.concat(text, F.lit("|")), F.lit(".|"), F.lit(".0|")), F.lit("|"))


def ends_in_digit(c: Column) -> Column:
    return F.ascii(F.right(c, F.lit(1))).between(48, 57)


def as_double(c: Column) -> Column:
    """Number; null for other text, also for the type marks (5d, 12f) and hexadecimal forms that a plain cast reads.

    Only text that does not end in a digit, or holds an x, is looked at closely."""
    plain = ends_in_digit(c) & ~F.contains(c, F.lit("x")) & ~F.contains(c, F.lit("X"))
    return F.when(plain | ~c.rlike(r"[0-9.][dDfF]\s*$|[xX]"), c.try_cast("double"))


def as_number(c: Column) -> Column:
    """Number with thousands commas removed; null when it is not a number."""
    return as_double(F.regexp_replace(c, ",", ""))
