"""Scalar rules as column expressions: ratios, months, money, strict and lenient parsing, content hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(31,2)"  # 29 digits before the point
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """name, if it is safe inside SQL text and paths."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b as a rounded double; null if b is 0 or either is null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def fraction_at_most(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Exactly a / b <= c / d, for whole numbers below 10^36 with b and d above 0.

    The sign of a * d - c * b from products of halves of 18 digits, each of which a decimal of 38 holds."""
    base, whole = F.lit(10**18).cast("decimal(19,0)"), "decimal(38,0)"
    bind = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is worked out once, however often f uses it

    def split(x: Column) -> tuple[Column, Column]:
        low = F.pmod(x, base).cast(whole)
        return ((x - low) / base).cast(whole), low

    def halves(**numbers: Column) -> Column:
        return F.struct(*[h.cast("decimal(18,0)").alias(f"{k}{i}") for k, x in numbers.items() for i, h in enumerate(split(x.cast(whole)))])

    def products(h: Column) -> Column:
        high, low = (h.a0 * h.d0 - h.c0 * h.b0).cast(whole), (h.a1 * h.d1 - h.c1 * h.b1).cast(whole)
        return F.struct(high.alias("high"), ((h.a0 * h.d1 - h.c0 * h.b1).cast(whole) + (h.a1 * h.d0 - h.c1 * h.b0).cast(whole)).cast(whole).alias("middle"), low.alias("low"))

    def carried(s: Column) -> Column:
        over, low = split(s.low)
        return F.struct(s.high.alias("high"), (s.middle + over).cast(whole).alias("middle"), low.alias("low"))

    def sign(s: Column) -> Column:
        over, middle = split(s.middle)
        high = (s.high + over).cast(whole)
        return (high < 0) | ((high == 0) & (middle == 0) & (s.low == 0))

    return bind(bind(bind(halves(a=a, b=b, c=c, d=d), products), carried), sign)


def real(c: Column) -> Column:
    """An exact decimal as the nearest double, for results."""
    return c.cast("double")


def month(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def months_between(late: Column, early: Column) -> Column:
    """Month boundaries from early to late (both dates)."""
    return (F.year(late) * 12 + F.month(late) - F.year(early) * 12 - F.month(early)).cast("int")


def lower_bound_at_zero(c: Column) -> Column:
    """c, but 0 if it is negative; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0).cast("double"), c))


def lenient(kind: str, c: Column) -> Column:
    """c as `kind`, null where it can't be."""
    return c.try_cast(kind)


def strict_integer(c: Column) -> Column:
    """A whole number in its canonical text form and in 64 bits, else null."""
    text = c.cast("string")
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,18})$"), text.try_cast("bigint"))


def strict_money(c: Column) -> Column:
    """A decimal number with two places at most, else null (never rounded)."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,2}0*)?$"), text.try_cast(MONEY))


def strict_timestamp(c: Column) -> Column:
    """An ISO instant that states its offset, else null."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def utc_text(c: Column) -> Column:
    """A timestamp as text whose order is time's."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def strict_boolean(c: Column, kind: str) -> Column:
    """c if its column is boolean, else null: the text 'false' is no boolean."""
    return c if kind == "boolean" else F.lit(None).cast("boolean")


def filled_text(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def state_code(c: Column) -> Column:
    """Two capital letters, else null."""
    return F.when(c.rlike("^[A-Z]{2}$"), c)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON; a null field counts as absent."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
