"""Column expressions shared by the operators. All of them stay inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from bourseflow import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double, NULL when b is zero or missing (ANSI division would raise)."""
    return F.try_divide(dbl(a), dbl(b))


def half_up(c: Column | str, places: int) -> Column:
    """Round a double half away from zero. Going through a decimal makes a stored x.xxx5 a real tie, as in NUMERIC math."""
    return F.round(col(c).cast("decimal(38,10)"), places).cast("double")


def growth(a: Column | str, b: Column | str, places: int = 6) -> Column:
    return half_up(ratio(a, b) - F.lit(1.0), places)


def positive(c: Column | str) -> Column:
    return F.when(col(c) > 0, col(c))


def clamp(c: Column, low: float, high: float) -> Column:
    # greatest/least skip NULLs, so a missing value has to be passed through explicitly
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def exact_mean(c: Column | str) -> Column:
    """Mean of a decimal or integer column: exact sum first, one division at the end."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal distribution for 0 < p < 1."""
    tail = F.when(p < F.lit(0.5), p).otherwise(F.lit(1.0) - p)
    q = F.sqrt(F.lit(-2.0) * F.log(tail))
    outer = _horner(q, K.QUANTILE_C) / (_horner(q, K.QUANTILE_D) * q + F.lit(1.0))
    centre = p - F.lit(0.5)
    r = centre * centre
    inner = _horner(r, K.QUANTILE_A) * centre / (_horner(r, K.QUANTILE_B) * r + F.lit(1.0))
    return (F.when(p < F.lit(K.QUANTILE_LOW), outer)
            .when(p > F.lit(1.0 - K.QUANTILE_LOW), -outer)
            .otherwise(inner))


def _number_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c).cast("string"), ",", ""))


def clean_number(c: Column | str, precision: int = 38, scale: int = 6) -> Column:
    """Text to decimal: thousands separators dropped; blanks, '-', 'N/A' and non-finite words become NULL.

    So do numbers beyond the column: ask `number_beyond` where they can occur."""
    text = _number_text(c)
    text = F.when(~text.isin("", "-", "N/A") & ~F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity"), text)
    return text.try_cast(f"decimal({precision},{scale})")


def number_beyond(c: Column | str, precision: int = 38, scale: int = 6) -> Column:
    """True where the text is a number that the decimal column cannot hold."""
    number = _number_text(c).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return F.coalesce(number & clean_number(c, precision, scale).isNull(), F.lit(False))


def local_date(ts: Column | str, zone: str | Column) -> Column:
    return F.from_utc_timestamp(col(ts), zone).cast("date")
