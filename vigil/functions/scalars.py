"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import fixed_values as fv

_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
# Java also reads "1.5d" and hexadecimal text as numbers; a journal does not.
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf|infinity)$"


def parse_stamp(date: Column, time: Column) -> Column:
    """Naive timestamp from date and time text, NULL when it is not one.

    ``try_to_timestamp`` would return a zoned value, so the text is cast to
    TIMESTAMP_NTZ and the pattern keeps out partial dates the cast accepts.
    """
    text = F.concat(date, F.lit(" "), time)
    return F.when(text.rlike(_STAMP), text.try_cast("timestamp_ntz"))


def parse_flag(text: Column) -> Column:
    """Three-valued alarm flag; an unknown word stays NULL."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(fv.ALARM_TRUE), F.lit(True)).when(
        word.isin(fv.ALARM_FALSE), F.lit(False)
    )


def parse_decimal(text: Column) -> Column:
    """Number with a decimal point or a decimal comma."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def nonfinite_flag(value: Column) -> Column:
    return value.isNotNull() & ~is_finite(value)


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(8.64e10)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL when the denominator is zero (ANSI division would raise)."""
    return top / F.nullif(bottom, F.lit(0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def hash_bucket(parts: list[Column], modulus: int, seed: int | str = 2026) -> Column:
    """Bucket 0..modulus-1 of a row key, the same in every engine that has MD5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(modulus)


def row_order(parts: list[Column], seed: int | str = 2026) -> Column:
    """Pseudo-random but reproducible ordering key of a row."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def surrogate_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def iso_text(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def formula_safe(text: Column) -> Column:
    """Quote text a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def day_number(day: Column) -> Column:
    return F.unix_date(F.to_date(day))


def is_midnight(stamp: Column) -> Column:
    return stamp == F.date_trunc("day", stamp).cast("timestamp_ntz")


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive pattern test; NULL text does not match."""
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))
