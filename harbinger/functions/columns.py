"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Round to six decimals; adding zero turns -0.0 into 0.0."""
    return F.round(as_col(c), 6) + F.lit(0.0)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0 where the denominator is 0 or null."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def number(c: Column | str) -> Column:
    """Number or null; NaN counts as null, as pandas skips it."""
    return nan_to_null(as_col(c).try_cast("double"))


def truthy(c: Column | str) -> Column:
    """Text, number or boolean to boolean: ``true``, ``1`` and ``yes`` in any case."""
    text = F.lower(as_col(c).cast("string"))
    return F.coalesce(text.isin("true", "1", "yes"), F.lit(False))


def topic_number(c: Column | str) -> Column:
    """Topic id as INT; what is not a number becomes -1, fractions are cut off."""
    return F.coalesce(as_col(c).cast("string").try_cast("double").try_cast("int"), F.lit(-1))


# shape of a date text without its weekday, and how to read it; the first two carry a zone
SPELLINGS = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC)$", "d MMM yyyy HH:mm:ss z"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "d MMM yyyy HH:mm:ss xx"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
]


def spelled_date(text: Column) -> Column:
    """Mail, month-name and compact dates to TIMESTAMP_NTZ in UTC; others are null."""
    plain = F.regexp_replace(text, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    out = F.lit(None).cast("timestamp_ntz")
    for i, (shape, pattern) in enumerate(SPELLINGS):
        at = F.try_to_timestamp(F.when(plain.rlike(shape), plain), F.lit(pattern)).cast("timestamp_ntz")
        out = F.coalesce(out, F.convert_timezone(F.current_timezone(), F.lit("UTC"), at) if i < 2 else at)
    return out


def utc_naive(c: Column | str) -> Column:
    """Timestamp text to TIMESTAMP_NTZ in UTC; text without a zone is taken as UTC.

    ISO stamps, mail dates, month names (``April 2, 2025``) and compact days
    (``20250402``) are read; unparseable text becomes null.  Zoned and zoneless text are cast separately so that
    the result does not depend on the session time zone.
    """
    raw = F.trim(as_col(c).cast("string"))
    # words such as "yesterday" are no dates here, though a cast would take them
    text = F.when(raw.rlike(r"\d"), raw)
    zoned = text.rlike(r"\d{1,2}:\d{2}.*([zZ]|UTC|GMT|[+-]\d{2}:?\d{2})$")
    shifted = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.coalesce(F.when(zoned, shifted).otherwise(text.try_cast("timestamp_ntz")), spelled_date(raw))


def midnight(c: Column | str) -> Column:
    return F.date_trunc("day", as_col(c)).cast("timestamp_ntz")


def strip(c: Column | str) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(as_col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))
