"""Text predicates and trimming shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The personal-data and date patterns an analysis looks for. (?U) gives \d and
# \s their Unicode meaning.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?U)(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
DATE_PREFIXES = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
)

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_email(text: Column) -> Column:
    """Whether an address occurs; the pattern is only tried on text with an @ in it."""
    return text.contains("@") & text.rlike(EMAIL_PATTERN)


def has_phone(text: Column) -> Column:
    return text.rlike(PHONE_PATTERN)


def starts_with_date(text: Column) -> Column:
    return strip(text).rlike("(?U)^(" + "|".join(DATE_PREFIXES) + ")")


def share(predicate: Column) -> Column:
    """Aggregate: the share of rows, among those where the predicate is known, that satisfy it."""
    return F.avg(predicate.cast("double"))


def python_text(value: Column) -> Column:
    """A value as display text, null as ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def number_text(value: Column) -> Column:
    """A rounded number as Python shows it: shortest digits, small ones with an exponent."""
    scientific = (F.abs(value) < 1e-4) & (value != 0)
    text = value.cast("string")
    padded = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "E-0$1")
    return F.when(scientific, F.lower(padded)).otherwise(
        F.when(F.abs(value).between(1e-4, 1e-3), _plain_decimal(value))
        .when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16), _plain_decimal(value))
        .otherwise(text)
    )


def _plain_decimal(value: Column) -> Column:
    """Digits without an exponent, trailing zeros cut to one place."""
    digits = F.rtrim(value.cast("decimal(30, 8)").cast("string"), F.lit("0"))
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
