"""Field clean-up and the three "is this field filled" predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import fixed


def let(value: Column, then) -> Column:
    """Bind ``value`` once for an expression that uses it many times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text(value: Column) -> Column:
    """A register field as a string that is never null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Trim every Unicode blank at both ends (Spark's ``trim`` alone removes spaces only)."""
    return F.btrim(text(value), F.lit(fixed.BLANKS))


def blank(value: Column) -> Column:
    """Empty, or one of the closed list of placeholder words."""
    return text(value).rlike(fixed.PLACEHOLDER)


def punctuation_only(value: Column) -> Column:
    """No letter or digit of any script anywhere (an empty value counts)."""
    return ~text(value).rlike(fixed.HAS_CONTENT)


def unusable(value: Column) -> Column:
    return blank(value) | punctuation_only(value)


def empty_under(contract: Column, value: Column) -> Column:
    """The filled-field test of a contract: v0.3 also refuses punctuation."""
    return F.when(contract == "v0.3", unusable(value)).otherwise(blank(value))


def sha256_form(value: Column) -> Column:
    return F.coalesce(value.rlike(fixed.SHA256_HEX), F.lit(False))


def alternatives(value: Column) -> Column:
    """The non-empty tokens of a pipe-separated list."""
    return F.filter(F.split(text(value), r"\|"), lambda token: strip(token) != "")


def iso_date(value: Column) -> Column:
    """An ISO calendar or week date as DATE, else null.

    Accepted: 2026-08-14, 20260814, 2026-W33, 2026W33, 2026-W33-5, 2026W335.
    """
    return let(strip(value), _iso_date)


def _iso_date(raw: Column) -> Column:
    calendar = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw).when(
        raw.rlike(r"^[0-9]{8}$"),
        F.regexp_replace(raw, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"))
    by_day = F.when(~calendar.startswith("0000"), calendar.try_cast("date"))

    year = F.substring(raw, 1, 4)
    digits = F.regexp_replace(F.substring(raw, 5, 6), "[-W]", "")
    week = F.substring(digits, 1, 2).try_cast("int")
    day = F.coalesce(F.when(F.length(digits) == 3, F.substring(digits, 3, 1).try_cast("int")),
                     F.lit(1))
    january_4 = F.concat(year, F.lit("-01-04")).try_cast("date")
    monday = F.date_add(F.date_sub(january_4, F.weekday(january_4)), (week - 1) * 7)
    in_year = week.between(1, 53) & (F.year(F.date_add(monday, 3)) == year.try_cast("int"))
    is_week = raw.rlike(r"^[0-9]{4}(-W[0-9]{2}(-[1-7])?|W[0-9]{2}[1-7]?)$")
    return F.when(is_week, F.when(in_year, F.date_add(monday, day - 1))).otherwise(by_day)
