"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daymart.functions.fixed_values import FIRST_DAY, LAST_DAY, NO_USER, RATIO_GUARD


def match_key(name: Column, trimmed: bool = False) -> Column:
    """Case-insensitive join key of an entity name."""
    return F.upper(F.trim(name)) if trimmed else F.upper(name)


def filled(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def lenient_double(value: Column) -> Column:
    """A double, or null where the text is no number or is NaN.

    Spark also reads Java's ``1d`` and ``1f`` as numbers; a file of measurements does not mean that.
    """
    text = value.cast("string")
    return F.nullif(
        F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double")), F.lit(float("nan"))
    )


def number_or_null(value: Column) -> Column:
    """A double column with NaN turned to null."""
    return F.nullif(value.cast("double"), F.lit(float("nan")))


def lenient_int(value: Column) -> Column:
    """A whole number, or null where the text is none."""
    number = lenient_double(value)
    return F.when(number == F.floor(number), number.try_cast("int"))


def lenient_date(value: Column) -> Column:
    """A date, or null where the text is none."""
    return value.try_cast("date")


def zero_if_null(value: Column) -> Column:
    """A double with null and NaN turned to 0.0."""
    return F.coalesce(number_or_null(value), F.lit(0.0))


def finite_or_null(value: Column) -> Column:
    """A double with both infinities and NaN turned to null."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def guarded_growth(now: Column, before: Column) -> Column:
    """Change relative to the earlier value, guarded against a zero base."""
    return (now - before) / (F.abs(before) + F.lit(RATIO_GUARD))


def clamp_day(day: Column, first: str = FIRST_DAY, last: str = LAST_DAY) -> Column:
    """A date moved into the bounds; an absent or empty one becomes the lower bound."""
    lowest, highest = F.lit(first).cast("date"), F.lit(last).cast("date")
    # greatest and least skip nulls, so an absent date has to be settled first.
    given = F.coalesce(filled(day.cast("string")).try_cast("date"), lowest)
    return F.greatest(lowest, F.least(given, highest))


def ordered_range(start: Column, end: Column) -> Column:
    """Struct (start, end) with the two swapped where they are reversed."""
    return F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"))


def week_ending(day: Column) -> Column:
    """The Sunday that closes the day's week; a Sunday closes its own."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def comment_line(ts: Column, user: Column, text: Column) -> Column:
    """One printed line per comment: day, user (or a dash) and trimmed text."""
    return F.format_string(
        f"%s {NO_USER} %s: %s",
        F.coalesce(F.substring(ts.cast("string"), 1, 10), F.lit("")),
        F.coalesce(filled(user), F.lit(NO_USER)),
        F.trim(F.coalesce(text, F.lit(""))),
    )
