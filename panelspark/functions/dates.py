"""Decision dates written as month text and day text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .constants import MONTH_NUMBERS


def month_number(name: Column) -> Column:
    """Month of an accepted English name in any case; NULL if unknown."""
    lookup = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    return F.try_element_at(lookup, F.lower(name))


def parse_decision_date(year: Column, month_text: Column, date_text: Column) -> Column:
    """Last day of a displayed range; NULL if it cannot be read.

    The day is the last number of ``date_text``.  The month is the last month
    named in ``date_text`` or else in ``month_text``; a range from December into
    January ends in the following year.
    """
    month_words = F.regexp_extract_all(month_text, F.lit("[A-Za-z]+"), F.lit(0))
    date_words = F.regexp_extract_all(date_text, F.lit("[A-Za-z]+"), F.lit(0))
    days = F.regexp_extract_all(date_text, F.lit(r"\d{1,2}"), F.lit(0))
    first = month_number(F.try_element_at(month_words, F.lit(1)))
    final = month_number(
        F.coalesce(
            F.try_element_at(date_words, F.lit(-1)), F.try_element_at(month_words, F.lit(-1))
        )
    )
    rolled = F.when((first == 12) & (final == 1), year + 1).otherwise(year)
    day = F.try_element_at(days, F.lit(-1)).cast("int")
    text = F.format_string("%04d-%02d-%02d", rolled.cast("int"), final, day)
    complete = first.isNotNull() & final.isNotNull() & day.isNotNull() & year.isNotNull()
    return F.when(complete, F.try_to_date(text, "yyyy-MM-dd"))
