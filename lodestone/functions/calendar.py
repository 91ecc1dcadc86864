"""Time instances: identifiers, records and parents of years, quarters, months and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

LEVELS = ("day", "month", "quarter", "year")


def year_id(date: Column | str) -> Column:
    return F.format_string("YEAR_%d", F.year(col(date)))


def quarter_id(date: Column | str) -> Column:
    return F.format_string("Q%d_%d", F.quarter(col(date)), F.year(col(date)))


def month_id(date: Column | str) -> Column:
    return F.format_string("MONTH_%d_%02d", F.year(col(date)), F.month(col(date)))


def day_id(date: Column | str) -> Column:
    return F.format_string("DAY_%d_%02d_%02d", F.year(col(date)), F.month(col(date)), F.day(col(date)))


def level_of(identifier: Column | str) -> Column:
    c = col(identifier)
    return F.when(c.startswith("YEAR_"), "year").when(c.rlike(r"^Q[1-4]_"), "quarter").when(c.startswith("MONTH_"), "month").when(c.startswith("DAY_"), "day")


def start_of(identifier: Column | str) -> Column:
    c, level = col(identifier), level_of(identifier)
    number = lambda pattern: F.regexp_extract(c, pattern, 1).try_cast("int")
    return (
        F.when(level == "year", F.make_date(number(r"^YEAR_(\d+)"), F.lit(1), F.lit(1)))
        .when(level == "quarter", F.make_date(number(r"^Q\d_(\d+)"), number(r"^Q(\d)") * 3 - 2, F.lit(1)))
        .when(level == "month", F.make_date(number(r"^MONTH_(\d+)_"), number(r"^MONTH_\d+_(\d+)"), F.lit(1)))
        .when(level == "day", F.make_date(number(r"^DAY_(\d+)_"), number(r"^DAY_\d+_(\d+)_"), number(r"^DAY_\d+_\d+_(\d+)")))
    )


def end_of(level: Column | str, start: Column | str) -> Column:
    level, start = col(level), col(start)
    return F.when(level == "year", F.last_day(F.add_months(start, 11))).when(level == "quarter", F.last_day(F.add_months(start, 2))).when(level == "month", F.last_day(start)).when(level == "day", start)


def label_of(level: Column | str, start: Column | str) -> Column:
    level, start = col(level), col(start)
    return (
        F.when(level == "year", F.year(start).cast("string"))
        .when(level == "quarter", F.format_string("Q%d %d", F.quarter(start), F.year(start)))
        .when(level == "month", F.date_format(start, "MMMM yyyy"))
        .when(level == "day", F.date_format(start, "yyyy-MM-dd"))
    )


def parent_id(level: Column | str, start: Column | str) -> Column:
    """One level up: day, month, quarter, year; null above."""
    level = col(level)
    return F.when(level == "day", month_id(start)).when(level == "month", quarter_id(start)).when(level == "quarter", year_id(start))
