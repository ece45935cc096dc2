"""Era dates, enforcement dates and date cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragmill.functions.text import map_of

# An era year plus this gives the year of the common calendar.
ERA_BASE = {"Meiji": 1867, "Taisho": 1911, "Showa": 1925, "Heisei": 1988, "Reiwa": 2018}
# Years from here on are placeholders for "not decided yet".
UNDECIDED_FROM = 2100
UNDECIDED = "施行日未定（政令委任等）"
# Day zero of the two spreadsheet calendars; a cell on it is a time of day.
SHEET_DAY_ZERO = ("1899-12-30", "1904-01-01")


def _digits(col: Column, fallback: int) -> Column:
    return F.coalesce(F.when(col.rlike(r"^\d+$"), col.try_cast("int")), F.lit(fallback))


def era_to_date(era: Column, year: Column, month: Column, day: Column) -> Column:
    """Text date of an era date; missing parts become year 0, month 1, day 1."""
    full = F.coalesce(map_of(ERA_BASE)[era], F.lit(0)) + _digits(year, 0)
    return F.format_string("%04d-%02d-%02d", full, _digits(month, 1), _digits(day, 1))


def enforce_date(law_id: Column) -> Column:
    """The second ``_`` field of a law id when it is eight digits that form a date."""
    field = F.split_part(law_id, F.lit("_"), F.lit(2))
    return F.when(field.rlike(r"^[0-9]{8}$"), F.try_to_date(field, "yyyyMMdd"))


def format_enforce_date(day: Column) -> Column:
    text = F.date_format(day, "yyyy-MM-dd")
    return F.when(day.isNull(), "").when(F.year(day) >= UNDECIDED_FROM, UNDECIDED).otherwise(text)


def format_date_cell(ts: Column) -> Column:
    """A cell as date, time or both, rounded to the second."""
    whole = F.timestamp_seconds(F.floor(F.unix_micros(ts) / 1000000 + 0.5))
    day, clock = F.date_format(whole, "yyyy-MM-dd"), F.date_format(whole, "HH:mm:ss")
    short = F.when(F.second(whole) == 0, F.date_format(whole, "HH:mm")).otherwise(clock)
    return (
        F.when(clock == "00:00:00", day)
        .when(day.isin(*SHEET_DAY_ZERO), short)
        .otherwise(F.concat_ws(" ", day, short))
    )
