"""Seasons, months and dates as column expressions.

Season codes: 0 Yearly, 1 Kharif (June to September), 2 Rabi (October to February), 3 Zaid (March to May). January and
February belong to the Rabi of the year before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season_of(date: str | Column) -> Column:
    m = F.month(_col(date))
    return F.when(m.between(6, 9), 1).when(m.between(3, 5), 3).when(m.isNotNull(), 2)


def season_year(date: str | Column, legacy: bool = False) -> Column:
    """The year a season is counted in; ``legacy`` keeps the calendar year."""
    y = F.year(_col(date))
    return y if legacy else F.when(F.month(_col(date)) <= 2, y - 1).otherwise(y)


def season_rank(season: str | Column) -> Column:
    """Kharif, Rabi, Zaid, Yearly: 0, 1, 2, 3."""
    return F.pmod(_col(season) - 1, F.lit(4))


def next_season(year: str | Column, season: str | Column) -> Column:
    """(year, season) after a season: Zaid is followed by the Kharif of the next year's count."""
    y, s = _col(year), _col(season)
    return F.struct(F.when(s == 3, y + 1).otherwise(y).alias("year"), F.when(s == 3, 1).otherwise(s + 1).alias("season"))


def season_index(year: str | Column, season: str | Column) -> Column:
    """Seasons in order as one number, three a year."""
    return 3 * _col(year) + _col(season) - 1


def season_bounds(year: str | Column, season: str | Column) -> Column:
    """First day of a season and the day after its last."""
    y, s = _col(year), _col(season)
    first = F.when(s == 1, 6).when(s == 2, 10).otherwise(3)
    months = F.when(s == 1, 4).when(s == 2, 5).otherwise(3)
    begin = F.make_date(F.when(s == 3, y + 1).otherwise(y), first, F.lit(1))
    return F.struct(begin.alias("begin"), F.add_months(begin, months).alias("end"))


def month_index(date: str | Column) -> Column:
    """Months as integers: 12 * year + month - 1."""
    return 12 * F.year(_col(date)) + F.month(_col(date)) - 1


def month_label(index: str | Column) -> Column:
    i = _col(index)
    return F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"))


def last_month(year: str | Column, season: str | Column) -> Column:
    """The month index of a season's last month."""
    y, s = _col(year), _col(season)
    return F.when(s == 1, 12 * y + 8).when(s == 2, 12 * (y + 1) + 1).when(s == 3, 12 * (y + 1) + 4).otherwise(12 * y + 11)


def parsed_date(text: str | Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")) -> Column:
    """A date from text in any of the formats, or from a spreadsheet's day number."""
    t = F.trim(_col(text))
    tried = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats]
    serial = F.when(t.rlike(r"^\d{4,5}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(t.try_cast("double")).cast("int")))
    return F.coalesce(*tried, serial)
