"""Column expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months.
MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]

# Formats of dates, in their order; then those that a reader with the day first takes.
FORMATS = ("d/M/yyyy H:m", "d/M/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "d-M-yyyy")
DAY_FIRST = ("yyyy-M-d'T'H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "d.M.yyyy H:m", "d.M.yyyy", "d/M/yyyy H:m:s", "d-M-yyyy H:m", "d MMMM yyyy", "d MMM yyyy")
#: Days of the units in relative dates.
DAYS = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 30, "year": 365}


def parse(c: Column) -> Column:
    """The first format that fits the first 19 characters, else the first with the day first that fits all."""
    whole = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(F.substring(whole, 1, 19), F.lit(f)) for f in FORMATS], *[F.try_to_timestamp(whole, F.lit(f)) for f in DAY_FIRST])


def relative(c: Column, reference: Column) -> Column:
    """'2 months ago' and the like, before the reference."""
    n = F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).try_cast("int")
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for unit, days in DAYS.items():
        out = out.when(c.contains(unit), n * F.lit(float(days)))
    return F.timestamp_seconds(F.unix_timestamp(reference) - F.round(out * 86400).cast("long"))


def from_path(c: Column) -> Column:
    """The first of the month in a path such as /uploads/2025/07/."""
    y, m = (F.nullif(F.regexp_extract(c, r"/([0-9]{4})/([0-9]{2})/", i), F.lit("")).try_cast("int") for i in (1, 2))
    return F.try_to_timestamp(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lit("01")), F.lit("yyyy-MM-dd"))


def from_expiry(c: Column, days: int = 90) -> Column:
    """The instant so many days before the one that a link's parameter oe names by eight hexadecimal digits; null without it."""
    code = F.nullif(F.regexp_extract(c, r"oe=([0-9A-Fa-f]{8})", 1), F.lit(""))
    return F.timestamp_seconds(F.conv(code, 16, 10).cast("long") - days * 86400)


def french_month(c: Column) -> Column:
    """(year, month) of a label such as 'février 2024'; nulls without a month or a year."""
    t = F.lower(c)
    year = F.nullif(F.regexp_extract(t, r"([0-9]{4})", 1), F.lit("")).try_cast("int")
    month = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(t.contains(name), i).otherwise(month)
    both = year.isNotNull() & month.isNotNull()
    return F.struct(F.when(both, year).alias("year"), F.when(both, month).alias("month"))


def french_quarter(c: Column) -> Column:
    """(year, quarter) of a label such as 'deuxième trimestre 2024'."""
    t = F.lower(c)
    q = F.when(t.contains("premier") | t.contains("1er"), 1).when(t.contains("deuxi"), 2).when(t.contains("troisi"), 3).when(t.contains("quatri"), 4)
    return F.struct(F.nullif(F.regexp_extract(t, r"([0-9]{4})", 1), F.lit("")).try_cast("int").alias("year"), q.alias("quarter"))
