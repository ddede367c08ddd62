"""Dates that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date that stands for an open end.
OPEN_END = "9999-12-31"


def is_blank(c: Column) -> Column:
    """True where the text is null or nothing but white space."""
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s+", "")) == 0, F.lit(True))


def parse_day(c: Column) -> Column:
    """The day of ``YYYY-MM-DD`` or ``DD/MM/YYYY``, spaces and a time of day aside; null for all else.

    A date that no calendar has (``2023-02-30``) is null as well.
    """
    iso = F.regexp_extract(c, r"(?U)^\s*(\d{4}-\d{2}-\d{2})(?:[T\s].*)?$", 1)
    dmy = F.regexp_extract(c, r"(?U)^\s*(\d{2}/\d{2}/\d{4})(?:[T\s].*)?$", 1)
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(dmy, F.lit("")), "dd/MM/yyyy"))


def iso_of_dmy(c: Column) -> Column:
    """``D/M/YYYY`` rewritten as ``YYYY-MM-DD``; anything else comes back as it is."""
    parts = F.split(F.trim(c), "/")
    ok = F.trim(c).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(ok, F.concat_ws("-", parts[2], F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0"))).otherwise(c)


def day_before(c: Column) -> Column:
    """The ISO day before an ISO day; text that is no date comes back as it is."""
    d = F.try_to_date(c, "yyyy-MM-dd")
    return F.coalesce(F.date_format(F.date_sub(d, 1), "yyyy-MM-dd"), c)


def temporal_anchor(c: Column) -> Column:
    """``YYYY-MM-DD`` as it is, ``YYYY-MM`` at its 15th, ``YYYY`` at its last day; vague text is null."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-15")))
        .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31")))
    )
