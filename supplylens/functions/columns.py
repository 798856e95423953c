"""Scalar column helpers (FN1-FN7, PRJ3, FLT2, AGG5, FC2, GEO2)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The web-mercator half circumference in metres used by the
# tile maths, and the latitude limit of the square mercator world.
MERCATOR_HALF_WORLD = 20037508.34
MERCATOR_MAX_LAT = 85.0511


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


_INTEGRAL = {"tinyint", "smallint", "int", "integer", "bigint", "long", "byte", "short"}
# A text can only cast to a whole number if (after blanks and a sign) it
# starts with a digit; to a fractional number also with '.', or the words
# Infinity / NaN.  These prefixes are necessary, not sufficient.
_INT_PREFIX = r"^\s*[+-]?[0-9]"
_FRAC_PREFIX = r"^\s*[+-]?[0-9.IiNn]"


def try_number(c: str | Column, to: str = "double") -> Column:
    """``try_cast`` of text to a number, screened by a cheap prefix test.

    A failing cast costs an exception per row (about 20x a successful one),
    and messy text is mostly non-numeric, so text that cannot start a
    number is NULL without trying.  Everything else is ``try_cast``: the
    result is exactly ``try_cast``'s, only faster.
    """
    col = col_of(c)
    prefix = _INT_PREFIX if to.lower() in _INTEGRAL else _FRAC_PREFIX
    return F.when(col.rlike(prefix), col.try_cast(to))


def parse_number(c: str | Column, to: str = "bigint") -> Column:
    """Thousands-separated text to a number; anything else becomes NULL.

    ``'1,234'`` -> 1234, ``''``/``'-'``/``'1.5'`` -> NULL (for bigint).
    """
    return try_number(F.regexp_replace(F.trim(col_of(c)), ",", ""), to)


def to_double(c: str | Column) -> Column:
    """Lenient numeric coercion: bad text becomes NULL instead of an error."""
    return try_number(F.trim(col_of(c).cast("string")), "double")


def is_present(c: str | Column, junk: Iterable[str] = ("", "-")) -> Column:
    """Not NULL and not one of the junk tokens (after trimming)."""
    col = col_of(c)
    junk = list(junk)
    cond = col.isNotNull()
    if junk:
        cond = cond & ~F.trim(col.cast("string")).isin(junk)
    return cond


def clean_label(c: str | Column, blank: str = "Unknown") -> Column:
    """Trimmed text, with NULL or blank replaced by ``blank``."""
    t = F.coalesce(F.trim(col_of(c)), F.lit(""))
    return F.when(t == "", F.lit(blank)).otherwise(t)


_DATE_UNITS = {"YEAR": "year", "QUARTER": "quarter", "MONTH": "month", "WEEK": "week"}


def truncate_to(c: str | Column, unit: str) -> Column:
    """Truncate to a calendar unit, keeping a DATE result.

    Day and coarser units truncate the DATE itself (``trunc``), which avoids
    the session-time-zone timestamp round trip of ``date_trunc``.
    """
    u = unit.upper()
    d = F.to_date(col_of(c))
    if u == "DAY":
        return d
    if u in _DATE_UNITS:
        return F.trunc(d, _DATE_UNITS[u])
    return F.to_date(F.date_trunc(u, col_of(c)))


def month_start(c: str | Column) -> Column:
    return truncate_to(c, "MONTH")


def quarter_start(year: str | Column, quarter: str | Column) -> Column:
    """``(year text, 'Q1'..'Q4')`` -> first day of the quarter.

    Unknown quarter labels or non-numeric years give NULL, never an error.
    """
    q = F.upper(F.trim(col_of(quarter)))
    month = (F.when(q == "Q1", 1).when(q == "Q2", 4)
             .when(q == "Q3", 7).when(q == "Q4", 10))
    y = try_number(F.trim(col_of(year).cast("string")), "int")
    return F.when(y.isNotNull() & month.isNotNull(),
                  F.make_date(y, month, F.lit(1)))


def quarter_label(year: str | Column, quarter: str | Column) -> Column:
    return F.concat(col_of(year).cast("string"), F.lit("-"), col_of(quarter))


def order_cols(order: Sequence) -> list[Column]:
    """``[("c", "desc"), "d"]`` -> sort columns with explicit null order.

    Ascending keys put NULLs last and descending keys put them last too, so
    the order matches SQL engines that default to NULLS LAST.
    """
    out = []
    for o in order:
        if isinstance(o, Column):
            out.append(o)
            continue
        name, direction = (o, "asc") if isinstance(o, str) else o
        c = F.col(name)
        out.append(c.desc_nulls_last() if direction.lower() == "desc"
                   else c.asc_nulls_last())
    return out


def order_sql(order: Sequence) -> str:
    parts = []
    for o in order:
        name, direction = (o, "asc") if isinstance(o, str) else o
        parts.append(f"`{name}` {direction.upper()} NULLS LAST")
    return ", ".join(parts)


def valid_coordinate(lat: str | Column, lon: str | Column) -> Column:
    """Both coordinates numeric, not NaN, and inside the WGS84 range."""
    la, lo = to_double(lat), to_double(lon)
    return (la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)
            & la.between(-90.0, 90.0) & lo.between(-180.0, 180.0))


def mercator_x(lon: str | Column) -> Column:
    return col_of(lon) * F.lit(MERCATOR_HALF_WORLD) / F.lit(180.0)


def mercator_y(lat: str | Column) -> Column:
    """NULL beyond the projection's latitude limit."""
    lat_c = F.when(col_of(lat).between(-MERCATOR_MAX_LAT, MERCATOR_MAX_LAT), col_of(lat))
    return (F.ln(F.tan((F.lit(90.0) + lat_c) * F.lit(3.141592653589793) / F.lit(360.0)))
            / F.lit(3.141592653589793) * F.lit(MERCATOR_HALF_WORLD))
