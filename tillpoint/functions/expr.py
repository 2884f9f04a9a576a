"""Column expressions shared by the queries and jobs.

All of them are built-in Spark expressions (JVM side, inside whole-stage
codegen); no Python UDF is involved.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint.schema import NON_REVENUE_STATUSES, ORDER_STATUSES

__all__ = [
    "revenue_status", "full_name", "money", "exact_avg", "pct_of",
    "whole_days_between", "trim_ws", "is_blank", "parse_lenient_timestamp",
    "valid_status", "normalize_status", "subtotal_of", "MICROS_PER_DAY", "ts_lit",
]

MICROS_PER_DAY = 86_400_000_000


def ts_lit(value) -> Column:
    """Timestamp literal.  A naive datetime is UTC wall-clock time and is
    read in the session zone (UTC), not in the Python process's local zone
    as F.lit(datetime) would; an aware one is converted to UTC first."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp")
    if isinstance(value, dt.date):
        return F.lit(value.isoformat()).cast("timestamp")
    return F.lit(value).cast("timestamp")


def revenue_status(status: Column | str = "status") -> Column:
    """Status predicate used everywhere revenue is counted:
    NOT IN ('cancelled', 'refunded').  NULL status gives NULL (not counted)."""
    c = F.col(status) if isinstance(status, str) else status
    return ~c.isin(*NON_REVENUE_STATUSES)


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """first || ' ' || last; NULL when either part is NULL (not concat_ws)."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def money(c: Column) -> Column:
    """ROUND(x, 2), half away from zero on decimals."""
    return F.round(c, 2)


def exact_avg(total: Column, n: Column) -> Column:
    """round(sum / count, 2) on decimals.

    Spark's avg(decimal(p,2)) keeps 6 decimals and rounding that again can
    move a half-cent boundary once groups exceed ~10^4 rows.  Dividing the
    exact decimal sum by the count keeps 18 decimals, exact for any count
    that fits a long.  NULL when n is 0 or NULL."""
    return F.round(total / F.nullif(n.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), 2)


def pct_of(part: Column, whole: Column) -> Column:
    """ROUND(part / NULLIF(whole, 0) * 100, 2), rounded once.

    The operands are cast so that Spark's decimal division keeps 14
    decimals; with the types of a sum it would keep 6 before the * 100."""
    hundredfold = (part * 100).cast("decimal(24,2)")
    return F.round(hundredfold / F.nullif(whole, F.lit(0)).cast("decimal(22,2)"), 2)


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Day field of (later - earlier): whole 24-hour days, truncated toward
    zero (not calendar days, which datediff counts)."""
    diff = F.unix_micros(later) - F.unix_micros(earlier)
    whole = diff - (diff % F.lit(MICROS_PER_DAY))
    return (whole / F.lit(MICROS_PER_DAY)).cast("int")


# The Unicode White_Space characters stripped from both ends
# (Spark's trim() strips only the ASCII space).
WHITE_SPACE = ("\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def trim_ws(c: Column) -> Column:
    """Strip white space on both ends; btrim with a character set, no regex."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """NULL, empty or white space only."""
    return c.isNull() | (trim_ws(c) == F.lit(""))


def valid_status(c: Column) -> Column:
    return c.isin(*ORDER_STATUSES)


def normalize_status(c: Column) -> Column:
    """Case-insensitive match to a known status, as lower-case text; NULL
    for NULL, blank or unknown values.  No trimming (the feed trims first)."""
    low = F.lower(c)
    return F.when(low.isin(*ORDER_STATUSES), low)


def subtotal_of(quantity: Column, unit_price: Column) -> Column:
    """Generated column quantity * unit_price as DECIMAL(12,2)."""
    return (quantity.cast("decimal(10,0)") * unit_price).cast("decimal(12,2)")


# Accepted date forms of the feed (fixed, documented list): ISO date, ISO
# timestamp with or without zone, MM/dd/yyyy, yyyy/MM/dd, each with an
# optional time of day.  Each needs year, month and day.
_DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)


def parse_lenient_timestamp(c: Column) -> Column:
    """Parse a feed date into a UTC timestamp; NULL when it is not a date.

    ISO forms go through the ANSI-safe cast (which also checks the calendar:
    2024-02-30 fails); slash forms through try_to_timestamp with a pattern."""
    return parse_trimmed_timestamp(trim_ws(c))


def parse_trimmed_timestamp(s: Column) -> Column:
    """``parse_lenient_timestamp`` of a text without white space at its ends."""
    iso = F.when(s.rlike(_DATE_FORMS[0][0]), s.try_cast("timestamp"))
    us_date = F.when(s.rlike(_DATE_FORMS[1][0]), F.try_to_timestamp(s, F.lit("M/d/yyyy")))
    us_time = F.when(s.rlike(_DATE_FORMS[2][0]),
                     F.coalesce(F.try_to_timestamp(s, F.lit("M/d/yyyy H:mm:ss")),
                                F.try_to_timestamp(s, F.lit("M/d/yyyy H:mm"))))
    ymd = F.when(s.rlike(_DATE_FORMS[3][0]), F.try_to_timestamp(s, F.lit("yyyy/M/d")))
    return F.coalesce(iso, us_date, us_time, ymd)
