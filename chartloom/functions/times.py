"""Time expressions that give the same instant in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_micros(c: Column) -> Column:
    """Microseconds since the epoch of an ISO-like string; without an offset it is UTC; null where it can't be read.

    Read are date, date and time with 'T' or blank, compact date and time, each with 'Z', '+hh:mm' or no offset.
    """
    s = F.trim(c)
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    s = F.when(s.rlike(r"T|\d{2} \d{2}:"), F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z"))))
    return F.unix_micros(s.try_cast("timestamp"))


def ntz_micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.concat(c.cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp"))


def utc_month(micros: Column) -> Column:
    """'YYYY-MM' in UTC of microseconds since the epoch."""
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")
