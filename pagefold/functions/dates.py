"""Column expressions for PDF and ISO dates: parts with optional precision, not instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PDF = r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:([+-Zz])(?:([0-9]{2})'?(?:([0-9]{2})'?)?)?)?$"
ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?)?(?:([+-Zz])(?:([0-9]{2}):?([0-9]{2})?)?)?$"
NAMES = ("year", "month", "day", "hour", "minute", "second")


def date_parts(text: Column) -> Column:
    """A struct of year to second and zone minutes, as far as they are given; null if it is no date."""
    plain = F.trim(text)
    legacy = plain.startswith("D:") | (plain.rlike("^[0-9]{4}") & ~F.contains(plain, F.lit("-"))) | plain.rlike(r"^[0-9]{8,}-")
    pattern = [PDF.replace("[+-Zz]", "[-+Zz]"), ISO.replace("[+-Zz]", "[-+Zz]")]

    def group(k: int) -> Column:
        found = F.when(legacy, F.regexp_extract(plain, pattern[0], k)).otherwise(F.regexp_extract(plain, pattern[1], k))
        return F.when(found != "", found)

    sign = group(7)
    zone = F.when(F.upper(sign) == "Z", 0).when(sign.isNotNull(), F.when(sign == "-", -1).otherwise(1) * (F.coalesce(group(8).cast("int"), F.lit(0)) * 60 + F.coalesce(group(9).cast("int"), F.lit(0))))
    parts = F.struct(*(group(k).cast("int").alias(n) for k, n in enumerate(NAMES, 1)), zone.cast("int").alias("zone"))
    return F.when(F.when(legacy, plain.rlike(pattern[0])).otherwise(plain.rlike(pattern[1])), parts)


def same_date(a: Column, b: Column) -> Column:
    """Two spellings of one date: equal parts, zone included. Text that is no date is compared as text."""
    pa, pb = date_parts(a), date_parts(b)
    return F.when(pa.isNotNull() & pb.isNotNull(), pa.eqNullSafe(pb)).otherwise(a.eqNullSafe(b))


def date_instant(text: Column) -> Column:
    """The instant of a date that is complete to the second; a missing zone is UTC."""
    p = date_parts(text)
    local = F.make_timestamp(p["year"], p["month"], p["day"], p["hour"], p["minute"], p["second"], F.lit("UTC"))
    return F.when(p["second"].isNotNull(), local - F.make_interval(mins=F.coalesce(p["zone"], F.lit(0))))


def pdf_date(instant: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(instant, "yyyyMMddHHmmss"), F.lit("+00'00'"))
