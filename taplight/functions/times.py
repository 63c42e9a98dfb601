"""Times as texts: UTC with or without fractions, and exact decimals that Spark's microseconds can't hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000_000
#: Seconds of the first and last instants of the years 1 to 9999.
_FIRST, _LAST = -62_135_596_800, 253_402_300_799


def iso(ts_us: Column) -> Column:
    """UTC text of microseconds since the epoch; a fraction of six digits where there is one."""
    fraction = F.pmod(ts_us, F.lit(1_000_000))
    head = F.date_format(F.timestamp_seconds(((ts_us - fraction) / 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def epoch_us(text: Column) -> Column:
    """Microseconds since the epoch of a time with a zone; null for one without, or for no time."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.unix_micros(F.try_to_timestamp(F.when(zoned, text))))


def nanoseconds(decimal: Column) -> Column:
    """Exact nanoseconds of plain decimal seconds; null for another text or for digits beyond nanoseconds."""
    pattern = r"^([+-]?)(\d{1,12})(?:\.(\d+))?$"
    part = lambda i: F.regexp_extract(decimal, pattern, i)
    fraction = F.rpad(F.substring(part(3), 1, 9), 9, "0")
    total = part(2).cast("decimal(30,0)") * _SECOND + fraction.cast("decimal(30,0)")
    exact = decimal.rlike(pattern) & (F.regexp_replace(F.substring(part(3), 10, 1000), "0", "") == "")
    return F.when(exact, F.when(part(1) == "-", -total).otherwise(total).cast("decimal(30,0)"))


def utc(total_ns: Column) -> Column:
    """UTC text of nanoseconds, with 0, 3, 6 or 9 digits as they are needed; null outside the years 1 to 9999."""
    nanos = F.pmod(total_ns, F.lit(_SECOND).cast("decimal(30,0)")).cast("long")
    seconds = ((total_ns - nanos) / _SECOND).cast("long")
    digits = F.lpad(nanos.cast("string"), 9, "0")
    fraction = F.when(nanos == 0, "").when(nanos % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3))).when(nanos % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6))).otherwise(F.concat(F.lit("."), digits))
    text = F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    return F.when(seconds.between(_FIRST, _LAST), text)


def decimal_utc(start: Column, duration: Column | None = None) -> Column:
    """UTC text of decimal seconds, or of their end after a duration, which must not be below zero."""
    if duration is None:
        return utc(nanoseconds(start))
    length = nanoseconds(duration)
    return F.when(length >= 0, utc(nanoseconds(start) + length))
