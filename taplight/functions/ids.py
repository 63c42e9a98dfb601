"""Deterministic record identifiers, as Spark expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of this library's record identifiers.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "records.taplight.invalid")


def record_id(namespace: uuid.UUID, *parts: Column | str) -> Column:
    """A version 5 UUID over parts that each have their length before them; null parts are empty."""
    cols = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    name = F.concat(*(x for c in cols for x in (F.char_length(c).cast("string"), F.lit(":"), c)))
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    return _uuid(h)


def _uuid(h: Column) -> Column:
    """A version 5 UUID's text from the hexadecimal digits of its digest."""
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _components(parts: tuple[Column, ...]) -> Column:
    """Parts in UTF-8, each with its length in four bytes before it; null parts are empty."""
    utf8 = [F.encode(F.coalesce(p.cast("string"), F.lit("")), "utf-8") for p in parts]
    return F.concat(*(x for b in utf8 for x in (F.unhex(F.lpad(F.hex(F.octet_length(b)), 8, "0")), b)))


def observation_id(namespace: uuid.UUID, *parts: Column) -> Column:
    """A version 5 UUID over parts with binary lengths.  Whoever has identifiers of another system to meet passes its
    namespace, and its marker as the first part."""
    return _uuid(F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), _components(parts))))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over parts with binary lengths."""
    return F.sha2(_components(parts), 256)
