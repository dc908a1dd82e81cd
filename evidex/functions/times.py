"""Instants as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp without zone that holds UTC, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


#: ISO date and time with an offset, and epoch seconds: what exports hold where they are not damaged.
ISO, EPOCH = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$", r"^\d{9,10}(\.\d{1,6})?$"


def export_us(raw: Column) -> Column:
    """Microseconds of an instant written as ISO with an offset or as epoch seconds, else null."""
    iso = F.unix_micros(F.when(raw.rlike(ISO), raw).try_cast("timestamp"))
    return F.coalesce(iso, (F.when(raw.rlike(EPOCH), raw).cast("decimal(20,6)") * 1_000_000).cast("long"))
