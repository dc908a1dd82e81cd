"""P4: mixed timestamp formats and time zones.

Raw strings are reduced to a dictionary of distinct (raw, zone, locale)
entries, each parsed once in an Arrow batch; the dictionary is a table that
later feeds only extend, and instants are joined back to the rows.

Edge cases: null, blank and unreadable values, and values that are no real
date or time, have a null instant. A null zone means UTC. A null locale reads
the day first. Repeated rows share one entry; an empty table gives no rows.
Values written exactly as YYYY-MM-DDThh:mm:ss.ffffffZ are read by a built-in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.session import scratch_path

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"

# Zone abbreviations as minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "brst": -120, "art": -180, "nst": -210, "ndt": -150,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Month names, one line per month (en, de, fr, es, it, pt, nl).
MONTHS = [
    "january jan januar jänner janvier janv enero ene gennaio gen janeiro januari",
    "february feb februar février févr fevr febrero febbraio fevereiro fev februari",
    "march mar märz mrz mars marzo março maart mrt",
    "april apr avril avr abril abr aprile",
    "may mai mayo maggio mag maio mei",
    "june jun juni juin junio giugno giu junho",
    "july jul juli juillet juil julio luglio lug julho",
    "august aug août aout agosto ago augustus",
    "september sep sept septembre septiembre settembre set setembro",
    "october oct oktober okt octobre octubre ottobre ott outubro out",
    "november nov novembre noviembre novembro",
    "december dec dezember dez décembre déc diciembre dic dicembre dezembro december",
]
MONTH = {name: k for k, line in enumerate(MONTHS, 1) for name in line.split()}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\b\.?)?(?:\s*(?:uhr|h)\b)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?))?(?:\s*(?P<abbr>[a-z]{1,5})(?![\w/]))?(?:\s*\[?(?P<zone>[a-z_]+(?:/[a-z_+\-0-9]+)+|\[[a-z]+\])\]?)?"
_WORD = r"[^\W\d_]+"
_FORMS = [
    re.compile(r, re.IGNORECASE)
    for r in (
        rf"(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})(?:t|\s+){_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?(?P<ap>(?!))?{_ZONE}",
        rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}",
        rf"(?:{_WORD}\.?,?\s+)?(?P<d>\d{{1,2}})\.?\s+(?:de\s+|di\s+)?(?P<mon>{_WORD})\.?\s+(?:de\s+|del\s+)?(?P<y>\d{{4}}),?\s+(?:à\s+|at\s+|um\s+|a las\s+|às\s+|alle\s+|om\s+)?{_TIME}{_ZONE}",
        rf"(?:{_WORD}\.?,\s+)?(?P<mon>{_WORD})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{_TIME}{_ZONE}",
    )
]
_EPOCH = re.compile(r"(\d{9,10})(?:[.,](\d+))?|(\d{12,13})|(\d{15,16})|(\d{18,19})")
_EPOCH_0 = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name or "UTC")
    except Exception:
        return None


def parse_instant(raw: str | None, zone: str | None, locale: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None."""
    if raw is None:
        return None
    text = raw.strip()
    if not text or not any(c.isdigit() for c in text):
        return None
    if m := _EPOCH.fullmatch(text):
        sec, frac, ms, us, ns = m.groups()
        if sec:
            return int(sec) * 1_000_000 + int(((frac or "") + "000000")[:6])
        return int(ms) * 1000 if ms else int(us) if us else int(ns) // 1000
    for form in _FORMS:
        m = form.fullmatch(text)
        if m:
            break
    else:
        return None
    g = m.groupdict()
    year = int(g["y"])
    if len(g["y"]) == 2:
        year += 2000 if year < 70 else 1900
    if g.get("mon"):
        month, day = MONTH.get(g["mon"].lower()), int(g["d"])
        if month is None:
            return None
    elif g.get("a"):
        a, b = int(g["a"]), int(g["b"])
        month, day = (a, b) if g["sep"] != "." and (locale or "").lower().replace("_", "-") == "en-us" else (b, a)
    else:
        month, day = int(g["m"]), int(g["d"])
    hour = int(g["h"])
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"].lower() == "p" else 0)
    try:
        local = datetime(year, month, day, hour, int(g["mi"]), int(g["s"] or 0))
    except ValueError:
        return None
    micro = int(((g["f"] or "") + "000000")[:6])
    if off := g["off"]:
        hh, mm = int(off[1:3]), int(off[-2:]) if len(off) > 3 else 0
        if hh > 18 or mm > 59:
            return None
        east = timedelta(minutes=(hh * 60 + mm) * (-1 if off[0] == "-" else 1))
    elif g["abbr"]:
        if g["abbr"].lower() not in ABBREVIATIONS:
            return None
        east = timedelta(minutes=ABBREVIATIONS[g["abbr"].lower()])
    else:
        named = g["zone"] and g["zone"].strip("[]")
        tz = _zone(named or zone)
        if tz is None:
            return None
        try:  # fold=0: the earlier of two instants; in a gap the offset before the change
            east = local.replace(tzinfo=tz).utcoffset() or timedelta()
        except (OverflowError, ValueError):
            return None
    delta = local - _EPOCH_0 - east
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + micro


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        none = [None if x is None or x != x else x for x in b["zone"]], [None if x is None or x != x else x for x in b["locale"]]
        utc = [parse_instant(r, z, loc) for r, z, loc in zip(b["raw"], *none)]
        yield pd.DataFrame({"raw": b["raw"], "zone": b["zone"], "locale": b["locale"], "utc_us": pd.array(utc, dtype="Int64")})


ENTRY = "raw string, zone string, locale string, utc_us bigint"


class TimestampDictionary:
    """A growing table of parsed raw values below path; only values not yet in it are parsed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.parts = spark, path or scratch_path(spark, "instants"), 0
        if path:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            home = jvm.org.apache.hadoop.fs.Path(path)
            fs = home.getFileSystem(conf)
            if fs.exists(home):
                self.parts = max([0, *(int(s.getPath().getName().split("-")[1]) + 1 for s in fs.listStatus(home) if s.getPath().getName().startswith("part-"))])

    def table(self) -> DataFrame | None:
        """All entries so far; None before the first."""
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/part-{k}" for k in range(self.parts)]) if self.parts else None

    def extend(self, values: DataFrame) -> None:
        """Parse the distinct (raw, zone, locale) of values that the table lacks and append them."""
        fresh = values.select("raw", "zone", "locale").where(F.col("raw").isNotNull()).distinct()
        if (known := self.table()) is not None:
            k = known.select(*(F.col(c).alias(f"k_{c}") for c in ("raw", "zone", "locale")))
            same = (F.col("raw") == F.col("k_raw")) & F.col("zone").eqNullSafe(F.col("k_zone")) & F.col("locale").eqNullSafe(F.col("k_locale"))
            fresh = fresh.join(k, same, "left_anti")
        fresh.mapInPandas(_parse_batches, ENTRY).write.parquet(f"{self.path}/part-{self.parts}")
        self.parts += 1

    def resolve(self, rows: DataFrame) -> DataFrame:
        """rows (raw, zone, locale and others) with utc_us; every raw value must be in the table."""
        d = self.table().select(*(F.col(c).alias(f"k_{c}") for c in ("raw", "zone", "locale")), "utc_us")
        same = (F.col("raw") == F.col("k_raw")) & F.col("zone").eqNullSafe(F.col("k_zone")) & F.col("locale").eqNullSafe(F.col("k_locale"))
        return rows.join(d, same, "left").drop("k_raw", "k_zone", "k_locale")


def message_values(messages: DataFrame, batches: DataFrame) -> DataFrame:
    """record_id, raw, zone, locale of messages; zone and locale are those of the row's batch (one row per batch)."""
    b = batches.groupBy(F.col("batch_id").alias("b_id")).agg(F.max("export_timezone").alias("zone"), F.max("export_locale").alias("locale"))
    return messages.select("id", "created_at", "batch_id").join(b, F.col("batch_id") == F.col("b_id"), "left").select(
        F.lit("messages").alias("record_table"), F.col("id").alias("record_id"), F.col("created_at").alias("raw"), "zone", "locale"
    )


def corpus_values(corpus: DataFrame) -> DataFrame:
    """record_id, raw, zone, locale of corpus rows."""
    return corpus.select(
        F.lit("corpus_rows").alias("record_table"), F.col("item_id").alias("record_id"), F.col("observed_at").alias("raw"),
        F.col("export_timezone").alias("zone"), F.lit(None).cast("string").alias("locale"),
    )


def normalise(feeds: list[DataFrame], path: str | None = None, skip_canonical: bool = False) -> DataFrame:
    """record_table, record_id, utc_us for every row of the feeds; canonical values are left out on request."""
    entries = TimestampDictionary(feeds[0].sparkSession, path)
    out = None
    for feed in feeds:
        canonical = F.col("raw").rlike(CANONICAL)
        odd = feed.where(F.col("raw").isNotNull() & ~canonical)
        entries.extend(odd)
    for feed in feeds:
        canonical = F.col("raw").rlike(CANONICAL)
        one = entries.resolve(feed.where(F.col("raw").isNotNull() & ~canonical)).select("record_table", "record_id", "utc_us")
        if not skip_canonical:
            plain = feed.where(F.col("raw").isNull() | canonical).select(
                "record_table", "record_id", F.unix_micros(F.col("raw").try_cast("timestamp")).alias("utc_us")  # it names its zone
            )
            one = one.unionByName(plain)
        out = one if out is None else out.unionByName(one)
    return out
