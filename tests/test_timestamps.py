from datetime import datetime, timezone

import pytest
from conftest import ts

from evidex.operators import timestamps as P


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("raw", "zone", "locale", "want"),
    [
        ("2024-05-01T10:00:00Z", None, None, us(2024, 5, 1, 10)),
        ("\t2024-05-01t10:00:00z ", "Asia/Tokyo", None, us(2024, 5, 1, 10)),
        ("2024-05-01 10:00:00", None, None, us(2024, 5, 1, 10)),
        ("2024-05-01 10:00:00", "Europe/Berlin", None, us(2024, 5, 1, 8)),
        ("2024-05-01 10:00:00 America/Los_Angeles", "Europe/Berlin", None, us(2024, 5, 1, 17)),
        ("2024-05-01T10:00:00[Asia/Kolkata]", None, None, us(2024, 5, 1, 4, 30)),
        ("2024-05-01 10:00:00 CEST", None, None, us(2024, 5, 1, 8)),
        ("20240501T100000-0330", None, None, us(2024, 5, 1, 13, 30)),
        ("Wed, 01 May 2024 10:00:00 +0200", None, None, us(2024, 5, 1, 8)),
        ("05/01/2024 10:00 AM", None, "en-US", us(2024, 5, 1, 10)),
        ("05/01/2024, 10:00", None, "en-GB", us(2024, 1, 5, 10)),
        ("5/1/24, 12:05 AM", None, "en-US", us(2024, 5, 1, 0, 5)),
        ("1.5.24, 10:00 Uhr", None, "de-DE", us(2024, 5, 1, 10)),
        ("1. März 2024, 10:00", None, "de-DE", us(2024, 3, 1, 10)),
        ("1 août 2024 à 10:00", None, "fr-FR", us(2024, 8, 1, 10)),
        ("1 de enero de 2024, 10:00:00", None, "es-ES", us(2024, 1, 1, 10)),
        ("Apr 3, 2024, 7:48:46 PM", None, "en-US", us(2024, 4, 3, 19, 48, 46)),
        ("1714557600", None, None, us(2024, 5, 1, 10)),
        ("1714557600123", None, None, us(2024, 5, 1, 10) + 123_000),
        ("1714557600.5", None, None, us(2024, 5, 1, 10) + 500_000),
        ("2024-05-01T10:00:00.123456789Z", None, None, us(2024, 5, 1, 10) + 123_456),
        ("2024-05-01 10:00:00,25", None, None, us(2024, 5, 1, 10) + 250_000),
        ("2024-10-27 02:30:00", "Europe/Berlin", None, us(2024, 10, 27, 0, 30)),  # twice: the earlier
        ("2024-03-31 02:30:00", "Europe/Berlin", None, us(2024, 3, 31, 1, 30)),  # skipped: the offset before
        ("2024-02-30 10:15:00", None, None, None),
        ("25/12/2024 10:00 AM", None, "en-US", None),
        ("13:00 PM", None, None, None),
        ("yesterday", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
        ("0000-00-00T00:00:00Z", None, None, None),
        ("x" * 100_000, None, None, None),
    ],
)
def test_parse(raw, zone, locale, want):
    assert P.parse_instant(raw, zone, locale) == want


def test_dictionary_grows_and_resolves(spark, tmp_path):
    schema = "raw string, zone string, locale string, utc_us string"
    a = spark.createDataFrame([("1714557600", None, None, "clash")] * 3 + [("nonsense", "UTC", None, "x"), (None, None, None, "y")], schema).drop("utc_us")
    d = P.TimestampDictionary(spark, str(tmp_path / "d"))
    d.extend(a)
    assert d.table().count() == 2
    d.extend(a.unionByName(spark.createDataFrame([("1714557600", "Asia/Tokyo", None)], "raw string, zone string, locale string")))
    assert d.table().count() == 3
    again = P.TimestampDictionary(spark, str(tmp_path / "d"))
    assert again.parts == 2
    got = {(r["raw"], r["zone"]): r["utc_us"] for r in again.resolve(a).collect()}
    assert got[("1714557600", None)] == us(2024, 5, 1, 10) and got[("nonsense", "UTC")] is None and got[(None, None)] is None


def test_normalise_keeps_every_row(spark):
    m = spark.createDataFrame([("1", "2024-05-01T10:00:00.000000Z", "b", "x"), ("2", "2024-05-01 10:00:00", "b", "x"), ("3", None, None, "x"), ("4", "2024-05-01 10:00:00", "none", "x")], "id string, created_at string, batch_id string, raw string")
    b = spark.createDataFrame([("b", "Europe/Berlin", "de-DE")], "batch_id string, export_timezone string, export_locale string")
    got = {r["record_id"]: r["utc_us"] for r in P.normalise([P.message_values(m, b)]).collect()}
    assert got == {"1": us(2024, 5, 1, 10), "2": us(2024, 5, 1, 8), "3": None, "4": us(2024, 5, 1, 10)}
    assert P.normalise([P.message_values(m.limit(0), b)]).count() == 0
    assert ts is not None
