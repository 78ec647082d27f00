from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesela.functions.timestamps import day_number, layouts, mask_of, normalise_timestamp, parse_texts, zone_tables

TABLES = zone_tables()
CASES = [
    ("45384", "day", "2024-04-02"), (" 25-09-2024 ", "day", "2024-09-25"), ("3/7/21", "day", "2021-07-03"), ("26-mar-2021", "day", "2021-03-26"), ("17 de abril de 2019", "day", "2019-04-17"),
    ("20200410", "day", "2020-04-10"), ("21.04.2022", "day", "2022-04-21"), ("2022-11-21 00:00:00", "instant", "2022-11-20T23:00:00Z"), ("2020-05-07T00:00:00+02:00", "instant", "2020-05-06T22:00:00Z"),
    ("2019-10-27 02:58:49 CET", "instant", "2019-10-27T01:58:49Z"), ("2019-10-27 02:58:49", "ambiguous", "ambiguous"), ("29/3/2020 2:51 AM", "nonexistent", "nonexistent"), ("2020-10-25 01:30:00 Atlantic/Canary", "ambiguous", "ambiguous"),
    ("1558302285956", "instant", "2019-05-19T21:44:45Z"), ("1690063200", "instant", "2023-07-22T22:00:00Z"), ("Thu, 11 Jul 2024 20:25:02 +0200", "instant", "2024-07-11T18:25:02Z"), ("2021-11-11T12:57:16-03:30", "instant", "2021-11-11T16:27:16Z"),
    ("2021-02-07T11:06:31+01:00[Europe/Madrid]", "instant", "2021-02-07T10:06:31Z"), ("15/5/2021 12:05 AM", "instant", "2021-05-14T22:05:00Z"), ("20210214T120759Z", "instant", "2021-02-14T12:07:59Z"), ("13/07/2022 22:34:59 utc", "instant", "2022-07-13T22:34:59Z"),
    ("31/02/2021", "invalid", "invalid"), ("2021-04-31T08:00:00Z", "invalid", "invalid"), ("2019-06-16T25:61:00", "invalid", "invalid"), ("22/2023", "invalid", "invalid"), ("a determinar", "invalid", "invalid"), ("No disponible", "invalid", "invalid"), ("x" * 100_000, "invalid", "invalid"), ("29/02/2023", "invalid", "invalid"), ("29/02/2024", "day", "2024-02-29"),
]


@pytest.mark.parametrize(("text", "kind", "normal"), CASES)
def test_forms(text, kind, normal):
    k, n, _, _ = parse_texts([text], TABLES)
    assert (k[0], n[0]) == (kind, normal)


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2036, 1, 1)), st.sampled_from(["Europe/Madrid", "Atlantic/Canary"]))
def test_wall_clocks_match_brute_force(t, zone):
    t = t.replace(microsecond=0)
    z = ZoneInfo(zone)
    fits = [u for u in {t.replace(tzinfo=z, fold=f).astimezone(UTC) for f in (0, 1)} if u.astimezone(z).replace(tzinfo=None) == t]
    want = "nonexistent" if not fits else "ambiguous" if len(fits) > 1 else fits[0].strftime("%Y-%m-%dT%H:%M:%SZ")
    assert parse_texts([f"{t:%Y-%m-%d %H:%M:%S} {zone}"], TABLES)[1] == [want]


@pytest.mark.parametrize("day", ["2019-03-31", "2019-10-27"])
def test_every_minute_of_the_changes(day):
    start = datetime.fromisoformat(day)
    texts = [f"{start + timedelta(minutes=i):%d/%m/%Y %H:%M}" for i in range(300)]
    kinds = parse_texts(texts, TABLES)[0]
    odd = "nonexistent" if "03-31" in day else "ambiguous"
    assert [k == odd for k in kinds] == [120 <= i < 180 for i in range(300)]


def test_mask_is_mapped_once():
    layouts.cache_clear()
    parse_texts(["2021-01-01", "2022-02-02", "2023-03-03"], TABLES)
    assert layouts.cache_info().misses == 1 and mask_of("2021-ene") == "dddd-aaa"


def test_column_with_nulls_empty_and_clashes(spark):
    df = spark.createDataFrame([(1, "2021-01-01", "x"), (2, None, "x"), (3, "  ", None), (3, "  ", None)], "id int, normal string, kind string")
    rows = df.select("id", normalise_timestamp(F.col("normal")).alias("t")).orderBy("id").collect()
    assert [r.t.normal for r in rows] == ["2021-01-01", None, None, None]
    assert df.limit(0).select(normalise_timestamp(F.col("normal"))).count() == 0


def test_years_beyond_the_tables():
    kind, normal, _, _ = parse_texts(["15/07/2500 12:00", "15/01/2500 12:00", "27/03/2438 02:30", "9999-07-01 00:00:00", "15/07/1905 12:00"], zone_tables())
    assert normal[:2] == ["2500-07-15T10:00:00Z", "2500-01-15T11:00:00Z"] and normal[3] == "9999-06-30T22:00:00Z" and kind[4] == "instant"


def test_days_alone(spark):
    texts = ["15/07/2020", "2020-07-15T23:30:00+02:00", "31/02/2020", " ", None, "29/03/2020 02:30", "1594332000", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(day_number(F.col("t")).alias("d"), normalise_timestamp(F.col("t"))["day"].alias("e")).collect()
    assert [r.d for r in got] == [r.e for r in got] and got[0].d == 18458
