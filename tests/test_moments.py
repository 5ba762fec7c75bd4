"""Moments: each notation, a brute-force reader for zones, and the defined edge cases."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from specimatrix.operators.moments import normalise_moments, read_mask, table_version, to_utc

CASES = [
    ("1993", None, "1993"), ("2017-01", None, "2017-01"), ("2000-07-06", None, "2000-07-06"), ("20000706", None, "2000-07-06"), ("2012/10/23", None, "2012-10-23"),
    ("19-May-2011", None, "2011-05-19"), ("  01-APR-2013 ", None, "2013-04-01"), ("06-FEB-2014.", None, "2014-02-06"), ("01 APR  2019", None, "2019-04-01"), ("2 May 2020", None, "2020-05-02"),
    ("8. xi. 2015", None, "2015-11-08"), ("27.viii.2015", None, "2015-08-27"), ("5-I-2003", None, "2003-01-05"), ("Mar. 2, 2010", None, "2010-03-02"), ("July 3, 1974", None, "1974-07-03"),
    ("Jul 2018", None, "2018-07"), ("December 1975", None, "1975-12"), ("Jun to Jul 2006", None, "2006-06"), ("Apr/May 1972", None, "1972-04"), ("10-11 Apr 1980", None, "1980-04-10"),
    ("2012-07-03/2012-07-04", None, "2012-07-03"), ("25-Jul-2021/27-Jul-2021", None, "2021-07-25"), ("31/12/2021", None, "2021-12-31"), ("12/31/2021", None, "2021-12-31"), ("4/4/2017", None, "2017-04-04"),
    ("01/03/2014", None, None), ("02-11-2011", None, None), ("30-Feb-1973", None, None), ("2019-00-01", None, None), ("0000-00-00", None, None), ("08-Xxx-20", None, None), ("29-Feb-2019", None, None), ("29-Feb-2020", None, "2020-02-29"),
    ("2016-07-26T13:30Z", None, "2016-07-26T13:30:00Z"), ("2014-10-07T13:26:01.999Z", None, "2014-10-07T13:26:01Z"), ("2023-03-26 05:19+02:00", None, "2023-03-26T03:19:00Z"), ("2013-07-02 15:00:37+0900", None, "2013-07-02T06:00:37Z"),
    ("2009-01-16 07:20:33-05", None, "2009-01-16T12:20:33Z"), ("2011-04-19T19:29 UTC-4", None, "2011-04-19T23:29:00Z"), ("Thu, 03 Oct 2019 01:52:08 +0530", None, "2019-10-02T20:22:08Z"), ("1201459200092", None, "2008-01-27T18:40:00Z"), ("1199533888", None, "2008-01-05T11:51:28Z"),
    ("28-Jul-2008 00h49", "Iceland", "2008-07-28T00:49:00Z"), ("2011-01-13T15:13:21", "Greece", "2011-01-13T13:13:21Z"), ("2011-01-13T15:13:21", None, None), ("2011-01-13T15:13:21", "Atlantis", None),
    ("26 Mar 2016 11:34:32pm", "Japan", "2016-03-26T14:34:32Z"), ("9 Sep 2013 12:57:26 PM", "Japan", "2013-09-09T03:57:26Z"), ("1 Apr 2010 12:40:56am", "Iceland", "2010-04-01T00:40:56Z"), ("31 Oct 2021 3:12:18 a.m.", "Iceland", "2021-10-31T03:12:18Z"),
    ("2016-10-30 02:47:25", "Italy", None), ("2016-03-27 02:30:00", "Italy", None), ("2016-10-30T02:47:25[Europe/Rome]", None, None), ("2015-03-02T07:10:55[Africa/Johannesburg]", None, "2015-03-02T05:10:55Z"), ("2010-09-26 08:47:25 Asia/Tokyo", None, "2010-09-25T23:47:25Z"),
    ("2 Mar 2021 03:24:07 CET", None, "2021-03-02T02:24:07Z"), ("28-Sep-2019 15:28 GMT", None, "2019-09-28T15:28:00Z"), ("2013-08-01 10:00:00 IST", "India", "2013-08-01T04:30:00Z"), ("2013-08-01 10:00:00 IST", None, None), ("2013-08-01 10:00:00 BST", "United Kingdom", "2013-08-01T09:00:00Z"),
    ("2020-01-01 24:00", "Iceland", None), ("13 Jan 2010 13:00:00 PM", "Iceland", None), ("Monday, 14 September 2020, 10:10:10.123 America/Argentina/Buenos_Aires", None, "2020-09-14T13:10:10Z"), ("2012-07-01 12:00 MSK", None, "2012-07-01T08:00:00Z"), ("2010-01-15 12:00 MSK", None, "2010-01-15T09:00:00Z"), ("2014-10-26 01:30 MSK", None, None), ("2013-08-01 10:00 CET", None, "2013-08-01T09:00:00Z"), ("2013-08-01 10:00 ICT", None, "2013-08-01T03:00:00Z"),
    ("2013-01-01 10:00:00 BST", "United Kingdom", "2013-01-01T09:00:00Z"), ("2014-10-07T13:26:01." + "9" * 400 + "Z", None, "2014-10-07T13:26:01Z"), ("missing", None, None), ("n/a", None, None), ("", None, None), (None, "Italy", None), ("x" * 50_000, None, None),
]
ZONES = [("Iceland", "Atlantic/Reykjavik"), ("Greece", "Europe/Athens"), ("Japan", "Asia/Tokyo"), ("Italy", "Europe/Rome"), ("India", "Asia/Kolkata"), ("United Kingdom", "Europe/London")]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, "country string, zone_name string")


def test_notations(spark, zones):
    df = spark.createDataFrame([(i, v, c, None) for i, (v, c, _) in enumerate(CASES)], "row_id bigint, collection_date string, country string, geo_loc_name string")
    got = {r.row_id: r.moment for r in normalise_moments(df, zones).collect()}
    wrong = [(v, c, m, got.get(i)) for i, (v, c, m) in enumerate(CASES) if got.get(i) != m]
    assert not wrong


def test_country_of_the_place_and_edges(spark, zones):
    schema = "row_id bigint, collection_date string, country string, geo_loc_name string, moment string, _zone string"
    df = spark.createDataFrame([(1, "2011-01-13 15:13", None, "Greece: East", "m", "z"), (1, "2011-01-13 15:13", "unknown", "greece", "m", "z"), (2, "2011-01-13 15:13", None, None, "m", "z")], schema)
    assert [tuple(r) for r in normalise_moments(df, zones).collect()] == [(1, "2011-01-13T13:13:00Z")] * 2
    assert normalise_moments(df.limit(0), zones).count() == 0
    assert normalise_moments(df, zones.limit(0)).count() == 0


def test_zone_tables_against_the_standard_library():
    rng = np.random.default_rng(3)
    for _, name in [*ZONES, ("", "America/Nassau"), ("", "Pacific/Auckland")]:
        local = np.concatenate([rng.integers(0, 1_700_000_000, 300), np.array([int(datetime(2016, 10, 30, 1, tzinfo=timezone.utc).timestamp()) + 900 * k for k in range(12)])])
        u, one = to_utc(local, name)
        for t, got, ok in zip(local, u, one):
            naive = datetime(1970, 1, 1) + timedelta(seconds=int(t))
            fits = {x.astimezone(timezone.utc).timestamp() for f in (0, 1) for x in [naive.replace(tzinfo=ZoneInfo(name), fold=f)] if x.astimezone(timezone.utc).astimezone(ZoneInfo(name)).replace(tzinfo=None) == naive}
            assert ok == (len(fits) == 1) and (not ok or fits == {float(got)})


def test_masks_without_grammar_and_version():
    assert list(read_mask("aaa", np.array(["abc"], dtype=object), np.array([None]))) == [None]
    assert table_version()
