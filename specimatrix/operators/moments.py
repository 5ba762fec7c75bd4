"""Mixed date and time notations to one unambiguous form.

Each value is reduced to a shape mask of character classes. A mask decides the grammar, and with it at which positions
the digits and words stand, once; all values of a mask are then read together as a matrix of code points. Local times
pass through transition tables of the time zone database, whose version is recorded.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimatrix.functions.text import placeholder, strip
from specimatrix.session import bounded

# Abbreviations of world time, and those that one zone stands for, with their hours wherever that zone does
# not use them at the time in question.
WORLD = ("z", "utc", "gmt", "ut")
SURE_ZONES = {"wet": ("Europe/Lisbon", 0), "west": ("Europe/Lisbon", 1), "cet": ("Europe/Berlin", 1), "cest": ("Europe/Berlin", 2), "eet": ("Europe/Helsinki", 2), "eest": ("Europe/Helsinki", 3), "msk": ("Europe/Moscow", 3), "sast": ("Africa/Johannesburg", 2), "ict": ("Asia/Bangkok", 7), "jst": ("Asia/Tokyo", 9), "kst": ("Asia/Seoul", 9), "nzst": ("Pacific/Auckland", 12), "nzdt": ("Pacific/Auckland", 13), "akst": ("America/Anchorage", -9), "akdt": ("America/Anchorage", -8), "hst": ("Pacific/Honolulu", -10)}

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
MONTH_OF = {m[:k]: i for i, m in enumerate(MONTHS, 1) for k in (3, len(m))} | {"sept": 9} | {r: i for i, r in enumerate(ROMAN, 1)}

_ZONE = r"(?P<z> ?a{1,5}|(?P<osign> ?(?:aaa|aa)?[+-])(?P<oh>9{1,2})(?::?(?P<om>99))?| a+(?:[/_+-][a9]+)+|\[a+(?:[/_+-][a9]+)+\])"
_TIME = r"(?P<H>9{1,2})[:a](?P<M>99)(?::(?P<S>99)(?:[.,]9+)?)?"
#: Grammars over masks (digit -> 9, letter -> a). The first that covers the whole mask holds; groups name positions.
GRAMMARS = [
    ("date", r"(?P<y>9999)"),
    ("date", r"(?P<y>9999)-(?P<m>99)"),
    ("date", r"(?P<y>9999)(?P<sep>[-/.])(?P<m>9{1,2})(?P=sep)(?P<d>9{1,2})"),
    ("date", r"(?P<y>9999)(?P<m>99)(?P<d>99)"),
    ("epoch", r"(?P<n>9{9,14})"),
    ("date", r"(?P<d>9{1,2})[-. /]{1,2}(?P<w>a{1,9})[-. /]{1,2}(?P<y>9999)"),
    ("date", r"(?P<w>a{3,9})\.? (?P<d>9{1,2}),? (?P<y>9999)"),
    ("date", r"(?P<w>a{3,9})\.?[- ](?P<y>9999)"),
    ("date", r"(?P<w>a{3,9})\.?(?:-|/| - | aa )(?P<w2>a{3,9})\.? (?P<y>9999)"),
    ("date", r"(?P<d>9{1,2}) ?- ?(?P<d2>9{1,2}) (?P<w>a{3,9})\.? (?P<y>9999)"),
    ("date", r"(?P<y>9999)-(?P<m>99)-(?P<d>99)/(?P<y2>9999)-(?P<m2>99)-(?P<d2>99)"),
    ("date", r"(?P<d>9{1,2})[- ](?P<w>a{3,9})[- ](?P<y>9999)/(?P<d2>9{1,2})[- ](?P<w2>a{3,9})[- ](?P<y2>9999)"),
    ("either", r"(?P<d>9{1,2})(?P<sep>[-/.])(?P<m>9{1,2})(?P=sep)(?P<y>9999)"),
    ("time", rf"(?P<y>9999)-(?P<m>99)-(?P<d>99)(?:a|,? ){_TIME}(?:{_ZONE})?"),
    ("time", rf"(?:a{{3,9}},? )?(?P<d>9{{1,2}})[- ](?P<w>a{{3,9}})[- ](?P<y>9999),? {_TIME}(?: ?(?P<ap>a\.?a\.?)|{_ZONE})?"),
]


def grammar(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """How values of this shape are read: the kind and the position of each part. Long masks are not remembered."""
    return _remembered(mask) if len(mask) <= 200 else _grammar(mask)


def _grammar(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    for kind, pattern in GRAMMARS:
        if hit := re.fullmatch(pattern, mask):
            return kind, {k: hit.span(k) for k, v in hit.groupdict().items() if v is not None and k != "sep"}
    return None


_remembered = lru_cache(maxsize=65536)(_grammar)


def table_version() -> str:
    """Version of the time zone database behind the transition tables."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """UTC seconds at which ``zone`` changes its offset or name (1900 to 2100), the offsets between, and the names."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(zone)
    except Exception:
        return None
    utc = timezone.utc

    def at(s: int) -> tuple[int, str]:
        t = (datetime(1970, 1, 1, tzinfo=utc) + timedelta(seconds=s)).astimezone(z)
        return int(t.utcoffset().total_seconds()), t.tzname()

    step, first, last = 10 * 86400, -2208988800, 4102444800
    before = at(first)
    when, offsets, names = [], [before[0]], [before[1].lower()]
    for s in range(first + step, last, step):
        now = at(s)
        if now != before:
            low, high = s - step, s
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if at(mid) == before else (low, mid)
            when.append(high)
            offsets.append(now[0])
            names.append(now[1].lower())
        before = now
    return np.array(when, dtype=np.int64), np.array(offsets, dtype=np.int64), np.array(names, dtype=object)


def named_utc(local: np.ndarray, zone: str | None, name: str, hours: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local ones that carry an abbreviation of ``zone``, and which have exactly one.

    The abbreviation means what it meant at that time (since 1970). Where it was not in use then, as winter time in
    summer, it means ``hours``, or what it meant in the zone last before, else first; unknown ones have no reading.
    """
    table = transitions(zone) if zone is not None else None
    none = np.zeros(len(local), dtype=bool)
    if table is None:
        return (local, none) if hours is None else (local - hours * 3600, ~none)
    when, offsets, names = table
    used = (names == name) & (np.r_[when, np.iinfo(np.int64).max] > 0)
    if not used.any():
        return (local, none) if hours is None else (local - hours * 3600, ~none)
    found, result = np.zeros(len(local), dtype=np.int64), np.zeros(len(local), dtype=np.int64)
    for o in np.unique(offsets[used]):
        at = np.searchsorted(when, local - o, side="right")
        fits = used[at] & (offsets[at] == o)
        found += fits
        result = np.where(fits, local - o, result)
    if hours is None:
        segments = np.flatnonzero(used)
        starts = np.r_[np.iinfo(np.int64).min, when][segments]
        last = np.maximum(np.searchsorted(starts, local - offsets[segments[0]], side="right") - 1, 0)
        usual = offsets[segments[last]]
    else:
        usual = hours * 3600
    return np.where(found == 0, local - usual, result), found <= 1


def to_utc(local: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local ones, and which have exactly one: not those skipped or repeated when clocks change."""
    table = transitions(zone)
    if table is None:
        return local, np.zeros(len(local), dtype=bool)
    when, offsets, _ = table
    found, result = np.zeros(len(local), dtype=np.int64), np.zeros(len(local), dtype=np.int64)
    for o in np.unique(offsets):
        u = local - o
        fits = offsets[np.searchsorted(when, u, side="right")] == o
        found += fits
        result = np.where(fits, u, result)
    return result, found == 1


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (codes[:, i].astype(np.int64) - 48)
    return out


def _words(texts: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.array([t[span[0] : span[1]] for t in texts], dtype=object).astype(str), return_inverse=True)


def _month(texts: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    words, at = _words(texts, span)
    return np.array([MONTH_OF.get(w, 0) for w in words], dtype=np.int64)[at]


def _real_day(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    mm = np.clip(m, 1, 12)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[mm - 1] + ((mm == 2) & leap)
    return ok & (d <= last)


def _seconds(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    months = (np.clip(y, 1, 9999) - 1970) * 12 + np.clip(m, 1, 12) - 1
    return (months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + np.clip(d, 1, 31) - 1) * 86400


def read_mask(mask: str, texts: np.ndarray, zones: np.ndarray) -> np.ndarray:
    """The moments of all ``texts`` of one mask; None where there is no or more than one reading."""
    out = np.full(len(texts), None, dtype=object)
    if (g := grammar(mask)) is None:
        return out
    kind, at = g
    codes = np.array(texts, dtype=f"U{len(mask)}").view(np.uint32).reshape(len(texts), len(mask))
    if kind == "epoch":
        n = _number(codes, at["n"])
        u = n if len(mask) <= 11 else n // 1000
        out[:] = np.char.add(u.astype("datetime64[s]").astype(str), "Z")
        return out
    y, one = _number(codes, at["y"]), np.ones(len(texts), dtype=np.int64)
    m = _month(texts, at["w"]) if "w" in at else _number(codes, at["m"]) if "m" in at else one
    d = _number(codes, at["d"]) if "d" in at else one
    good = _real_day(y, m, d)
    if kind == "either":  # day first or month first
        other = _real_day(y, d, m)
        good, m, d = (good ^ other) | (good & (d == m)), np.where(good, m, d), np.where(good, d, m)
    if "w2" in at and "d" not in at:  # months of one year, in order
        m2 = _month(texts, at["w2"])
        good &= (m2 >= m) & (m2 > 0)
    elif "d2" in at:
        m2 = _month(texts, at["w2"]) if "w2" in at else _number(codes, at["m2"]) if "m2" in at else m
        y2 = _number(codes, at["y2"]) if "y2" in at else y
        d2 = _number(codes, at["d2"])
        good &= _real_day(y2, m2, d2) & (_seconds(y2, m2, d2) >= _seconds(y, m, d))
    if kind != "time":
        days = _seconds(y, m, d).astype("datetime64[s]").astype(str)
        cut = 10 if "d" in at else 7 if "m" in at or "w" in at else 4
        out[good] = np.array([s[:cut] for s in days[good]], dtype=object)
        return out
    H, M = _number(codes, at["H"]), _number(codes, at["M"])
    S = _number(codes, at["S"]) if "S" in at else np.zeros_like(H)
    zone = at.get("z")
    if "ap" in at or (zone and zone[1] - zone[0] <= 3 and mask[zone[0] : zone[1]].strip() == "aa"):
        words, k = _words(texts, at["ap"] if "ap" in at else zone)
        half = np.array([{"am": 0, "pm": 12}.get(w.strip().replace(".", ""), -1) for w in words])[k]
        good &= (half >= 0) & (H >= 1) & (H <= 12)
        H = H % 12 + np.maximum(half, 0)
        if "ap" not in at:
            zone = None
    good &= (H < 24) & (M < 60) & (S < 60)
    local = _seconds(y, m, d) + H * 3600 + M * 60 + S
    u = np.zeros_like(local)
    if zone and "oh" in at:
        sign, k = _words(texts, at["osign"])
        known = np.array([re.sub("[ +-]", "", w) in ("", "utc", "gmt", "ut") for w in sign])[k]
        sign = np.array([-1 if w.endswith("-") else 1 for w in sign])[k]
        oh, om = _number(codes, at["oh"]), _number(codes, at["om"]) if "om" in at else 0
        good &= known & (oh <= 14) & (np.asarray(om) < 60)
        u = local - sign * (oh * 3600 + om * 60)
    elif zone:
        words, k = _words(texts, zone)
        for i, w in enumerate(words):
            here, w = k == i, w.strip(" []")
            if "/" in w:
                u[here], ok = to_utc(local[here], _zone_name(w))
                good[here] &= ok
            elif w in WORLD:
                u[here] = local[here]
            elif w in SURE_ZONES:
                u[here], ok = named_utc(local[here], SURE_ZONES[w][0], w, SURE_ZONES[w][1])
                good[here] &= ok
            else:  # the country decides which of the zones with this abbreviation is meant
                for z in pd.unique(zones[here]):
                    both = here & (zones == z) if z is not None else here & pd.isna(zones)
                    u[both], ok = named_utc(local[both], z, w)
                    good[both] &= ok
    else:
        good &= ~pd.isna(zones)
        for z in {z for z in zones if z is not None}:
            here = zones == z
            u[here], ok = to_utc(local[here], z)
            good[here] &= ok
    out[good] = np.char.add(u[good].astype("datetime64[s]").astype(str), "Z")
    return out


def _zone_name(w: str) -> str:
    """``europe/oslo`` in the spelling of the time zone database."""
    return _zone_names().get(w.lower(), w)


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    from zoneinfo import available_timezones

    return {z.lower(): z for z in available_timezones()}


def _batches(frames):
    for f in frames:
        texts, masks, zones = f["_text"].to_numpy(object), f["_mask"], f["_zone"].to_numpy(object)
        zones = np.where(pd.isna(zones), None, zones)
        result = np.full(len(f), None, dtype=object)
        for mask, rows in masks.groupby(masks, sort=False).indices.items():
            result[rows] = read_mask(mask, texts[rows], zones[rows])
        f = pd.DataFrame({"row_id": f["row_id"], "moment": result})
        if (read := f["moment"].notna()).any():
            yield f[read]


def cleaned(c: Column) -> Column:
    """Lower case, trimmed, inner white space single, no full stop at the end of a four-digit year."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " "), r"(?<=\d{4})\.$", "")


def mask(c: Column) -> Column:
    """Digits as 9, letters as a; everything else stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "a"), r"[0-9]", "9")


def normalise_moments(df: DataFrame, country_zone: DataFrame, row_id: str = "row_id", value: str = "collection_date", country: str = "country", place: str = "geo_loc_name") -> DataFrame:
    """Rows of ``df`` whose ``value`` has exactly one valid reading: (row_id, moment).

    ``moment`` is YYYY, YYYY-MM or YYYY-MM-DD as precise as the value, or the UTC moment YYYY-MM-DDTHH:MM:SSZ. Times
    without zone are local in the zone of ``country``, else of the country before the colon of ``place``. Null, blank,
    placeholder, impossible and ambiguous values (day or month first, a local time that clocks repeat or skip) give no
    row. Repeated rows each give theirs; other columns of ``df`` are not used, so clashing names do no harm. Texts of any
    length are read if a grammar covers their mask. An empty table gives an empty result. The version of the zone tables
    stands in the column's metadata.
    """
    named = lambda c: F.lower(strip(c))
    zone = bounded(country_zone.select(named(F.col("country")).alias("_country"), F.col("zone_name").alias("_zone")).dropna().dropDuplicates(["_country"]))
    own = F.when(~placeholder(F.col(country)), named(F.col(country)))
    there = named(F.substring_index(F.col(place), ":", 1))
    shaped = df.where(~placeholder(F.col(value))).select(F.col(row_id).alias("row_id"), cleaned(F.col(value)).alias("_text"), F.coalesce(own, there).alias("_country"))
    shaped = shaped.withColumn("_mask", mask(F.col("_text")))
    found = shaped.join(zone, "_country", "left").select("row_id", "_text", "_mask", "_zone").mapInPandas(_batches, "row_id bigint, moment string")
    return found.select("row_id", F.col("moment").alias("moment", metadata={"zone_tables": table_version()}))
