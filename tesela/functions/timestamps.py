"""Mixed timestamp texts to one unambiguous form.

Each text is turned into a shape mask (digits ``d``, letters ``a``, everything else itself). A mask
is mapped to a layout once per Python worker; all texts of one mask in an Arrow batch are then
converted together with NumPy, wall clocks through transition tables of the zones concerned. The
tables carry the version of the zone database they were made from and travel with the task, so
every executor converts alike.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_ZONE = "Europe/Madrid"
#: Zones whose names may stand in a text, as tables.
ZONES = (HOME_ZONE, "Atlantic/Canary", "UTC")
#: Years of the tables. Later ones are read one or more cycles of the calendar (400 years) earlier, which have the same weekdays.
FIRST_YEAR, LAST_YEAR = 1900, 2437
CYCLE = 146_097 * 86_400
#: No layout, with the longest zone name, has as many characters.
LONGEST = 64
EPOCH = dt.date(1970, 1, 1)

# fixed values: month names and zone abbreviations that occur in the texts
MONTHS = {
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "sept": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "jan": 1, "apr": 4, "aug": 8, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "cet": 3600, "cest": 7200}
DAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "lun", "mar", "mié", "mie", "jue", "vie", "sáb", "sab", "dom"}

DAY, INSTANT, AMBIGUOUS, NONEXISTENT, INVALID = "day", "instant", "ambiguous", "nonexistent", "invalid"
SCHEMA = "struct<kind:string,normal:string,instant_us:bigint,day:int>"


def zone_version() -> str:
    """Version of the zone database the tables are made from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        for p in ("/usr/share/zoneinfo/tzdata.zi", "/usr/share/zoneinfo/+VERSION"):
            if Path(p).exists():
                return Path(p).read_text(errors="replace").split("\n")[0].replace("# version ", "").strip()
        return "unknown"


@lru_cache
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of each change and the offsets: offset[i] holds before change i, offset[-1] after the last."""
    z, at, offsets = ZoneInfo(zone), [], []
    utc = dt.UTC

    def offset(s: int) -> int:
        return int(dt.datetime.fromtimestamp(s, utc).astimezone(z).utcoffset().total_seconds())

    start = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc).timestamp())
    end = int(dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=utc).timestamp())
    step, s = 7 * 86400, start
    offsets.append(offset(s))
    while s < end:
        t = s + step
        if offset(t) != offset(s):
            lo, hi = s, t
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offset(s) else (lo, mid)
            at.append(hi)
            offsets.append(offset(hi))
        s = t
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def zone_tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {z.lower(): transitions(z) for z in ZONES}


def from_wall(wall: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wall-clock seconds to UTC seconds, and 0 where there is one instant, 1 where two, 2 where none."""
    end = int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.UTC).timestamp())
    cycles = np.where(wall >= end, (wall - end) // CYCLE + 1, 0) * CYCLE
    wall = wall - cycles
    fits, utc = np.zeros(len(wall), dtype=np.int64), np.zeros(len(wall), dtype=np.int64)
    seen: list[np.ndarray] = []
    near = np.searchsorted(at, wall)
    for shift in (-1, 0, 1):
        i = np.clip(near + shift, 0, len(offsets) - 1)
        t = wall - offsets[i]
        ok = np.searchsorted(at, t, side="right") == i
        for s in seen:
            ok &= s != i
        seen.append(i)
        fits += ok
        utc = np.where(ok & (fits == 1), t, utc)
    return utc + cycles, np.where(fits == 1, 0, np.where(fits > 1, 1, 2))


@dataclass(frozen=True)
class Layout:
    """Slices of the parts in every text of one mask."""

    kind: str  # calendar, serial, epoch
    parts: tuple[tuple[str, int, int], ...] = ()
    clock: bool = False


_DATES = (
    r"(?P<y>d{4})(?P<s1>[-/.])(?P<m>dd?)(?P=s1)(?P<d>dd?)",
    r"(?P<y>d{4})(?P<m>dd)(?P<d>dd)",
    r"(?P<d>dd?)(?P<s1>[-/.])(?P<m>dd?)(?P=s1)(?P<y>d{4}|dd)",
    r"(?P<d>dd?)(?P<s1>[-/. ])(?P<mon>a{3,10})\.?(?P=s1)(?P<y>d{4}|dd)",
    r"(?P<d>dd?) (?P<de1>aa) (?P<mon>a{3,10}) (?P<de2>aa)l? (?P<y>d{4})",
    r"(?P<dow>aaa),? (?P<d>dd?) (?P<mon>a{3,10}) (?P<y>d{4})",
)
_CLOCKS = (r"(?:(?P<t>a)| |, |,)(?P<H>dd?):(?P<M>dd)(?::(?P<S>dd)(?:[.,](?P<f>d{1,9}))?)?", r"(?P<t>a)(?P<H>dd)(?P<M>dd)(?:(?P<S>dd)(?:[.,](?P<f>d{1,9}))?)?")
_ZONES = (r"", r" ?(?P<z>a{1,4})", r" ?(?P<sign>[+-])(?P<oh>dd):?(?P<om>dd)(?:\[(?P<zn2>a+(?:[/_]a+)+)\])?", r" ?(?P<sign>[+-])(?P<oh>dd)", r" ?\[?(?P<zn>a+(?:[/_]a+)+)\]?", r" ?(?P<ap>a\.?a\.?)")


@lru_cache(maxsize=None)
def _patterns() -> list[tuple[re.Pattern, bool]]:
    found = [(re.compile(d), False) for d in _DATES]
    for d in _DATES:
        for c in _CLOCKS:
            found += [(re.compile(d + c + z), True) for z in _ZONES]
    return found


@lru_cache(maxsize=4096)
def layouts(mask: str) -> tuple[Layout, ...]:
    """Every layout that a mask may have; found once for a mask and kept in the worker."""
    found = []
    if re.fullmatch("d{5}", mask):
        found.append(Layout("serial"))
    if re.fullmatch("d{10}|d{13}", mask):
        found.append(Layout("epoch"))
    for p, clock in _patterns():
        if m := p.fullmatch(mask):
            found.append(Layout("calendar", tuple((k, *m.span(k)) for k, v in m.groupdict().items() if v is not None and k not in ("s1",)), clock))
    return tuple(found)


_CLASS = [chr(c) for c in range(0x250)]
_CLASS = str.maketrans({c: "d" if c in "0123456789" else "a" if c.isalpha() else c for c in _CLASS})


def mask_of(text: str) -> str:
    return text.translate(_CLASS)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the day exists."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok = (m >= 1) & (m <= 12) & (y >= 1) & (d >= 1)
    mm = np.where(ok, m, 1)
    ok &= d <= length[mm] + ((mm == 2) & leap)
    yy = np.where(ok, y, 1970)
    months = (yy - 1970) * 12 + np.where(ok, mm, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + np.where(ok, d, 1) - 1, ok


def _convert(texts: list[str], layout: Layout, tables: dict) -> tuple[np.ndarray, ...]:
    """Status (0 day, 1 instant, 2 ambiguous, 3 nonexistent, 4 invalid), microseconds and days."""
    n, size = len(texts), len(texts[0])
    codes = np.array(texts, dtype=f"U{size}").view(np.uint32).reshape(n, size).astype(np.int64)

    def number(a: int, b: int) -> np.ndarray:
        v = np.zeros(n, dtype=np.int64)
        for i in range(a, b):
            v = v * 10 + codes[:, i] - 48
        return v

    if layout.kind == "serial":
        days = number(0, 5) - 25569
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), days
    if layout.kind == "epoch":
        us = number(0, size) * (1_000_000 if size == 10 else 1000)
        return np.ones(n, dtype=np.int64), us, us // 86_400_000_000
    parts = {k: (a, b) for k, a, b in layout.parts}

    def words(k: str) -> list[str]:
        a, b = parts[k]
        return [t[a:b].lower() for t in texts]

    good = np.ones(n, dtype=bool)
    y = number(*parts["y"])
    if parts["y"][1] - parts["y"][0] == 2:
        y = y + 2000
    d = number(*parts["d"])
    m = number(*parts["m"]) if "m" in parts else np.array([MONTHS.get(w, 0) for w in words("mon")], dtype=np.int64)
    for k, allowed in (("de1", {"de"}), ("de2", {"de"}), ("dow", DAYS), ("t", {"t"})):
        if k in parts:
            good &= np.array([w in allowed for w in words(k)])
    days, exists = _days(y, m, d)
    good &= exists
    if not layout.clock:
        return np.where(good, 0, 4), np.zeros(n, dtype=np.int64), days
    h, mi = number(*parts["H"]), number(*parts["M"])
    s = number(*parts["S"]) if "S" in parts else np.zeros(n, dtype=np.int64)
    us = np.zeros(n, dtype=np.int64)
    if "f" in parts:
        a, b = parts["f"]
        us = number(a, min(b, a + 6)) * 10 ** max(0, 6 - (b - a))
    if "ap" in parts:
        half = [w.replace(".", "") for w in words("ap")]
        pm = np.array([w == "pm" for w in half])
        good &= np.array([w in ("am", "pm") for w in half]) & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * pm
    good &= (h < 24) & (mi < 60) & (s < 60)
    wall = days * 86400 + h * 3600 + mi * 60 + s
    status = np.ones(n, dtype=np.int64)
    if "sign" in parts:
        om = number(*parts["om"]) if "om" in parts else 0
        off = number(*parts["oh"]) * 3600 + om * 60
        good &= (np.abs(off) <= 18 * 3600) & (om < 60)
        sign = np.where(codes[:, parts["sign"][0]] == ord("-"), -1, 1)
        utc = wall - sign * off
    elif "z" in parts:
        off = [ABBREVIATIONS.get(w) for w in words("z")]
        good &= np.array([o is not None for o in off])
        utc = wall - np.array([o or 0 for o in off], dtype=np.int64)
    else:
        utc = np.zeros(n, dtype=np.int64)
        names = np.array(words("zn")) if "zn" in parts else np.full(n, HOME_ZONE.lower())
        for name in np.unique(names):
            at = names == name
            if name not in tables:
                good &= ~at
                continue
            t, state = from_wall(wall[at], *tables[name])
            utc[at], status[at] = t, 1 + state
    return np.where(good, status, 4), utc * 1_000_000 + us, days


def parse_days(values: list, tables: dict) -> np.ndarray:
    """The written day of each text as days since 1970, NaN where there is none: what parse_texts gives, without the other forms."""
    out = np.full(len(values), np.nan)
    for mask, at, texts in _by_mask(values):
        status, _, days = _best(mask, texts, tables)
        out[at] = np.where(status == 4, np.nan, days)
    return out


def _by_mask(values: list) -> list[tuple[str, list[int], list[str]]]:
    """Mask, places and stripped texts of the values that are not blank."""
    groups: dict[str, tuple[list[int], list[str]]] = {}
    for i, v in enumerate(values):
        if v is None or not (s := v.strip()):
            continue
        at, texts = groups.setdefault(mask_of(s) if len(s) <= LONGEST else "", ([], []))
        at.append(i)
        texts.append(s)
    return [(mask, at, texts) for mask, (at, texts) in groups.items()]


def _best(mask: str, texts: list[str], tables: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status, microseconds and days of texts of one mask, by the first layout that each fits."""
    best = np.full(len(texts), 4, dtype=np.int64)
    us, days = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for layout in layouts(mask) if mask else ():
        st, u, dd = _convert(texts, layout, tables)
        new = (best == 4) & (st != 4)
        best, us, days = np.where(new, st, best), np.where(new, u, us), np.where(new, dd, days)
        if (best != 4).all():
            break
    return best, us, days


def parse_texts(values: list, tables: dict) -> tuple[list, list, list, list]:
    """Kind, normal form, microseconds and day of each text; all None for null and blank texts."""
    n = len(values)
    kind, normal, instant, day = [None] * n, [None] * n, [None] * n, [None] * n
    for mask, at, texts in _by_mask(values):
        best, us, days = _best(mask, texts, tables)
        iso_day = np.datetime_as_string(days.astype("datetime64[D]"), unit="D")
        iso_us = np.datetime_as_string((us // 1_000_000).astype("datetime64[s]"), unit="s")
        for j, i in enumerate(at):
            b = best[j]
            if b == 0:
                kind[i], normal[i], day[i] = DAY, str(iso_day[j]), int(days[j])
            elif b == 1:
                kind[i], normal[i], instant[i], day[i] = INSTANT, f"{iso_us[j]}Z", int(us[j]), int(days[j])
            else:
                kind[i] = normal[i] = (AMBIGUOUS, NONEXISTENT, INVALID)[b - 2]
                if b < 4:
                    day[i] = int(days[j])
    return kind, normal, instant, day


def normalise_timestamp(column: Column) -> Column:
    """struct(kind, normal, instant_us, day) of a text column.

    kind: ``instant`` (time of day given; normal is the UTC instant, fractions dropped; instant_us keeps
    them), ``day`` (normal is the day), ``ambiguous`` and ``nonexistent`` (wall clock that occurs twice or
    never), ``invalid``. Null and blank texts give a struct of nulls. ``day`` is the written calendar day
    (of epoch numbers: the UTC day) as days since 1970. Ties and repeated texts give the same form.
    """
    tables = zone_tables()

    @F.pandas_udf(SCHEMA)
    def convert(s: pd.Series) -> pd.DataFrame:
        kind, normal, instant, day = parse_texts(s.tolist(), tables)
        return pd.DataFrame({"kind": pd.Series(kind, dtype=object), "normal": pd.Series(normal, dtype=object), "instant_us": pd.Series(instant, dtype="Int64"), "day": pd.Series(day, dtype="Int32")})

    return convert(column.cast("string"))


def day_number(column: Column) -> Column:
    """The ``day`` of normalise_timestamp alone, at a lower cost."""
    tables = zone_tables()

    @F.arrow_udf("int")
    def days(a: pa.Array) -> pa.Array:
        return pa.array(parse_days(a.to_pylist(), tables), pa.int32(), from_pandas=True)

    return days(column.cast("string"))
