"""Scalar expressions: nulls, clipping, text, dates and small geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def nan_to_null(c: Column) -> Column:
    """NaN compares above every number in Spark, so it is made null where data enter."""
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: Column, *sentinels: float) -> Column:
    return F.when(~c.isin(*sentinels), c)


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def first_filled(*columns: Column) -> Column:
    """The first of several alternative fields that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def alias_select(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Each canonical name from the first of its candidate columns that df has; null where it has none."""
    return df.select(*[F.col(f"`{found}`").alias(name) if (found := next((c for c in of if c in df.columns), None)) else F.lit(None).cast("string").alias(name) for name, of in names.items()])


def tolerant_number(c: Column) -> Column:
    """A number out of text with separators and units; null if there is none."""
    return F.regexp_replace(c, "[^0-9.+-]", "").try_cast("double")


def capped_ratio(top: Column, bottom: Column, factor: float, cap: float) -> Column:
    """top * factor / bottom between 0 and cap; null unless both are valid (top >= 0, bottom > 0)."""
    return F.when((top >= 0) & (bottom > 0), F.least(top * factor / bottom, F.lit(cap)))


def in_domain(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def soft_clip(c: Column, low: float, high: float, margin: float) -> Column:
    """Values up to margin outside count as the bound; beyond that null."""
    return F.when(c.between(low, high), c).when((c >= low - margin) & (c < low), F.lit(low)).when((c > high) & (c <= high + margin), F.lit(high))


def keyword_class(c: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class any of whose keywords is in the text."""
    out = None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def lot_number(c: Column) -> Column:
    """`12-3` or `12-0` after the quarter's name in a lot address; null if there is none."""
    pattern = r"([가-힣]+동)\s*(\d+)(?:-(\d+))?"
    main, sub = F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3)
    return F.when(main != "", F.concat_ws("-", main, F.when(sub == "", F.lit("0")).otherwise(sub)))


def strip_others(c: Column) -> Column:
    """Without the ending `외 N 종` (and N others)."""
    return F.regexp_replace(c, r"\s*외\s*\d+\s*종\s*$", "")


def digit_pattern(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "#")


def code_prefix(c: Column) -> Column:
    """The code before a colon (of either width) or space, in capitals."""
    return F.upper(F.regexp_extract(F.trim(F.translate(c, "：", ":")), r"^([^:\s]+)", 1))


def decimal_year_365(d: Column) -> Column:
    """year + days since its first / 365.25."""
    return F.year(d) + (F.dayofyear(d) - 1) / F.lit(365.25)


def decimal_year_leap(d: Column) -> Column:
    """year + (day of year - 1) / days of that year."""
    days = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return F.year(d) + (F.dayofyear(d) - 1) / days


def parse_stamp(c: Column) -> Column:
    """YYYYMMDDHH, else YYYYMMDD, else null."""
    return F.coalesce(F.try_to_timestamp(F.when(F.length(c) == 10, c), F.lit("yyyyMMddHH")), F.try_to_timestamp(F.when(F.length(c) == 8, c), F.lit("yyyyMMdd")))


def sector(azimuth: Column, names: Sequence[str] = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")) -> Column:
    width = 360.0 / len(names)
    k = F.pmod(F.floor((azimuth + width / 2) / width), F.lit(len(names))).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), k + 1)


def letter_name(k: Column, ending: str = "동") -> Column:
    """A동, B동, ... for 0, 1, ..."""
    return F.concat(F.char(F.lit(65) + k), F.lit(ending))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360, in which the second point lies."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn))), F.lit(360.0))


def along_across(lat1: Column, lon1: Column, lat2: Column, lon2: Column, heading: float) -> tuple[Column, Column]:
    """Metres of the second point ahead of the first in the direction of flight (degrees), and to the right of it."""
    d, turn = haversine_m(lat1, lon1, lat2, lon2), F.radians(bearing(lat1, lon1, lat2, lon2) - heading)
    return d * F.cos(turn), d * F.sin(turn)


def local_metres(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Equirectangular metres east and north of a point."""
    scale = 111_320.0
    return (lon - lon0) * scale * math.cos(math.radians(lat0)), (lat - lat0) * scale


def tile_xy(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Web-mercator tile of a place."""
    n = 1 << level
    x = F.floor((lon + 180) / 360 * n)
    s = F.sin(F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))))
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n)
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    return clip(x), clip(y)


def quadkey(x: Column, y: Column, level: int) -> Column:
    digits = [(F.shiftright(x, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, k).bitwiseAND(F.lit(1))).cast("string") for k in reversed(range(level))]
    return F.concat(*digits)


def polygon_area(ring: Column) -> Column:
    """Shoelace area of an open ring, an array of struct<x, y>."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1)))
    cross = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height on WGS84 from earth-centred metres, in closed form to about a millimetre near the surface."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = a * (1 - f)
    e2, ep2 = f * (2 - f), (a * a - b * b) / (b * b)
    p = F.hypot(x, y)
    theta = F.atan2(z * a, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


def to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    a, f = 6_378_137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    p = (n + height) * F.cos(F.radians(lat))
    return p * F.cos(F.radians(lon)), p * F.sin(F.radians(lon)), (n * (1 - e2) + height) * F.sin(F.radians(lat))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0: Stirling's series eight steps up, then down again."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0)))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _front(g: Column) -> Column:
    """x^a (1 - x)^b over the beta function of a and b, of a struct of the three."""
    return F.exp(log_gamma(g["a"] + g["b"]) - log_gamma(g["a"]) - log_gamma(g["b"]) + g["a"] * F.log(g["x"]) + g["b"] * F.log1p(-g["x"]))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), as a continued fraction worked out in the row: by Lentz's rule, as many terms as a and b ask for.

    Null where an argument is null or outside 0 <= x <= 1, a > 0, b > 0.
    """
    far = x > (a + 1) / (a + b + 2)  # there the fraction of the mirrored arguments converges
    y, p, q = F.when(far, 1 - x).otherwise(x), F.when(far, b).otherwise(a), F.when(far, a).otherwise(b)
    s = F.struct(y.cast("double").alias("x"), p.cast("double").alias("a"), q.cast("double").alias("b"))
    away = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def fraction(g: Column) -> Column:
        x, a, b = g["x"], g["a"], g["b"]

        def half(acc: Column, term: Column) -> Column:
            d = 1 / away(1 + term * acc["d"])
            c = away(1 + term / acc["c"])
            return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

        def step(acc: Column, k: Column) -> Column:
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            # Both halves of a step at once; arrays of one let a value be named and used again.
            first = F.array(half(acc, even))
            return F.element_at(F.transform(first, lambda f: half(f, odd)), 1)

        d = 1 / away(1 - (a + b) * x / (a + 1))
        terms = F.sequence(F.lit(1), F.lit(40) + F.ceil(4 * F.sqrt(F.greatest(a, b))).cast("int"))
        return F.aggregate(F.transform(terms, lambda k: k.cast("double")), F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step, lambda acc: acc["h"])

    tail = F.element_at(F.transform(F.array(s), lambda g: _front(g) * fraction(g) / g["a"]), 1)
    fine = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    return F.when(fine & (x == 0), 0.0).when(fine & (x == 1), 1.0).when(fine, F.when(far, 1 - tail).otherwise(tail))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df degrees of freedom (any positive number)."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def f_tail(f: Column, above: Column, below: Column) -> Column:
    """P(F > f) for `above` and `below` degrees of freedom; 1 for f of at most 0."""
    return F.when(f <= 0, F.lit(1.0)).otherwise(incomplete_beta(below / (below + above * f), below / 2, above / 2))


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 to below 1 out of the MD5 of seed and parts joined by colons: the same on every run and at any partitioning."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / float(16**12)
