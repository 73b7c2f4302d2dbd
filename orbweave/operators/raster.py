"""Rasters as tables of cells (r, c, values): thresholds, changes, zones, blocks and geometry of grids."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def decibel(c: Column) -> Column:
    return F.when(c > 0, 10 * F.log10(c))


def polynomial2(x: Column, y: Column, coefficients: Sequence[Sequence[float]]) -> Column:
    """Sum of coefficients[i][j] x^i y^j."""
    return sum((F.lit(k) * F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j))) for i, row in enumerate(coefficients) for j, k in enumerate(row)), F.lit(0.0))


def otsu(cells: DataFrame, by: Sequence[str], v: str, bins: int = 256) -> DataFrame:
    """threshold per group: the bin centre of the largest variance between classes, the first of several; null where all values are one.

    A histogram per group leaves the cells; the rest is windows over at most `bins` rows of a group.
    """
    ends = cells.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    k = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(v) - F.col("_lo"), width))).cast("long")
    joined = cells.filter(F.col(v).isNotNull()).join(ends, list(by)) if by else cells.filter(F.col(v).isNotNull()).join(F.broadcast(ends), F.lit(True))
    hist = joined.groupBy(*by, "_lo", "_hi", k.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_k").isNotNull())
    centre = F.col("_lo") + (F.col("_k") + 0.5) * width
    every = Window.partitionBy(*by)
    w = every.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hist.withColumn("_x", centre).withColumn("_w", F.sum("_n").over(w)).withColumn("_m", F.sum(F.col("_n") * F.col("_x")).over(w)).withColumn("_aw", F.sum("_n").over(every)).withColumn("_am", F.sum(F.col("_n") * F.col("_x")).over(every))
    w0, w1 = F.col("_w"), F.col("_aw") - F.col("_w")
    gap = F.col("_m") / w0 - F.try_divide(F.col("_am") - F.col("_m"), w1)
    between = F.round(w0 / F.col("_aw") * (w1 / F.col("_aw")) * gap * gap, 9)
    return rows.withColumn("_b", between).groupBy(*by).agg(F.max_by(F.when(F.col("_b").isNotNull(), F.col("_x")), F.struct("_b", -F.col("_k"))).alias("threshold"))


def ring(cells: DataFrame, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Cells on the edge of the mask: some neighbour of the eight (the cell itself included) is in it and some isn't."""
    around = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    seen = cells.select(*by, F.col(mask).alias("_m"), F.inline(around)).groupBy(*by, "r", "c").agg(F.max("_m").alias("_any"), F.min("_m").alias("_all"))
    return cells.join(seen.filter(F.col("_any") & ~F.col("_all")).select(*by, "r", "c"), [*by, "r", "c"], "left_semi")


def edge_otsu(cells: DataFrame, by: Sequence[str], v: str, start: float, least: int = 10) -> DataFrame:
    """Otsu's threshold of the band along the edge of v < start; of all cells where the band has fewer than `least`."""
    band = ring(cells.filter(F.col(v).isNotNull()).withColumn("_water", F.col(v) < start), "_water", by)
    edge = otsu(band, by, v).withColumnRenamed("threshold", "_edge").join(band.groupBy(*by).agg(F.count(F.lit(1)).alias("band")), list(by))
    return otsu(cells, by, v).join(edge, list(by), "left").select(*by, F.when(F.col("band") >= least, F.col("_edge")).otherwise(F.col("threshold")).alias("threshold"), F.coalesce("band", F.lit(0)).alias("band"))


def tile_otsu(cells: DataFrame, v: str, size: int, share: float = 0.75) -> DataFrame:
    """One threshold out of the cells of tiles whose variance is at least that quantile of all tiles' variances."""
    tiled = cells.withColumn("_tr", F.floor(F.col("r") / size)).withColumn("_tc", F.floor(F.col("c") / size))
    spread = tiled.groupBy("_tr", "_tc").agg(F.var_pop(v).alias("_v"))
    limit = spread.agg(F.percentile("_v", share).alias("_limit"))
    chosen = spread.join(F.broadcast(limit), F.col("_v") >= F.col("_limit")).select("_tr", "_tc")
    return otsu(tiled.join(chosen, ["_tr", "_tc"], "left_semi").withColumn("_g", F.lit(0)), ["_g"], v).select("threshold")


def change_codes(before: DataFrame, after: DataFrame, mask: str) -> DataFrame:
    """r, c and code: 0 unchanged, 1 gain, 2 loss; cells that either lacks count as dry there."""
    a, b = before.select("r", "c", F.col(mask).alias("_a")), after.select("r", "c", F.col(mask).alias("_b"))
    old, new = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return a.join(b, ["r", "c"], "full").select("r", "c", F.when(~old & new, 1).when(old & ~new, 2).otherwise(0).alias("code"))


def ndfi(before: Column, after: Column) -> Column:
    """(pre - post) / (pre + post) in [-1, 0]; null elsewhere and where the sum is near zero."""
    total = before + after
    index = F.when(F.abs(total) > 1e-9, (before - after) / F.when(F.abs(total) > 1e-9, total))
    return F.when(index.between(-1, 0), index)


def ndfvi(before: Column, after: Column) -> Column:
    return (F.abs(after) - F.abs(before)) / (F.abs(after) + F.abs(before) + 1e-9)


def zonal(cells: DataFrame, zones: DataFrame, zone: str, v: str) -> DataFrame:
    """n, mean and share above zero of v by zone; zones: r, c, zone."""
    return cells.join(zones, ["r", "c"]).groupBy(zone).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg((F.col(v) > 0).cast("double")).alias("share"))


def multilook(cells: DataFrame, size: int) -> DataFrame:
    """Coherence of blocks of two complex images (ar, ai, br, bi): |sum A conj(B)| / sqrt(sum |A|2 sum |B|2)."""
    re = F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"))
    im = F.sum(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi"))
    aa, bb = F.sum(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")), F.sum(F.col("br") * F.col("br") + F.col("bi") * F.col("bi"))
    out = cells.groupBy(F.floor(F.col("r") / size).alias("r"), F.floor(F.col("c") / size).alias("c")).agg(re.alias("_re"), im.alias("_im"), aa.alias("_aa"), bb.alias("_bb"))
    return out.select("r", "c", F.try_divide(F.hypot("_re", "_im"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias("coherence"), F.atan2("_im", "_re").alias("phase"))


def decompose(asc: Column, dsc: Column, e1: Column, u1: Column, e2: Column, u2: Column, least: float = 0.3) -> tuple[Column, Column]:
    """East and up out of two lines of sight; null where the determinant is small."""
    det = e1 * u2 - e2 * u1
    fine = F.abs(det) >= least
    safe = F.when(fine, det)
    return (asc * u2 - dsc * u1) / safe, (e1 * dsc - e2 * asc) / safe


def los_vector(incidence: Column, heading: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a right-looking line of sight; degrees."""
    s = F.sin(F.radians(incidence))
    return -s * F.cos(F.radians(heading)), s * F.sin(F.radians(heading)), F.cos(F.radians(incidence))


def los_to_vertical(v: Column, incidence: Column) -> Column:
    return v / F.cos(F.radians(incidence))


def phase_to_mm(phase: Column, wavelength_mm: float = 55.465763) -> Column:
    return -wavelength_mm / (4 * math.pi) * phase


def slope_degrees(cells: DataFrame, v: str, size: float) -> DataFrame:
    """Slope by central differences (one-sided at the edges); cells whose neighbours are missing on one axis have none on it."""
    rows, cols = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")

    def gradient(w: Window, at: str) -> Column:
        a, b = F.lag(v).over(w), F.lead(v).over(w)
        ia, ib = F.lag(at).over(w), F.lead(at).over(w)
        up, down = F.when(F.col(at) - ia == 1, a), F.when(ib - F.col(at) == 1, b)
        return F.coalesce((down - up) / (2 * size), (down - F.col(v)) / size, (F.col(v) - up) / size, F.lit(0.0))

    out = cells.withColumn("_gy", gradient(rows, "r")).withColumn("_gx", gradient(cols, "c"))
    return out.withColumn("slope", F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_gx", "_gy")


def resampled(cells: DataFrame, v: str, factor: int) -> DataFrame:
    """Means of factor x factor cells."""
    return cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(v).alias(v), F.count(v).alias("n"))


def scatter(points: DataFrame, size: float, value: str) -> DataFrame:
    """Sums of point values by cell."""
    return points.groupBy(F.floor(F.col("y") / size).alias("r"), F.floor(F.col("x") / size).alias("c")).agg(F.sum(value).alias(value))


def buffered(points: DataFrame, radius: float, size: float) -> DataFrame:
    """Cells whose centres are within the radius of some point, with the distance of the nearest."""
    lo, hi = lambda p: F.floor((F.col(p) - radius) / size).cast("long"), lambda p: F.floor((F.col(p) + radius) / size).cast("long")
    cover = points.select("x", "y", F.explode(F.sequence(lo("x"), hi("x"))).alias("c"), lo("y").alias("_lo"), hi("y").alias("_hi"))
    cover = cover.select("x", "y", "c", F.explode(F.sequence("_lo", "_hi")).alias("r"))
    d = F.hypot((F.col("c") + 0.5) * size - F.col("x"), (F.col("r") + 0.5) * size - F.col("y"))
    return cover.select("r", "c", d.alias("d")).filter(F.col("d") <= radius).groupBy("r", "c").agg(F.min("d").alias("d"))


def grid_limited(points: DataFrame, size: float, most: int, order: str) -> DataFrame:
    """At most `most` points per cell, the best by `order` (descending), ties by k: thinning is the feature."""
    w = Window.partitionBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).orderBy(F.desc(order), "k")
    return points.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def lut_inverse(rows: DataFrame, lut: DataFrame, key: str, value: str, tolerance: float, step: float) -> DataFrame:
    """Mean of the table's moistures whose modelled value (column `model`) is within the tolerance, and their number; the table goes by buckets of the model."""
    b = lut.withColumn("_b", F.floor(F.col("model") / step))
    reach = math.ceil(tolerance / step)
    a = rows.select(key, value, F.explode(F.sequence(F.floor(F.col(value) / step) - reach, F.floor(F.col(value) / step) + reach)).alias("_b"))
    hit = a.join(b, "_b").filter(F.abs(F.col("model") - F.col(value)) <= tolerance)
    found = hit.groupBy(key).agg(F.avg("moisture").alias("moisture"), F.count(F.lit(1)).alias("solutions"))
    return rows.select(key).join(found, key, "left").select(key, "moisture", F.coalesce("solutions", F.lit(0)).alias("solutions"))


def band_mean(samples: DataFrame, response: DataFrame, by: Sequence[str]) -> DataFrame:
    """Response-weighted means: samples (by..., wavelength, value), response (band, wavelength, weight)."""
    both = samples.join(response, "wavelength")
    return both.groupBy(*by, "band").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))


def calibrated(cells: DataFrame, columns: DataFrame, raw: str) -> DataFrame:
    """(raw - dark) * gain - shift, by column of the sensor (columns: c, dark, gain, shift)."""
    return cells.join(columns, "c").select("r", "c", ((F.col(raw) - F.col("dark")) * F.col("gain") - F.col("shift")).alias(raw))


def fuzzy_otsu(cells: DataFrame, by: Sequence[str], v: str, least: float = 0.9) -> DataFrame:
    """cells with member: 1 - exp(-(v - mid)^2 / 2 s^2) >= least around the middle of the two class means, s half their distance.

    The membership is symmetric: values far above the middle are members as well as those far below.
    """
    both = cells.join(otsu(cells, by, v), list(by))
    low = both.groupBy(*by).agg(F.avg(F.when(F.col(v) < F.col("threshold"), F.col(v))).alias("_a"), F.avg(F.when(F.col(v) >= F.col("threshold"), F.col(v))).alias("_b"))
    s = (F.col("_b") - F.col("_a")) / 2
    d = F.col(v) - (F.col("_a") + F.col("_b")) / 2
    return cells.join(low, list(by)).withColumn("member", 1 - F.exp(F.try_divide(-d * d, 2 * s * s)) >= least).drop("_a", "_b")


def valid_intersection(a: DataFrame, b: DataFrame, v: str) -> DataFrame:
    """r, c and both values of the cells where both rasters have one."""
    both = a.select("r", "c", F.col(v).alias("a")).join(b.select("r", "c", F.col(v).alias("b")), ["r", "c"])
    return both.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def dropped(before: Column, after: Column, decibels: float = -6.0) -> Column:
    """Whether backscatter (dB) fell by as much; false where either is missing."""
    return F.coalesce(after - before <= decibels, F.lit(False))


def burned(before: Column, after: Column, clear: Column, land: Column, least: float = 0.1) -> Column:
    """Difference of burn ratios at least `least`, on land clear on both dates; null elsewhere."""
    return F.when(clear & land, before - after >= least)


def profile(stations: DataFrame, cells: DataFrame, key: str, v: str, radius: float) -> DataFrame:
    """Median of the cell values within the radius of each station along a line, and how many; cells have x, y."""
    from .joins import radius_pairs

    near = radius_pairs(stations, cells, radius)
    return near.groupBy(F.col(f"l.{key}").alias(key)).agg(F.median(f"r.{v}").alias(v), F.count(F.lit(1)).alias("n"))


def tile_cover(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """How many tiles each box (x0, y0, x1, y1) touches."""
    n = lambda a, b: F.floor(F.col(b) / size) - F.floor(F.col(a) / size) + 1
    return boxes.select(key, (n("x0", "x1") * n("y0", "y1")).alias("tiles"))


def bridged(bands: DataFrame, pairs: DataFrame, by: Sequence[str], shifts: Sequence[str], limit: float) -> DataFrame:
    """Shifts of the bands of each scene from its first one, along the chain of bands that can be trusted: by..., i, the shifts and trusted.

    bands: by..., i (order of capture). pairs: by..., i, j and the shifts of band j against band i, for i before j. A pair without row, with a null or non-finite shift or one beyond
    the limit hasn't matched; a band that doesn't match the last trusted one gets that one's shift, and the next band is held against the trusted one again.
    A scene's bands, of which a camera has a few, are folded in one row; scenes are independent.
    """
    fine = functools.reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) <= limit), shifts, F.col("j") > F.col("i"))
    step = F.struct(F.col("j").alias("to"), *[F.col(c).cast("double").alias(c) for c in shifts])
    ahead = pairs.filter(fine).groupBy(*by, "i").agg(F.min(step).alias("_next"))
    scenes = bands.select(*by, "i").distinct().join(ahead, [*by, "i"], "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "_next"))).alias("_bands"))
    band = "struct<" + "i:bigint," + "".join(f"{c}:double," for c in shifts) + "trusted:boolean>"
    hop = "struct<to:bigint," + ",".join(f"{c}:double" for c in shifts) + ">"
    start = F.struct(*[F.lit(0.0).alias(c) for c in shifts], F.lit(None).cast(hop).alias("next"), F.array().cast(f"array<{band}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        first = F.size(acc["out"]) == 0
        reached = F.coalesce(acc["next"]["to"] == x["i"], F.lit(False))
        total = {c: F.when(reached, acc[c] + acc["next"][c]).otherwise(acc[c]) for c in shifts}
        own = F.struct(x["i"].cast("long").alias("i"), *[v.alias(c) for c, v in total.items()], (first | reached).alias("trusted"))
        follow = F.struct(x["_next"]["to"].cast("long").alias("to"), *[x["_next"][c].alias(c) for c in shifts])
        return F.struct(*[v.alias(c) for c, v in total.items()], F.when(first | reached, follow).otherwise(acc["next"]).alias("next"), F.concat(acc["out"], F.array(own)).cast(f"array<{band}>").alias("out"))

    return scenes.select(*by, F.inline(F.aggregate("_bands", start, add, lambda acc: acc["out"])))


def class_baseline(rows: DataFrame, cell: Sequence[str], cls: str, v: str) -> DataFrame:
    """rows with dry (the smallest v of the cell among the epochs of the same class), n (how many these are) and rise (v less dry)."""
    w = Window.partitionBy(*cell, cls)
    return rows.withColumn("dry", F.min(v).over(w)).withColumn("n", F.count(v).over(w)).withColumn("rise", F.col(v) - F.col("dry"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, v: str, size: float) -> DataFrame:
    """points (x, y, ...) with r, c and v of the nearest node, nodes lying at (c * size, r * size); a point halfway takes the higher one, and points whose node has no row are left out."""
    at = lambda c: F.floor(F.col(c) / size + 0.5)
    return points.withColumn("r", at("y")).withColumn("c", at("x")).join(nodes.select("r", "c", v), ["r", "c"])


def water(cells: DataFrame, v: str, looks: str, size: float, dark: float, flat: float = 5.0, least: int = 3) -> DataFrame:
    """cells with slope (degrees, of v over cells of that size) and water: v below dark, slope below flat, at least `least` looks."""
    return slope_degrees(cells, v, size).withColumn("water", (F.col(v) < dark) & (F.col("slope") < flat) & (F.col(looks) >= least))


def damage_areas(cells: DataFrame, by: Sequence[str], loss: str, high: float = 0.3, risk: float = 0.15, km2: float = 0.0009) -> DataFrame:
    """by..., high and risk (cells whose coherence fell by as much, or by at least risk but less than high) and km2, the area of both."""
    d = F.col(loss)
    return cells.groupBy(*by).agg(F.count_if(d >= high).alias("high"), F.count_if((d >= risk) & (d < high)).alias("risk"), (F.count_if(d >= risk) * km2).alias("km2"))
