"""Time series in long form: one row per series and epoch, numbered from 1 by `i`; t in days or years, v in millimetres, subsidence negative.

Everything is a window over one series or an aggregate by series, so series are dealt out by key and none meets another. Windows end at the current row
where a feature may not look ahead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.scalar import student_p
from .inversion import masked_regression


def upto(by: Sequence[str], order: str, rows: int | None = None) -> WindowSpec:
    """The last `rows` rows of a series up to the current one (all, if None)."""
    w = Window.partitionBy(*by).orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, Window.currentRow)


def back(by: Sequence[str], t: str, span: float) -> WindowSpec:
    """Rows of a series at most `span` before the current one; times count to six decimals, as range frames need whole numbers."""
    return Window.partitionBy(*by).orderBy(F.round(F.col(t) * 1e6).cast("long")).rangeBetween(-round(span * 1e6), Window.currentRow)


def over(f: Column, least: int, counted: Column, w: WindowSpec) -> Column:
    """f over w where at least `least` values are there."""
    return F.when(F.count(counted).over(w) >= least, f.over(w))


def unpivot_epochs(wide: DataFrame, keys: Sequence[str], pattern: str = r"^D\d{8}$") -> DataFrame:
    """Columns DYYYYMMDD to rows of date and disp; the schema says which columns there are."""
    import re

    names = [c for c in wide.columns if re.match(pattern, c)]
    long = wide.select(*keys, *names).unpivot(list(keys), names, "_d", "disp")
    return long.select(*keys, F.to_date(F.substring("_d", 2, 8), "yyyyMMdd").alias("date"), "disp")


def robust_net(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, width: float, k: int = 3) -> DataFrame:
    """risk: the first k values' median less the last k's, in the last `width` of time; over the whole series where that holds fewer than 2 k."""
    series = Window.partitionBy(*by)
    end = F.max(t).over(series)
    inside = rows.filter(F.col(v).isNotNull()).withColumn("_in", F.col(t) >= end - width)
    inside = inside.withColumn("_n", F.count_if("_in").over(series)).filter(F.col("_in") | (F.col("_n") < 2 * k))
    ranked = inside.withColumn("_up", F.row_number().over(series.orderBy(i))).withColumn("_down", F.row_number().over(series.orderBy(F.desc(i))))
    first, last = F.median(F.when(F.col("_up") <= k, F.col(v))), F.median(F.when(F.col("_down") <= k, F.col(v)))
    return ranked.groupBy(*by).agg((first - last).alias("risk"))


def smoothed(rows: DataFrame, by: Sequence[str], i: str, v: str, half: int = 2, into: str = "s") -> DataFrame:
    """Rolling median, the frame cut at the ends of the series."""
    return rows.withColumn(into, F.percentile(v, 0.5).over(Window.partitionBy(*by).orderBy(i).rowsBetween(-half, half)))


def smoothed_replicated(rows: DataFrame, by: Sequence[str], i: str, v: str, half: int = 2, into: str = "s") -> DataFrame:
    """Rolling median with the end values repeated beyond the ends."""
    w = Window.partitionBy(*by).orderBy(i)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.coalesce(F.lag(v, k).over(w), F.first(v).over(every)) if k > 0 else F.coalesce(F.lead(v, -k).over(w), F.last(v).over(every)) if k else F.col(v) for k in range(half, -half - 1, -1)]
    return rows.withColumn(into, F.element_at(F.array_sort(F.array(*near)), half + 1))


def index_filled(rows: DataFrame, by: Sequence[str], i: str, v: str, into: str = "s") -> DataFrame:
    """Nulls filled linearly by place, end values held; 0 where a series has fewer than two values."""
    w = Window.partitionBy(*by).orderBy(i)
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(i).alias("i"), F.col(v).alias("v")))
    a, b = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("_a", a).withColumn("_b", b).withColumn("_n", F.count(v).over(Window.partitionBy(*by)))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(i) - F.col("_a.i")) / F.when(F.col("_b.i") != F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    value = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.coalesce(F.col(v), line, F.col("_a.v"), F.col("_b.v")))
    return both.withColumn(into, value).drop("_a", "_b", "_n")


def parts(rows: DataFrame, by: Sequence[str], i: str, n: int) -> DataFrame:
    """rows with `part` from 0: n equal runs of places, the rest in the last."""
    size = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*by)) / n)
    return rows.withColumn("part", F.least(F.lit(n - 1), F.try_divide(F.col(i) - 1, size).cast("long")))


def part_slopes(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, n: int) -> DataFrame:
    """v0, v1, ...: risk velocities (negated slopes) of n equal parts; 0 where a part has no slope."""
    cut = parts(rows, by, i, n)
    return cut.groupBy(*by).agg(*[(-F.coalesce(F.regr_slope(F.when(F.col("part") == k, F.col(v)), F.when(F.col("part") == k, F.col(t))), F.lit(0.0))).alias(f"v{k}") for k in range(n)])


def two_segment(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str) -> DataFrame:
    """early and late risk velocity, and their difference."""
    return part_slopes(rows, by, i, t, v, 2).select(*by, F.col("v0").alias("early"), F.col("v1").alias("late"), (F.col("v1") - F.col("v0")).alias("delta"))


def inflection(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str) -> DataFrame:
    """Risk velocities of thirds, and whether they never fall."""
    return part_slopes(rows, by, i, t, v, 3).withColumn("rising", (F.col("v0") <= F.col("v1")) & (F.col("v1") <= F.col("v2")))


def window_slopes(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, width: int = 8) -> DataFrame:
    """slope and tc (mean time) of the last `width` rows; null before there are as many."""
    w = upto(by, i, width)
    return rows.withColumn("slope", over(F.regr_slope(v, t), width, F.col(v), w)).withColumn("tc", over(F.avg(t), width, F.col(v), w))


def slide_windows(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, width: int = 8) -> DataFrame:
    """early and late: medians of the window velocities (negated) of the first half and of the last third."""
    slopes = window_slopes(rows, by, i, t, v, width).filter(F.col("slope").isNotNull())
    every = Window.partitionBy(*by)
    placed = slopes.withColumn("_k", F.row_number().over(every.orderBy(i)) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    early, late = F.col("_k") < F.floor(F.col("_n") / 2), F.col("_k") >= F.col("_n") - F.floor(F.col("_n") / 3)
    return placed.groupBy(*by).agg(F.median(F.when(early, -F.col("slope"))).alias("early"), F.median(F.when(late, -F.col("slope"))).alias("late"))


def inverse_velocity(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, width: int = 6, recent: int = 8, longest: float = 3650.0, per_year: float = 1.0) -> DataFrame:
    """a, b, r2 of 1 / velocity = a t + b over the last `recent` window velocities that go down (v falling), and failure time tf = -b / a; lead = (tf - last t) * per_year, null unless a < 0 and 0 <= lead <= longest."""
    slopes = window_slopes(rows, by, i, t, v, width).filter(F.col("slope") < 0)
    last = slopes.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(i)))).filter(F.col("_k") <= recent)
    inverse = -1 / F.col("slope")
    fit = last.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(inverse, F.col("tc")).alias("a"), F.regr_intercept(inverse, F.col("tc")).alias("b"), F.regr_r2(inverse, F.col("tc")).alias("r2"), F.max("tc").alias("_end")).filter("n >= 3")
    lead = (F.try_divide(-F.col("b"), F.col("a")) - F.col("_end")) * per_year
    fine = (F.col("a") < 0) & lead.between(0, longest)
    return fit.select(*by, "n", "a", "b", "r2", F.when(fine, F.try_divide(-F.col("b"), F.col("a"))).alias("tf"), F.when(fine, lead).alias("lead"))


def trailing_velocity(rows: DataFrame, by: Sequence[str], t: str, v: str, span: float, least: int = 4) -> DataFrame:
    """slope over the last `span` of time up to each row; null under `least` values."""
    w = back(by, t, span)
    return rows.withColumn("trailing", over(F.regr_slope(v, t), least, F.col(v), w))


def walk_forward(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, span: float) -> DataFrame:
    """Features of each epoch out of what came before it: cumF (first less now), cum (net over span), vel (trailing), vtr (all), dv (vel less vtr). Enough values that are all of one time have the slope NaN, as in SQL."""
    recent, past = back(by, t, span), upto(by, i)
    slope = lambda w: -F.when(F.count(v).over(w) >= 4, F.coalesce(over(F.regr_slope(v, t), 4, F.col(v), w), F.lit(float("nan"))))
    vel, all_ = slope(recent), slope(past)
    return rows.withColumn("cumF", F.first(v).over(past) - F.col(v)).withColumn("cum", F.first(v).over(recent) - F.col(v)).withColumn("vel", vel).withColumn("vtr", all_).withColumn("dv", F.col("vel") - F.col("vtr"))


def derived(rows: DataFrame, by: Sequence[str], i: str, f: str, lags: Sequence[int] = (1, 3, 6), spans: Sequence[int] = (3, 6)) -> DataFrame:
    """dm: increments over m epochs; zm: score against the m epochs before (population deviation; null where it is at most 1e-6)."""
    w = Window.partitionBy(*by).orderBy(i)
    out = rows
    for m in lags:
        out = out.withColumn(f"d{m}", F.col(f) - F.lag(f, m).over(w))
    for m in spans:
        before = w.rowsBetween(-m, -1)
        sd = F.stddev_pop(f).over(before)
        out = out.withColumn(f"z{m}", F.when((F.count(f).over(before) == m) & (sd > 1e-6), (F.col(f) - F.avg(f).over(before)) / sd))
    return out


def unwrapped(rows: DataFrame, by: Sequence[str], i: str, v: str, jump: float = 27.73, tolerance: float = 5.0, most: int = 3, deviations: float = 4.0) -> DataFrame:
    """fixed: v less whole jumps where its distance from the rolling median is near n jumps (1 <= n <= most) and beyond `deviations` median deviations."""
    rest = smoothed_replicated(rows, by, i, v, 2, "_s").withColumn("_r", F.col(v) - F.col("_s"))
    spread = rest.groupBy(*by).agg(F.median(F.abs("_r")).alias("_mad"))
    n = F.bround(F.col("_r") / jump)
    hit = F.abs(n).between(1, most) & (F.abs(F.col("_r") - n * jump) <= tolerance) & (F.abs("_r") > deviations * F.col("_mad"))
    return rest.join(spread, list(by)).withColumn("fixed", F.when(hit, F.col(v) - n * jump).otherwise(F.col(v))).drop("_s", "_r", "_mad")


def common_mode(rows: DataFrame, group: Sequence[str], v: str, into: str = "rest") -> DataFrame:
    """v less the median of all points of its epoch."""
    return rows.join(rows.groupBy(*group).agg(F.median(v).alias("_m")), list(group)).withColumn(into, F.col(v) - F.col("_m")).drop("_m")


def rereferenced(rows: DataFrame, epoch: Sequence[str], reference: Column, v: str, into: str = "rest") -> DataFrame:
    """v less the mean of the reference points at its epoch; epochs without reference are left out."""
    return rows.join(rows.filter(reference).groupBy(*epoch).agg(F.avg(v).alias("_m")), list(epoch)).withColumn(into, F.col(v) - F.col("_m")).drop("_m")


def centred_mean(rows: DataFrame, by: Sequence[str], i: str, v: str, width: int = 14, into: str = "mean") -> DataFrame:
    """Mean of rows i - width / 2 ... i + width / 2 - 1; null unless all are there."""
    w = Window.partitionBy(*by).orderBy(i).rowsBetween(-(width // 2), width - width // 2 - 1)
    return rows.withColumn(into, over(F.avg(v), width, F.col(v), w))


def _in_order(rows: DataFrame, by: Sequence[str], i: str, *columns: str) -> DataFrame:
    """One row per series with `a`, the array of structs in order of i: for what depends on all rows before. A series must fit a task."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(i, *columns))).alias("a"))


def ewm(rows: DataFrame, by: Sequence[str], i: str, v: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean at the end of each series, weights adjusted to sum to one."""
    back_ = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(i))) - 1)
    weight = F.when(F.col(v).isNotNull(), F.pow(F.lit(1.0 - alpha), F.col("_k")))
    return back_.groupBy(*by).agg((F.sum(F.col(v) * weight) / F.sum(weight)).alias("ewm"))


def clipped_walk(rows: DataFrame, by: Sequence[str], i: str, v: str, start: float, low: float, high: float) -> DataFrame:
    """The end of m = clip(m + v) from start."""
    step = lambda acc, x: F.greatest(F.lit(low), F.least(F.lit(high), acc + x[v]))
    return _in_order(rows, by, i, v).select(*by, F.aggregate("a", F.lit(start), step).alias("level"))


def greedy_passes(rows: DataFrame, by: Sequence[str], t: str, apart: float) -> DataFrame:
    """The times kept when each must be at least `apart` after the last kept one, which a gap between neighbours can't tell."""
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x[t] - F.element_at(acc, -1) >= apart), F.concat(acc, F.array(x[t]))).otherwise(acc)
    kept = _in_order(rows, by, t).select(*by, F.aggregate("a", F.array().cast("array<double>"), step).alias("kept"))
    return kept.select(*by, F.explode("kept").alias(t))


def seasonal(rows: DataFrame, by: Sequence[str], t: str, v: str) -> DataFrame:
    """Offset, rate, annual and semi-annual amplitude by least squares, t in years; series under eight rows give nulls. Spark adds up the products, so no series is gathered."""
    w = 2 * math.pi * F.col(t)
    waves = {"_c1": F.cos(w), "_s1": F.sin(w), "_c2": F.cos(2 * w), "_s2": F.sin(2 * w)}
    found = masked_regression(rows.select(*by, t, v).withColumns(waves).withColumn("_q", F.lit(1.0)), by, v, [t, *waves], "_q", 1.0)
    c = lambda k: F.when(F.col("n") >= 8, F.col("coefficients")[k])
    return found.select(*by, c(0).alias("offset"), c(1).alias("rate"), F.hypot(c(2), c(3)).alias("annual"), F.hypot(c(4), c(5)).alias("semiannual"))


def monthly(rows: DataFrame, by: Sequence[str], date: str, v: str) -> DataFrame:
    """Monthly means on a dense calendar, gaps filled linearly, and `change` from the month before."""
    means = rows.groupBy(*by, F.trunc(date, "month").alias("month")).agg(F.avg(v).alias("_v"))
    span = means.groupBy(*by).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    dense = span.join(means, [*by, "month"], "left").withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("month")))
    filled = index_filled(dense, by, "_i", "_v", v).withColumn(v, F.coalesce(v, "_v"))
    return filled.withColumn("change", F.col(v) - F.lag(v).over(Window.partitionBy(*by).orderBy("month"))).drop("_i", "_v")


def window_rate(rows: DataFrame, by: Sequence[str], t: str, v: str, start: float, end: float) -> DataFrame:
    """Slope over the epochs in [start, end], and value nearest to end less nearest to start (the earlier of two as near)."""
    at = lambda x: F.min_by(v, F.struct(F.abs(F.col(t) - x), F.col(t)))
    inside = F.col(t).between(start, end)
    return rows.groupBy(*by).agg(F.regr_slope(F.when(inside, F.col(v)), F.when(inside, F.col(t))).alias("rate"), (at(end) - at(start)).alias("delta"))


def quadratic(rows: DataFrame, by: Sequence[str], t: str, v: str) -> DataFrame:
    """acceleration a of v = a t2 + b t + c, its standard error, t = a / se and the two-sided p of t, by centred moments."""
    centre = rows.groupBy(*by).agg(F.avg(t).alias("_m"), F.avg(v).alias("_y"), F.count(v).alias("n"))
    x, y = F.col(t) - F.col("_m"), F.col(v) - F.col("_y")
    s = rows.join(centre, list(by)).groupBy(*by, "n").agg(*[F.sum(F.pow(x, k)).alias(f"s{k}") for k in (2, 3, 4)], F.sum(x * y).alias("xy"), F.sum(x * x * y).alias("xxy"), F.sum(y * y).alias("yy"))
    n, s2, s3, s4 = (F.col(c) for c in ("n", "s2", "s3", "s4"))
    q = s4 - s3 * s3 / s2 - s2 * s2 / n  # of t2 without its line and mean
    a = (F.col("xxy") - F.col("xy") * s3 / s2) / q
    rest = F.col("yy") - F.col("xy") * F.col("xy") / s2 - a * a * q
    se = F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 3) / q)
    t = F.try_divide(a, se)
    return s.filter("n > 3").select(*by, a.alias("acceleration"), se.alias("se"), t.alias("t"), student_p(t, (n - 3).cast("double")).alias("p"))


#: Names of the ways to judge a trend.
TRENDS = ("two_segment", "slide_windows", "quadratic", "inflection")


def trend_grades(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, method: str = "two_segment", least: int = 8, late_min: float = 0.0, watch: float = 5.0, danger: float = 10.0, width: int = 8, curve_min: float = 1.0, sure: tuple[float, float] = (2.0, 3.0)) -> DataFrame:
    """by..., grade (0 normal, 1 watch, 2 danger), late and early risk velocity (of the quadratic: the acceleration in place of early), by one of TRENDS.

    Values are filled by place and smoothed by a median of five first. A series of fewer than `least` rows is normal with velocities 0. A grade needs a late velocity of at least late_min and a gain of at least watch or danger (thirds
    that never fall for `inflection`; an acceleration of at least curve_min whose t is at least `sure` for `quadratic`). Series with fewer than two windows are judged by two segments.
    """
    if method not in TRENDS:
        raise ValueError(f"{method} is none of {TRENDS}")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ready = smoothed(index_filled(rows.withColumn("_rows", n), by, i, v, "_f"), by, i, "_f", into="_s")
    long = ready.filter(F.col("_rows") >= least)
    gain = lambda x: F.when(x >= danger, 2).when(x >= watch, 1).otherwise(0)
    two = two_segment(long, by, i, t, "_s").select(*by, "early", "late")
    if method == "two_segment":
        judged = two.withColumn("_g", gain(F.col("late") - F.col("early")))
    elif method == "slide_windows":
        slid = slide_windows(long, by, i, t, "_s", width).select(*by, F.col("early").alias("_e"), F.col("late").alias("_l"))
        both = two.join(slid, list(by), "left").select(*by, F.coalesce("_e", "early").alias("early"), F.coalesce("_l", "late").alias("late"))
        judged = both.withColumn("_g", gain(F.col("late") - F.col("early")))
    elif method == "inflection":
        thirds = inflection(long, by, i, t, "_s")
        judged = thirds.select(*by, F.col("v0").alias("early"), F.col("v2").alias("late"), F.when(F.col("rising"), gain(F.col("v2") - F.col("v0"))).otherwise(0).alias("_g"))
    else:
        curve = quadratic(long.withColumn("_d", -F.col("_s")), by, t, "_d").select(*by, (2 * F.col("acceleration")).alias("early"), F.col("t").alias("_t"))
        third = long.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(i)))).filter(F.col("_k") <= F.greatest(F.lit(2), F.floor(F.col("_rows") / 3)))
        late = third.groupBy(*by).agg((-F.coalesce(F.regr_slope("_s", t), F.lit(0.0))).alias("late"))
        judged = curve.join(late, list(by)).withColumn("_g", F.when(F.col("early") < curve_min, 0).when(F.col("_t") >= sure[1], 2).when(F.col("_t") >= sure[0], 1).otherwise(0)).drop("_t")
    told = judged.select(*by, F.when(F.col("late") >= late_min, F.col("_g")).otherwise(0).alias("grade"), "late", "early")
    every = rows.select(*by).distinct()
    return every.join(told, list(by), "left").select(*by, F.coalesce("grade", F.lit(0)).alias("grade"), F.coalesce("late", F.lit(0.0)).alias("late"), F.coalesce("early", F.lit(0.0)).alias("early"))


def walk_forward_bank(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, alpha: str, year: float = 1.0, least: int = 8, width: int = 6, recent: int = 8) -> DataFrame:
    """rows with twelve features of each epoch from the `least`-th on, out of it and what came before: cum1, cum2, cumF (net fall over one year, two years and all), vel (of all), each also divided by alpha (cum1a, cum2a, cumFa, vela),
    vtr (over the last year), dv (late less early half), ivfrac (1 if the inverse velocity goes down, 0 if not) and ivimm (minus the time to its zero). A feature is null where its series can't tell yet. Values fall where risk grows; t is in units of which `year` make a year.
    """
    past = upto(by, i)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(i))
    sums = {"_n": F.lit(1.0), "_t": F.col(t), "_y": F.col(v), "_tt": F.col(t) * F.col(t), "_ty": F.col(t) * F.col(v)}
    run = rows.withColumn("_at", place).withColumns({c: F.sum(x).over(past) for c, x in sums.items()})
    half = run.select(*by, F.col("_at").alias("_mid"), *[F.col(c).alias(f"h{c}") for c in sums])
    both = run.withColumn("_mid", F.floor(F.col("_at") / 2).cast("int")).join(half, [*by, "_mid"], "left")

    def fall(of: Callable[[str], Column]) -> Column:
        n, x, y, xx, xy = (of(c) for c in sums)
        return -F.try_divide(n * xy - x * y, n * xx - x * x)

    early, late, whole = fall(lambda c: F.col(f"h{c}")), fall(lambda c: F.col(c) - F.col(f"h{c}")), fall(lambda c: F.col(c))
    slopes = window_slopes(rows, by, i, t, v, width).filter(F.col("slope") < 0).withColumn("_inv", -1 / F.col("slope"))
    few = upto(by, i, recent)
    fit = slopes.select(*by, F.col(i), F.when(F.count("_inv").over(few) >= 3, F.struct(F.regr_slope("_inv", "tc").over(few).alias("a"), F.regr_intercept("_inv", "tc").over(few).alias("b"))).alias("_fit"))
    out = both.join(fit, [*by, i], "left").withColumn("_fit", F.last("_fit", ignorenulls=True).over(past))
    lead = F.try_divide(-F.col("_fit.b"), F.col("_fit.a")) - F.col(t)
    net = lambda span: F.first(v).over(past if span is None else back(by, t, span * year)) - F.col(v)
    told = out.withColumns({"cum1": net(1), "cum2": net(2), "cumF": net(None), "vel": whole, "vtr": -over(F.regr_slope(v, t), 4, F.col(v), back(by, t, year)), "dv": late - early})
    told = told.withColumns({f"{c}a": F.try_divide(F.col(c), F.col(alpha)) for c in ("cum1", "cum2", "cumF", "vel")})
    told = told.withColumn("ivfrac", F.when(F.col("_fit").isNotNull(), F.when(F.col("_fit.a") < 0, 1.0).otherwise(0.0))).withColumn("ivimm", F.when((F.col("_fit.a") < 0) & (lead > 0), -lead))
    return told.filter(F.col("_at") >= least).drop("_at", "_mid", "_fit", *sums, *[f"h{c}" for c in sums])


def buffer_bank(features: DataFrame, buffer: Sequence[str], i: str) -> DataFrame:
    """The features of walk_forward_bank of the points of a buffer: the largest of each epoch, of ivfrac the mean."""
    names = ("cum1", "cum1a", "cum2", "cum2a", "cumF", "cumFa", "vel", "vela", "vtr", "dv", "ivimm")
    return features.groupBy(*buffer, i).agg(*[F.max(c).alias(c) for c in names], F.avg("ivfrac").alias("ivfrac"))


def largest_jumps(rows: DataFrame, by: Sequence[str], i: str, t: str, v: str, n: int = 3, width: int = 8) -> DataFrame:
    """by..., i, jump: the n largest changes between the slope of the last `width` rows and that of the width rows before, the earlier of equal ones."""
    w = Window.partitionBy(*by)
    jump = F.abs(F.col("slope") - F.lag("slope", width).over(w.orderBy(i)))
    found = window_slopes(rows, by, i, t, v, width).select(*by, i, jump.alias("jump")).filter("jump is not null")
    return found.withColumn("_k", F.row_number().over(w.orderBy(F.round("jump", 9).desc(), i))).filter(F.col("_k") <= n).drop("_k")
