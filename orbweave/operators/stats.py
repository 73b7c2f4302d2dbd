"""Aggregates and statistics. Sums and counts run as partial aggregates; quantiles are exact and interpolated."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S


def slope(y: Column, t: Column) -> Column:
    """Least squares slope, 0 where t doesn't vary."""
    return F.coalesce(F.regr_slope(y, t), F.lit(0.0))


def exceeding(c: Column, threshold: float) -> Column:
    return F.avg(F.when(c >= threshold, 1.0).otherwise(0.0))


def bank(rows: DataFrame, by: Sequence[str], c: str, threshold: float) -> DataFrame:
    """Per group v_max, v_p90, v_top3 (mean of the three largest), v_median, v_share (at or above the threshold), n. Ranks tell the largest, so no group is gathered."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(c).desc_nulls_last())))
    return ranked.groupBy(*by).agg(
        F.max(c).alias("v_max"), F.percentile(c, 0.9).alias("v_p90"), F.avg(F.when(F.col("_k") <= 3, F.col(c))).alias("v_top3"), F.median(c).alias("v_median"), exceeding(F.col(c), threshold).alias("v_share"), F.count(F.lit(1)).alias("n"),
    )


def top_means(rows: DataFrame, by: Sequence[str], c: str, n: int) -> DataFrame:
    """Mean of the n largest values of each group, without gathering groups: ranks stop at n before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(c).desc_nulls_last())
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).groupBy(*by).agg(F.avg(c).alias(f"{c}_top{n}"))


def trimmed_mean(rows: DataFrame, by: Sequence[str], c: str, low: float = 0.2, high: float = 0.4, least: int = 5) -> DataFrame:
    """Mean without the lowest and highest shares of each group; plain mean of groups smaller than `least`."""
    w = Window.partitionBy(*by)
    ranked = rows.filter(F.col(c).isNotNull()).withColumn("_n", F.count(c).over(w)).withColumn("_k", F.row_number().over(w.orderBy(c)) - 1)
    first, last = F.floor(F.col("_n") * low), F.col("_n") - F.floor(F.col("_n") * high)
    return ranked.filter((F.col("_n") < least) | ((F.col("_k") >= first) & (F.col("_k") < last))).groupBy(*by).agg(F.avg(c).alias(c), F.first("_n").alias("n"))


def robust_sigma(rows: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Median, and 1.4826 times the median distance from it."""
    centre = rows.groupBy(*by).agg(F.median(c).alias("centre"))
    return rows.join(centre, list(by)).groupBy(*by).agg(F.first("centre").alias("centre"), (1.4826 * F.median(F.abs(F.col(c) - F.col("centre")))).alias("sigma"))


def clipped_mean(rows: DataFrame, by: Sequence[str], c: str, sigmas: float = 2.0, rounds: int = 5) -> DataFrame:
    """Mean within sigmas of the mean, repeated while it changes anything, at most `rounds` times; deviations are of the population."""
    limits = rows.groupBy(*by).agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"), F.count(c).alias("_n"))
    for _ in range(rounds):
        kept = rows.join(limits, list(by)).filter(F.abs(F.col(c) - F.col("_m")) <= sigmas * F.col("_s"))
        now = kept.groupBy(*by).agg(F.avg(c).alias("_m2"), F.stddev_pop(c).alias("_s2"), F.count(c).alias("_n2"))
        more = limits.join(now, list(by), "left")
        same = F.col("_n2").isNull() | (F.col("_n2") == F.col("_n"))
        limits = more.select(*by, *[F.when(same, F.col(x)).otherwise(F.col(f"{x}2")).alias(x) for x in ("_m", "_s", "_n")])
    return limits.select(*by, F.col("_m").alias(c), F.col("_n").alias("n"))


def theil_sen(rows: DataFrame, by: Sequence[str], t: str, y: str, longest: int = 3000) -> DataFrame:
    """Median of the slopes of all pairs of a series, and how many pairs. Series of more than `longest` rows are first thinned evenly to at most so many, which bounds the pairs of a series."""
    n, w = F.count(F.lit(1)).over(Window.partitionBy(*by)), Window.partitionBy(*by).orderBy(t)
    step = F.ceil(F.col("_n") / longest)
    some = rows.withColumn("_n", n).withColumn("_k", F.row_number().over(w) - 1).filter(F.col("_k") % step == 0)
    a = some.select(*by, F.col(t).alias("_t1"), F.col(y).alias("_y1"))
    b = some.select(*by, F.col(t).alias("_t2"), F.col(y).alias("_y2"))
    pairs = a.join(b, list(by)).filter(F.col("_t2") > F.col("_t1"))
    return pairs.groupBy(*by).agg(F.median((F.col("_y2") - F.col("_y1")) / (F.col("_t2") - F.col("_t1"))).alias("slope"), F.count(F.lit(1)).alias("pairs"))


def concordance(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by..., n and s: the sum over all pairs of sign(x2 - x1) * sign(y2 - y1), counted without making the pairs. Rows where x or y is null don't count.

    Rows stand in the order of x, then y. Any two of them are in the two halves of just one node of the binary tree over that order; a window over a node's rows by y counts, for each row of the
    right half, those of the left half that are smaller and larger. Pairs of equal x all count as rising there, which is taken off again. Work grows with n log n.
    """
    own = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = own.withColumn("_k", (F.row_number().over(Window.partitionBy(*by).orderBy("_x", "_y")) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(F.bin(F.col("_n") - 1)) - 1))
    each = ranked.select(*by, "_y", "_k", F.explode(levels).alias("_l"))
    node = F.expr("shiftright(_k, _l + 1)")
    halves = each.select(*by, "_l", "_y", node.alias("_node"), (F.expr("shiftright(_k, _l)") % 2).alias("_right"))
    at = [*by, "_l", "_node"]
    left = 1 - F.col("_right")
    upto, same, every = F.sum(left).over(Window.partitionBy(*at).orderBy("_y")), F.sum(left).over(Window.partitionBy(*at, "_y")), F.sum(left).over(Window.partitionBy(*at))
    rising = halves.select(*by, "_right", (2 * upto - same - every).alias("_d")).groupBy(*by).agg(F.sum(F.col("_right") * F.col("_d")).alias("_s"))
    pairs = lambda c: c * (c - 1) / 2
    cells = own.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    ties = cells.groupBy(*by, "_x").agg(F.sum("_c").alias("_m"), F.sum(pairs(F.col("_c"))).alias("_p")).groupBy(*by).agg(F.sum("_m").alias("n"), F.sum(pairs(F.col("_m")) - F.col("_p")).alias("_equal"))
    return ties.join(rising, list(by)).select(*by, "n", (F.col("_s") - F.col("_equal")).cast("long").alias("s"))


def _tied(rows: DataFrame, by: Sequence[str], c: str, term: Callable[[Column], Column], into: str) -> DataFrame:
    """A sum over the groups of equal values."""
    return rows.groupBy(*by, c).agg(F.count(F.lit(1)).cast("double").alias("_m")).groupBy(*by).agg(F.sum(term(F.col("_m"))).alias(into))


def kendall(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """n, s, tau (of all pairs) and tau_b (of pairs that differ in x and in y)."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = lambda m: m * (m - 1) / 2
    out = concordance(known, by, x, y).join(_tied(known, by, x, pairs, "_tx"), list(by)).join(_tied(known, by, y, pairs, "_ty"), list(by))
    every = F.col("n") * (F.col("n") - 1) / 2
    apart = F.sqrt((every - F.col("_tx")) * (every - F.col("_ty")))
    return out.select(*by, "n", "s", F.try_divide(F.col("s"), every).alias("tau"), F.try_divide(F.col("s"), apart).alias("tau_b"))


def two_sided(z: Column) -> Column:
    """P(|standard normal| >= |z|), by a rational approximation within 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x * 0.3275911)
    return t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592) * F.exp(-x * x)


def mann_kendall(rows: DataFrame, by: Sequence[str], order: str, y: str) -> DataFrame:
    """S over all pairs, its variance (less what equal values take), z and the two-sided p."""
    known = rows.filter(F.col(order).isNotNull() & F.col(y).isNotNull())
    out = concordance(known, by, order, y).join(_tied(known, by, y, lambda m: m * (m - 1) * (2 * m + 5), "_t"), list(by))
    n, k = F.col("n").cast("double"), F.col("s")
    var = (n * (n - 1) * (2 * n + 5) - F.col("_t")) / 18
    told = out.select(*by, "n", "s", var.alias("variance"), F.try_divide(k - F.signum(k), F.sqrt(var)).alias("z"))
    return told.withColumn("p", two_sided(F.col("z")))


def average_ranks(rows: DataFrame, by: Sequence[str], c: str, into: str) -> DataFrame:
    """Ranks from 1, ties sharing the mean of theirs."""
    w = Window.partitionBy(*by)
    below = F.rank().over(w.orderBy(c))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return rows.withColumn(into, below + (same - 1) / F.lit(2.0))


def auc(rows: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """P(positive scores above negative) + half of P(equal). Equal scores are counted first, so ranks are of distinct values."""
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("_p"), F.sum((~F.col(positive)).cast("long")).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("_w", F.col("_p") * (below + F.col("_n") / F.lit(2.0)))
    total = won.groupBy(*by).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    return total.select(*by, "positives", "negatives", F.try_divide(F.col("_w"), F.col("positives") * F.col("negatives")).alias("auc"))


def thresholds(rows: DataFrame, by: Sequence[str], score: str, positive: str, rate: float = 0.05) -> DataFrame:
    """youden (the largest TPR - FPR, the lowest threshold of several), conservative (lowest positive score), precise (lowest with FPR at most `rate`). At or above fires."""
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("_p"), F.sum((~F.col(positive)).cast("long")).alias("_n"))
    upward = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    rates = counts.select(*by, score, "_p", F.try_divide(F.sum("_p").over(upward), F.sum("_p").over(every)).alias("tpr"), F.try_divide(F.sum("_n").over(upward), F.sum("_n").over(every)).alias("fpr"))
    return rates.groupBy(*by).agg(
        F.max_by(score, F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), -F.col(score))).alias("youden"), F.max(F.col("tpr") - F.col("fpr")).alias("j"),
        F.min(F.when(F.col("_p") > 0, F.col(score))).alias("conservative"), F.min(F.when(F.col("fpr") <= rate, F.col(score))).alias("precise"),
    )


def midrank_share(values: DataFrame, background: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """values with share: (background below + background at most) / (2 * background), 0 to 1."""
    both = values.withColumn("_b", F.lit(0)).unionByName(background.select(*by, c).withColumn("_b", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*by)
    at_most = F.sum("_b").over(w.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("_b").over(Window.partitionBy(*by, c))
    n = F.sum("_b").over(w)
    return both.withColumn("share", F.try_divide(2 * at_most - same, 2.0 * n)).filter("_b = 0").drop("_b")


def matched_difference(rows: DataFrame, strata: Sequence[str], treated: str, c: str, least: int) -> DataFrame:
    """Difference of medians, treated less control, over strata with at least `least` rows of both, weighted by treated rows. One row."""
    arms = rows.groupBy(*strata).agg(
        F.count(F.when(F.col(treated), 1)).alias("nt"), F.count(F.when(~F.col(treated), 1)).alias("nc"),
        F.median(F.when(F.col(treated), F.col(c))).alias("mt"), F.median(F.when(~F.col(treated), F.col(c))).alias("mc"),
    ).filter((F.col("nt") >= least) & (F.col("nc") >= least))
    return arms.agg(F.count(F.lit(1)).alias("strata"), F.sum("nt").alias("treated"), F.try_divide(F.sum((F.col("mt") - F.col("mc")) * F.col("nt")), F.sum("nt")).alias("difference"))


def envelope(rows: DataFrame, by: Sequence[str], x: str, y: str, width: float, share: float, least: int) -> DataFrame:
    """Line through the upper quantile of y in bins of x with at least `least` rows."""
    bins = rows.groupBy(*by, (F.floor(F.col(x) / width)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.percentile(y, share).alias("_y")).filter(F.col("_n") >= least)
    at = (F.col("_bin") + 0.5) * width
    return bins.groupBy(*by).agg(F.regr_slope(F.col("_y"), at).alias("slope"), F.regr_intercept(F.col("_y"), at).alias("intercept"), F.count(F.lit(1)).alias("bins"))


def plane(rows: DataFrame, by: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """plane_x, plane_y, plane_0 of z = plane_x x + plane_y y + plane_0 by centred normal equations; null where points lie on a line."""
    cx, cy, cz = F.covar_pop(x, x), F.covar_pop(y, y), F.covar_pop(x, y)
    sums = rows.groupBy(*by).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(z).alias("_z"), cx.alias("_xx"), cy.alias("_yy"), cz.alias("_xy"), F.covar_pop(x, z).alias("_xz"), F.covar_pop(y, z).alias("_yz"))
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    a = F.try_divide(F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy"), det)
    b = F.try_divide(F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy"), det)
    return sums.select(*by, a.alias("plane_x"), b.alias("plane_y"), (F.col("_z") - a * F.col("_x") - b * F.col("_y")).alias("plane_0"))


def without_plane(rows: DataFrame, by: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """rows with `rest`, z less the plane of their group."""
    return rows.join(plane(rows, by, x, y, z), list(by)).withColumn("rest", F.col(z) - F.col("plane_x") * F.col(x) - F.col("plane_y") * F.col(y) - F.col("plane_0")).drop("plane_x", "plane_y", "plane_0")


def confusion(label: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, precision, recall, f1 and iou over rows where both are known."""
    both = label.isNotNull() & predicted.isNotNull()
    count = lambda c: F.count(F.when(both & c, 1))
    tp, fp, fn = count(label & predicted), count(~label & predicted), count(label & ~predicted)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp, tp + fp + fn).alias("iou"),
    ]


def paired(estimate: Column, truth: Column) -> list[Column]:
    """n, bias, mae, rmse, unbiased rmse, r2 (squared correlation), slope."""
    d = estimate - truth
    return [
        F.count(d).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(d).alias("ubrmse"),
        F.pow(F.corr(estimate, truth), 2).alias("r2"), F.regr_slope(estimate, truth).alias("slope"),
    ]


def welch(c: Column, after: Column) -> list[Column]:
    """Difference of means after less before, Welch's t and degrees of freedom."""
    pick = lambda cond: F.when(cond, c)
    a, b = pick(after), pick(~after)
    va, vb = F.var_samp(a) / F.count(a), F.var_samp(b) / F.count(b)
    return [
        (F.avg(a) - F.avg(b)).alias("difference"), ((F.avg(a) - F.avg(b)) / F.sqrt(va + vb)).alias("t"),
        (F.pow(va + vb, 2) / (va * va / (F.count(a) - 1) + vb * vb / (F.count(b) - 1))).alias("df"),
    ]


def welch_p(c: Column, after: Column) -> list[Column]:
    """As welch(), with the two-sided p of t. Null where a side has fewer than two values or neither varies."""
    difference, t, df = welch(c, after)
    return [difference, t, df, S.student_p(t, df).alias("p")]


def trend_test(y: Column, x: Column) -> list[Column]:
    """Slope, intercept, r2, t of the slope, its two-sided p and the F of the line, out of rows that have both. p is null for fewer than three rows or an x that doesn't vary, 0 for points on a line."""
    n = F.regr_count(y, x)
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    slope = F.try_divide(sxy, sxx)
    rest = F.greatest(syy - slope * sxy, F.lit(0.0))
    f = F.try_divide(slope * sxy * (n - 2), rest)
    t = F.when(n > 2, F.signum(slope) * F.sqrt(F.greatest(f, F.lit(0.0))))
    p = F.when((n > 2) & (sxx > 0), F.when(syy == 0, 1.0).when(rest == 0, 0.0).otherwise(S.student_p(t, (n - 2).cast("double"))))
    return [slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.try_divide(sxy * sxy, sxx * syy).alias("r2"), t.alias("t"), p.alias("p"), F.when(n > 2, f).alias("f"), n.alias("n")]


def terciles(rows: DataFrame, by: Sequence[str], c: str, tie: str) -> DataFrame:
    """1, 2 or 3: thirds by rank, ties in order of `tie`."""
    return rows.withColumn("tercile", F.ntile(3).over(Window.partitionBy(*by).orderBy(c, tie)))
