"""Seasonal and trend decomposition of series by local regression (Cleveland's STL), out of window frames.

A local regression of a row is a handful of weighted sums over its nearest rows, which a frame of bounded width holds; so no series is gathered. Frames over whole series,
over one phase of the period and over plain means all follow one shuffle by series. Robust rounds keep their tables in the shared folder, which keeps plans short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .lineage import kept


def _odd(x: float) -> int:
    n = int(-(-x // 1))
    return n + 1 - n % 2


def local_line(part: WindowSpec, at: Column, y: Column, weight: Column, n: Column, q: int) -> Column:
    """The value at `at` of the line through its q nearest of the places 0 .. n - 1, by tricube weights of the distance times `weight`; rows without y don't count.

    part: partition, ordered by place, whose places have no gaps; places just outside 0 .. n - 1 are extrapolated to. Rows whose neighbours have no weight get null.
    """
    m = F.least(n, F.lit(q))
    left = F.greatest(F.lit(0), F.least(at + 1 - (q + 1) // 2, n - m))
    reach = F.greatest(at - left, left + m - 1 - at) + F.when(n < q, F.floor((q - n) / 2)).otherwise(0)
    frame = F.collect_list(F.struct((at).cast("double").alias("k"), y.alias("y"), weight.alias("w"))).over(part.rowsBetween(-q - 1, q + 1))
    own = F.struct(at.cast("double").alias("at"), left.cast("double").alias("left"), (left + m - 1).cast("double").alias("right"), reach.cast("double").alias("h"), n.cast("double").alias("n"))
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("s", "d", "dd", "y", "dy")])

    def value(g: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            d = x["k"] - g["at"]
            near = F.abs(d) / g["h"]
            tricube = F.when(F.abs(d) <= 0.001 * g["h"], 1.0).when(near <= 0.999, F.pow(1 - near * near * near, F.lit(3.0))).otherwise(0.0)
            w = F.when(x["y"].isNotNull() & (x["k"] >= g["left"]) & (x["k"] <= g["right"]), tricube * x["w"]).otherwise(0.0)
            v = F.coalesce(x["y"], F.lit(0.0))
            return F.struct((acc["s"] + w).alias("s"), (acc["d"] + w * d).alias("d"), (acc["dd"] + w * d * d).alias("dd"), (acc["y"] + w * v).alias("y"), (acc["dy"] + w * d * v).alias("dy"))

        def solved(a: Column) -> Column:
            mean, level = a["d"] / a["s"], a["y"] / a["s"]
            spread = a["dd"] / a["s"] - mean * mean
            return F.when(a["s"] > 0, F.when(F.sqrt(F.greatest(spread, F.lit(0.0))) > 0.001 * (g["n"] - 1), level - mean / spread * (a["dy"] / a["s"] - mean * level)).otherwise(level))

        return F.aggregate(g["rows"], zero, add, solved)

    whole = F.array(F.struct(*[own[x].alias(x) for x in ("at", "left", "right", "h", "n")], frame.alias("rows")))
    return F.element_at(F.transform(whole, value), 1)


def regular(rows: DataFrame, by: Sequence[str], t: str, v: str, step: float) -> DataFrame:
    """by..., k, v: values at t0 + k * step by straight lines between neighbours, t0 the first t of a series. Of rows of one t the mean counts; rows without t or v don't."""
    one = rows.filter(F.col(t).isNotNull() & F.col(v).isNotNull()).groupBy(*by, F.col(t).cast("double").alias("_t")).agg(F.avg(v).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t")
    ends = one.select(*by, "_t", "_v", F.lead("_t").over(w).alias("_t2"), F.lead("_v").over(w).alias("_v2"), F.min("_t").over(Window.partitionBy(*by)).alias("_t0"))
    first, past = F.ceil((F.col("_t") - F.col("_t0")) / step), F.ceil((F.col("_t2") - F.col("_t0")) / step) - 1
    last = F.col("_t2").isNull()
    places = F.when(last, F.when(first * step + F.col("_t0") == F.col("_t"), F.array(first)).otherwise(F.array().cast("array<bigint>"))).when(past >= first, F.sequence(first, past)).otherwise(F.array().cast("array<bigint>"))
    spread = ends.select("*", F.explode(places).alias("k"))
    share = (F.col("_t0") + F.col("k") * step - F.col("_t")) / (F.col("_t2") - F.col("_t"))
    return spread.select(*by, "k", F.coalesce(F.col("_v") + share * (F.col("_v2") - F.col("_v")), F.col("_v")).alias("v"))


def stl(rows: DataFrame, by: Sequence[str], k: str, v: str, period: int, seasonal: int = 7, trend: int | None = None, low: int | None = None, inner: int = 2, outer: int = 0) -> DataFrame:
    """by..., k, v, seasonal, trend, rest, weight. k: places 0, 1, ... without gaps (see regular()); v may be null, which is smoothed over. outer: robust rounds. Series shorter than two periods are left out.

    trend and low: widths of the smoothers of the trend and of the low pass; by default the smallest odd ones of at least 1.5 * period / (1 - 1.5 / seasonal) and more than the period.
    """
    trend, low = trend or _odd(1.5 * period / (1 - 1.5 / seasonal)), low or _odd(period + 1)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * period)
    outside = F.concat(F.sequence(F.lit(-period).cast("long"), F.lit(-1).cast("long")), F.sequence(F.col("_n"), F.col("_n") + period - 1))
    added = size.select(*by, "_n", F.explode(outside).alias("_k"), F.lit(None).cast("double").alias("_y"))
    cells = rows.select(*by, F.col(k).cast("long").alias("_k"), F.col(v).cast("double").alias("_y")).join(size, list(by)).select(*by, "_n", "_k", "_y").unionByName(added)
    cells = cells.withColumns({"_w": F.lit(1.0), "_trend": F.lit(0.0), "_seasonal": F.lit(0.0)})
    every = Window.partitionBy(*by)
    line, phase = every.orderBy("_k"), F.pmod(F.col("_k"), F.lit(period))
    cycle = Window.partitionBy(*by, "_phase").orderBy("_k")
    real = (F.col("_k") >= 0) & (F.col("_k") < F.col("_n"))
    cells = cells.withColumn("_phase", phase)
    for round_ in range(outer + 1):
        for _ in range(inner):
            turn, turns = ((F.col("_k") - F.col("_phase")) / period).cast("long"), F.floor((F.col("_n") - 1 - F.col("_phase")) / period) + 1
            cells = cells.withColumn("_d", F.col("_y") - F.col("_trend")).withColumn("_cycle", local_line(cycle, turn, F.col("_d"), F.col("_w"), turns, seasonal))
            cells = cells.withColumn("_a", F.avg("_cycle").over(line.rowsBetween(1 - period, 0))).withColumn("_a", F.avg("_a").over(line.rowsBetween(0, period - 1))).withColumn("_a", F.avg("_a").over(line.rowsBetween(-1, 1)))
            cells = cells.withColumn("_a", F.when(real, F.col("_a"))).withColumn("_low", local_line(line, F.col("_k"), F.col("_a"), F.lit(1.0), F.col("_n"), low))
            cells = cells.withColumn("_seasonal", F.col("_cycle") - F.col("_low")).withColumn("_d", F.col("_y") - F.col("_seasonal"))
            cells = cells.withColumn("_trend", local_line(line, F.col("_k"), F.col("_d"), F.col("_w"), F.col("_n"), trend))
        if round_ < outer:
            cells = kept(cells.select(*by, "_n", "_k", "_y", "_w", "_trend", "_seasonal", "_phase"))
            off = F.abs(F.col("_y") - F.col("_seasonal") - F.col("_trend"))
            far = 6 * F.percentile(F.when(real, off), 0.5).over(every)
            near = off / F.col("_h")
            cells = cells.withColumn("_h", far).withColumn("_w", F.when(off <= 0.001 * F.col("_h"), 1.0).when(near <= 0.999, F.pow(1 - near * near, F.lit(2.0))).otherwise(F.when(F.col("_y").isNull(), 1.0).otherwise(0.0))).drop("_h")
    out = cells.filter(real)
    return out.select(*by, F.col("_k").alias("k"), F.col("_y").alias("v"), F.col("_seasonal").alias("seasonal"), F.col("_trend").alias("trend"), (F.col("_y") - F.col("_seasonal") - F.col("_trend")).alias("rest"), F.col("_w").alias("weight"))
