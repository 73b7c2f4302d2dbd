"""Verdict ladders: ordered thresholds to ranks (0 normal, 1 caution, 2 danger), and verdicts with reason and basis.

Risk values grow with danger; alpha (0 < alpha <= 1) is the ground's grade, which tightens thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Ranks and their labels.
LABELS = ("정상", "주의", "위험")
#: Thresholds of velocity (mm a year) and of cumulative settlement (mm).
VELOCITY = ((5.0, 1), (10.0, 2), (30.0, 2))
CUMULATIVE = ((15.0, 1), (20.0, 2))


def ladder(value: Column, steps: Sequence[tuple[float, int]], alpha: Column | float = 1.0) -> Column:
    """The rank of the highest step that value reaches; null values are normal."""
    out = F.lit(0)
    for threshold, rank in steps:
        out = F.when(value >= F.lit(threshold) * alpha, F.lit(rank)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def velocity_grade(risk: Column, alpha: Column | float = 1.0) -> Column:
    return ladder(risk, VELOCITY, alpha)


def cumulative_grade(risk: Column, alpha: Column | float = 1.0) -> Column:
    return ladder(risk, CUMULATIVE, alpha)


def subsidence_gate(velocity: Column, grade: Column) -> Column:
    """Uplift or rest is normal whatever else says."""
    return F.when(velocity >= 0, F.lit(0)).otherwise(grade)


def worst(*grades: Column) -> Column:
    return F.greatest(*grades)


def basis(named: Sequence[tuple[str, Column]]) -> Column:
    """Names of the indicators that attain the worst grade, `-` if that is normal."""
    top = F.greatest(*[g for _, g in named])
    hit = F.filter(F.array(*[F.when(g == top, F.lit(n)) for n, g in named]), lambda x: x.isNotNull())
    return F.when(top == 0, F.lit("-")).otherwise(F.array_join(hit, "+"))


def label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), rank + 1)


def _verdict(level: Column, reason: Column, why: str) -> Column:
    return F.struct(level.alias("level"), reason.alias("reason"), F.lit(why).alias("basis"))


def separation_level(distance: Column, floors: Column, near: float = 6.0, far: float = 10.0, band: float = 1.3, tall: int = 3) -> Column:
    """Distance between buildings: below the limit 경고, within the band above it 주의. Unknown or more floors have the wider limit."""
    limit = F.when(floors < tall, F.lit(near)).otherwise(F.lit(far))
    return F.when(distance < limit, F.lit("경고")).when(distance < limit + band, F.lit("주의")).otherwise(F.lit("이상없음"))


def separation_verdict(distance: Column, floors: Column) -> Column:
    return _verdict(separation_level(distance, floors), F.concat(F.format_number(distance, 1), F.lit(" m")), "separation")


def lot_line_level(distance: Column, near: float = 3.0, far: float = 5.0) -> Column:
    return F.when(distance < near, F.lit("경고")).when(distance < far, F.lit("주의")).otherwise(F.lit("이상없음"))


def ledger_level(ledger: Column, measured: Column, over: float = 30.0, ratio: float = 1.10, much: float = 85.0) -> Column:
    """Measured area against the register: over both an amount and a ratio 주의, much over 경고; no register 확인 필요."""
    more = measured - ledger
    hit = (more >= over) & (measured >= ledger * ratio)
    return F.when(ledger.isNull() | (ledger <= 0), F.lit("확인 필요")).when(hit & (more >= much), F.lit("경고")).when(hit, F.lit("주의")).otherwise(F.lit("이상없음"))


def yard_level(distance: Column, near: float = 6.0, far: float = 15.0) -> Column:
    return F.when(distance < near, F.lit("경고")).when(distance < far, F.lit("주의")).otherwise(F.lit("이상없음"))


def share_rank(share: Column, top: float = 0.10, upper: float = 0.25) -> Column:
    return F.when(share.isNull(), F.lit("판정 불가")).when(share <= top, F.lit("경고")).when(share <= upper, F.lit("주의")).otherwise(F.lit("이상없음"))


def wind_level(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit("판정 불가")).when(ratio > 1.0, F.lit("경고")).when(ratio >= 0.8, F.lit("주의")).otherwise(F.lit("이상없음"))


#: Order of levels, worst first.
LEVELS = ("경고", "주의", "이상없음", "확인 필요", "판정 불가")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def accident_verdict(covered: Column, series: Column, fired: Column) -> Column:
    """no data, limit of the method, hit or miss."""
    return F.when(~covered, F.lit("no-data")).when(series < 3, F.lit("limit")).when(fired, F.lit("TP")).otherwise(F.lit("miss"))


def coherence_class(before: Column, during: Column, thresholds: Sequence[float] = (0.2, 0.4, 0.6), valid: float = 0.3) -> Column:
    """0 below the first threshold of lost coherence, up to the number of thresholds; null unless coherent before."""
    lost = before - during
    out = F.lit(0)
    for k, t in enumerate(thresholds, 1):
        out = F.when(lost >= t, F.lit(k)).otherwise(out)
    return F.when(before >= valid, out)
