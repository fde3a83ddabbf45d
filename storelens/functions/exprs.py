"""Column builders: ratios, recency, growth, banding and classification.

All are native Catalyst expressions (no Python UDF), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from ..schemas import SUM_MONEY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def safe_ratio(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    """``num / den`` when ``den > 0``, else ``default``; computed in double."""
    d = col(den)
    return F.when(d > 0, dbl(num) / dbl(d)).otherwise(F.lit(float(default)))


def ratio_nonzero_den(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with a zero denominator replaced by 1 (rates over counts)."""
    d = col(den)
    return dbl(num) / F.when(d == 0, F.lit(1.0)).otherwise(dbl(d))


def try_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` in double; NULL instead of an error or infinity when ``den`` is 0."""
    return F.try_divide(dbl(num), F.when(col(den) != 0, dbl(den)))


def money_sum(c: str | Column) -> Column:
    """Exact decimal sum, 0 when there are no rows (pandas semantics)."""
    return F.coalesce(F.sum(col(c).cast(SUM_MONEY)), F.lit(0).cast(SUM_MONEY))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def mean_decimal(c: str | Column, scale: int = 4) -> Column:
    """Mean over non-null values, summed exactly in decimal then divided in double."""
    x = col(c)
    return dbl(F.sum(x.cast(f"decimal(38,{scale})"))) / dbl(F.count(x))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Decimal half-up rounding of a double (avoids binary-tie differences), back to double."""
    return F.round(col(c).cast("decimal(38,10)"), digits).cast("double")


def round_money(c: str | Column, digits: int = 2) -> Column:
    return F.round(col(c).cast(SUM_MONEY), digits).cast("double")


def recency_days(last_ts: str | Column, reference_date: str | Column, never: int = P.NEVER_BOUGHT_RECENCY) -> Column:
    """Whole days elapsed from ``last_ts`` to the reference date (floor on seconds); ``never`` if NULL."""
    ref = F.lit(reference_date).cast("timestamp_ntz")
    secs = F.timestamp_diff("SECOND", col(last_ts), ref)
    return F.coalesce(F.floor(secs / F.lit(86400)), F.lit(never).cast("long")).cast("long")


def yoy_growth(y0: str | Column, y1: str | Column) -> Column:
    """(y1 - y0) / y0; 1.0 when y0 = 0 and y1 > 0; else 0."""
    a, b = col(y0), col(y1)
    return (
        F.when(a > 0, (dbl(b) - dbl(a)) / dbl(a))
        .when(b > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def band(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed labelled bins ``(e[i], e[i+1]]``; values outside all bins give NULL."""
    if len(edges) != len(labels) + 1:
        raise ValueError("band: need len(edges) == len(labels) + 1")
    x = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def band_order(c: str | Column, labels: Sequence[str]) -> Column:
    """Ordinal (0-based) of a band label, for ordering."""
    x = col(c)
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(x == lab, F.lit(i)) if expr is None else expr.when(x == lab, F.lit(i))
    return expr


def discount_rate(discount: str | Column = "desconto", gross: str | Column = "receita_bruta") -> Column:
    return safe_ratio(discount, gross)


def seller_quadrant(att: str | Column, margin: str | Column, target: str | Column) -> Column:
    """Quadrant from revenue attainment (>= 1) and realised margin vs target."""
    a, m, t = col(att), col(margin), col(target)
    return (
        F.when((a >= 1.0) & (m >= t), F.lit(P.QUADRANT_STAR))
        .when((a >= 1.0) & (m < t), F.lit(P.QUADRANT_VOLUME))
        .when((a < 1.0) & (m >= t), F.lit(P.QUADRANT_PROFITABLE))
        .otherwise(F.lit(P.QUADRANT_CRITICAL))
    )


def status_band(
    value: str | Column, good: float = P.MARGIN_GOOD, warn: float = P.MARGIN_WARN, labels=("good", "warn", "bad")
) -> Column:
    """Traffic light: ``>= good`` → first label, ``>= warn`` → second, else third."""
    v = col(value)
    return F.when(v >= good, F.lit(labels[0])).when(v >= warn, F.lit(labels[1])).otherwise(F.lit(labels[2]))


def seller_light(att_pct: str | Column, margin_pct: str | Column, target_pct: str | Column) -> Column:
    """Rep colour: attainment >= 100 and margin >= target green; attainment >= 100 amber; else red."""
    a, m, t = col(att_pct), col(margin_pct), col(target_pct)
    return F.when((a >= 100) & (m >= t), F.lit("green")).when(a >= 100, F.lit("amber")).otherwise(F.lit("red"))


def clamp_score(value: str | Column, cap: float, invert: bool = False) -> Column:
    """0–100 score: ``min(100, v / cap * 100)``, or ``max(0, 100 - v / cap * 100)`` when inverted."""
    s = dbl(value) / F.lit(float(cap)) * F.lit(100.0)
    return F.greatest(F.lit(0.0), F.lit(100.0) - s) if invert else F.least(F.lit(100.0), s)


def date_text(c: str | Column) -> Column:
    """``yyyy-MM-dd`` text of a timestamp, '' when NULL."""
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd"), F.lit(""))
