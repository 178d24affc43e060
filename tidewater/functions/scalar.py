"""Scalar expressions (survey X01-X18, P02, P11).

All helpers return ``Column`` objects built from built-in functions so they
stay inside whole-stage codegen.  Division always goes through
``try_divide`` because ANSI mode raises on ``x / 0``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "safe_div", "eps_ratio", "log1p_clip", "signed_log1p", "cyclical",
    "weekday0", "null_safe_flag", "clip", "logistic", "clip_prob", "direction_label",
    "three_way_label", "regime_code", "strip_suffix", "extract_timestamp_text",
    "to_double", "nan_to_null", "to_date_safe", "weighted_index",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` with a zero or null denominator giving NULL."""
    return F.try_divide(col_of(num), col_of(den))


def eps_ratio(a, b, eps: float = 1e-10) -> Column:
    """``(a - b) / (b + eps)``."""
    a, b = col_of(a), col_of(b)
    return F.try_divide(a - b, b + F.lit(eps))


def log1p_clip(c) -> Column:
    """``log1p(max(x, 0))``; NULL stays NULL."""
    c = col_of(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def signed_log1p(c) -> Column:
    """``sign(x) * log1p(|x|)``."""
    c = col_of(c)
    return F.signum(c) * F.log1p(F.abs(c))


def cyclical(phase, period: float) -> tuple[Column, Column]:
    """``(sin, cos)`` of ``2*pi*phase/period``."""
    ang = F.lit(2.0 * math.pi) * col_of(phase).cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def weekday0(d) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(col_of(d))


def null_safe_flag(cond: Column) -> Column:
    """A comparison with a missing operand is 0, not NULL."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c, lower=None, upper=None) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` skip nulls)."""
    c = col_of(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower) if not isinstance(lower, Column) else lower)
    if upper is not None:
        out = F.least(out, F.lit(upper) if not isinstance(upper, Column) else upper)
    return F.when(c.isNotNull(), out)


def logistic(c) -> Column:
    """``1 / (1 + exp(-x))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(c)))


def clip_prob(c, eps: float = 1e-6) -> Column:
    """X11: clamp a probability into ``[eps, 1-eps]``."""
    return clip(c, eps, 1.0 - eps)


def direction_label(c) -> Column:
    """1 if ``x > 0`` else 0 (NULL stays NULL)."""
    c = col_of(c)
    return F.when(c.isNotNull(), (c > 0).cast("int"))


def three_way_label(c, band: float) -> Column:
    """1 above ``+band``, 0 below ``-band``, -1 inside or missing."""
    c = col_of(c)
    return F.when(c > band, 1).when(c < -band, 0).otherwise(-1)


def regime_code(rate, delta) -> Column:
    """Rule-coded rate regime.

    NULL if an operand is NULL; rate < 0.5 → 0; delta > 0.1 → 1;
    rate > 3 and |delta| < 0.1 → 2; else 3.
    """
    r, d = col_of(rate), col_of(delta)
    return (F.when(r.isNull() | d.isNull(), F.lit(None).cast("int"))
            .when(r < 0.5, 0)
            .when(d > 0.1, 1)
            .when((r > 3.0) & (F.abs(d) < 0.1), 2)
            .otherwise(3))


def strip_suffix(c, suffix: str = "_th05") -> Column:
    """Drop a trailing suffix."""
    import re
    return F.regexp_replace(col_of(c), re.escape(suffix) + "$", "")


def extract_timestamp_text(c, pattern: str = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?)") -> Column:
    """First timestamp-looking substring, NULL if none."""
    v = F.regexp_extract(col_of(c), pattern, 1)
    return F.when(v != "", v)


def to_double(c) -> Column:
    """Text → double, malformed → NULL (never raises under ANSI)."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def nan_to_null(c) -> Column:
    """NaN → NULL at ingest (Spark orders NaN above everything and it poisons avg)."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def to_date_safe(c) -> Column:
    """Text or timestamp → DATE, bad values → NULL."""
    c = col_of(c)
    return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("date"),
                      F.try_to_date(c.cast("string")))


def weighted_index(parts: list, weights: list[float]) -> Column:
    """Linear combination of already-scaled parts."""
    out = None
    for p, w in zip(parts, weights):
        term = col_of(p) * F.lit(float(w))
        out = term if out is None else out + term
    return out


def difference(a, b) -> Column:
    """``a - b`` (a real rate, a pressure index); NULL if either is."""
    return col_of(a) - col_of(b)


def severity(total, events) -> Column:
    """``total / (events + 1)``."""
    return col_of(total) / (col_of(events) + F.lit(1.0))


def relabel(label, reason, text: str, when: str = "medium", to: str = "eod_only") -> Column:
    """Rows labelled ``when`` whose reason contains ``text`` become ``to``."""
    label = col_of(label)
    return F.when((label == when) & F.coalesce(F.contains(col_of(reason), F.lit(text)), F.lit(False)), F.lit(to)).otherwise(label)
