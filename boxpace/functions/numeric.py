"""Rounding, safe ratios and status rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (DEFAULT, STATUS_AHEAD, STATUS_BEHIND, STATUS_NONE, STATUS_ON_PACE,
                      STATUS_TEXT_MAP, WHITESPACE, PacingConfig)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, scale: int = 1) -> Column:
    """Banker's rounding (F17): 2.25 -> 2.2."""
    return F.bround(_c(x), scale)


def round_to_long(x) -> Column:
    """Half-even rounding to a whole number."""
    return F.bround(_c(x), 0).cast("long")


def safe_ratio(num, den, zero_as: float | None = None) -> Column:
    """num / den with a zero or NULL denominator giving NULL, or ``zero_as``."""
    r = F.try_divide(_c(num), F.when(_c(den) != 0, _c(den)))
    return r if zero_as is None else F.coalesce(r, F.lit(float(zero_as)))


def clip(x, lo=None, hi=None) -> Column:
    """Clip keeping NULL."""
    x = _c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def pace_status(gap, cfg: PacingConfig = DEFAULT) -> Column:
    """Behind / Ahead / On pace by the +-band; NULL or NaN gap -> No benchmark."""
    g = _c(gap)
    return (F.when(g.isNull() | F.isnan(g), F.lit(STATUS_NONE))
            .when(g <= -cfg.band_pp, F.lit(STATUS_BEHIND))
            .when(g >= cfg.band_pp, F.lit(STATUS_AHEAD))
            .otherwise(F.lit(STATUS_ON_PACE)))


def normalize_status(s) -> Column:
    """trim + lower + map to the three statuses; anything else -> NULL."""
    key = F.lower(F.btrim(_c(s), F.lit(WHITESPACE)))
    expr = None
    for k, v in STATUS_TEXT_MAP:
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr
