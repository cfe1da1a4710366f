"""Lead-time and calendar expressions (P8-P12, F9-F14). All JVM-side."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, PacingConfig


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def days_out(event_date="event_date", sale_date="sale_date") -> Column:
    """Whole days from sale to event; time of day is dropped first."""
    return F.datediff(F.to_date(_c(event_date)), F.to_date(_c(sale_date)))


def in_lead_window(d="days_out", cfg: PacingConfig = DEFAULT) -> Column:
    """0 <= days_out <= max_lead."""
    d = _c(d)
    return (d >= 0) & (d <= cfg.max_lead)


def clamp(x, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least alone would drop it)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(x, F.lit(hi))))


def lead_clamped(d="days_out", cfg: PacingConfig = DEFAULT) -> Column:
    """Late sales fold into day 0, early ones into max_lead (P10)."""
    return clamp(d, 0, cfg.max_lead)


def lead_capped(d="days_out", cfg: PacingConfig = DEFAULT) -> Column:
    """Top clamp only; rows with days_out < 0 must be filtered before."""
    d = _c(d)
    return F.least(d, F.lit(cfg.max_lead))


def bin_floor(d="days_out", cfg: PacingConfig = DEFAULT) -> Column:
    """Floor to a multiple of the bin width, flooring negatives too."""
    d = _c(d)
    return (d - F.pmod(d, F.lit(cfg.bin_size))).cast("int")


def weekday_name(ts) -> Column:
    """English day name."""
    return F.date_format(_c(ts), "EEEE")


def weekday_rank(name) -> Column:
    """Monday-first rank of a day name, NULL for other text."""
    name = _c(name)
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    return F.array_position(F.array(*[F.lit(x) for x in days]), name).cast("int") - 1


def month_start(ts) -> Column:
    """First day of the month as a date."""
    return F.to_date(F.date_trunc("MONTH", _c(ts)))


def season_start_year(season) -> Column:
    """First four characters of a season label as int, NULL if not a number."""
    return F.substring(_c(season), 1, 4).try_cast("int")


def lead_bucket_closed(d="days_out", cfg: PacingConfig = DEFAULT) -> Column:
    """Closed-range lead buckets; 'unknown' for NULL, '>max' / '<0' outside."""
    d = _c(d)
    expr = F.when(d.isNull(), F.lit("unknown"))
    for lo, hi, label in cfg.lead_buckets:
        expr = expr.when((d >= lo) & (d <= hi), F.lit(label))
    top = cfg.lead_buckets[-1][1]
    return expr.when(d > top, F.lit(f">{top}")).otherwise(F.lit("<0"))


def lead_bucket_half_open(d="days_out", cfg: PacingConfig = DEFAULT) -> Column:
    """Right-closed intervals (e0, e1], (e1, e2], ...; NULL outside."""
    d = _c(d)
    edges, labels = cfg.lead_edges, cfg.lead_labels
    expr = None
    for i, label in enumerate(labels):
        cond = (d > edges[i]) & (d <= edges[i + 1])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr
