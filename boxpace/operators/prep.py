"""Row preparation, slices and periods."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MISSING_EVENT_TYPE, POST_LABEL, PRE_LABEL, PacingConfig
from ..functions.lead import bin_floor, days_out, in_lead_window, weekday_name


def lit_ts(d: dt.date | dt.datetime) -> Column:
    """A date as a wall-clock timestamp literal (midnight), comparable with the fact's timestamps.

    Built from text, so neither the Python process's nor the session's time
    zone can shift it.
    """
    if not isinstance(d, dt.datetime):
        d = dt.datetime(d.year, d.month, d.day)
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def fill_missing(df: DataFrame) -> DataFrame:
    """Default weekday / venue / event_type when the column is absent."""
    if "weekday" not in df.columns:
        df = df.withColumn("weekday", weekday_name("event_date"))
    if "venue" not in df.columns:
        df = df.withColumn("venue", F.lit("Unknown"))
    if "event_type" not in df.columns:
        df = df.withColumn("event_type", F.lit(MISSING_EVENT_TYPE))
    return df


def with_lead(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Attach days_out and its bin, no filter."""
    return df.withColumn("days_out", days_out()).withColumn("d_bin", bin_floor("days_out", cfg))


def pacing_rows(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Rows usable for pacing: defaults filled, 0 <= days_out <= max_lead, binned."""
    return with_lead(fill_missing(df), cfg).where(in_lead_window("days_out", cfg))


def order_columns(df: DataFrame, cfg: PacingConfig = DEFAULT) -> list[str]:
    """Columns that fix the order of sales with equal days_out, sale_date first; an absent one is an error."""
    missing = [c for c in cfg.order_key if c not in df.columns]
    if missing:
        raise ValueError(f"Order key columns are missing: {', '.join(missing)}")
    return ["sale_date"] + [c for c in cfg.order_key if c != "sale_date"]


def known_sales(df: DataFrame, as_of: dt.date, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """With ``cfg.strict_as_of`` the sales up to the end of the as-of day, else all."""
    if not cfg.strict_as_of:
        return df
    return df.where(F.col("sale_date") < lit_ts(as_of + dt.timedelta(days=1)))


def past(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Events strictly before the as-of day."""
    return df.where(F.col("event_date") < lit_ts(as_of))


def upcoming(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Events on or after the as-of day."""
    return df.where(F.col("event_date") >= lit_ts(as_of))


def window_label(sale_date="sale_date", cfg: PacingConfig = DEFAULT) -> Column:
    """pre / bridge / post by sale date."""
    s = F.col(sale_date) if isinstance(sale_date, str) else sale_date
    return (F.when(s < lit_ts(cfg.pre_end), F.lit("pre"))
            .when(s >= lit_ts(cfg.post_start), F.lit("post"))
            .otherwise(F.lit("bridge")))


def pre_slice(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Sales before the pre-window end."""
    return df.where(F.col("sale_date") < lit_ts(cfg.pre_end))


def post_slice(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Sales on or after the post-window start."""
    return df.where(F.col("sale_date") >= lit_ts(cfg.post_start))


def periodize(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Drop rows without dates / qty, label Pre / Post by one split date."""
    d = df.na.drop(subset=["sale_date", "event_date", "qty_sold"])
    return d.withColumn("period", F.when(F.col("sale_date") < lit_ts(cfg.period_split), F.lit(PRE_LABEL))
                        .otherwise(F.lit(POST_LABEL)))


def slice_filter(df: DataFrame, seasons=None, channels=None, start: dt.date | None = None,
                 end: dt.date | None = None) -> DataFrame:
    """Conjunctive slice: seasons IN, channels IN, event_date within whole days.

    An empty list adds no predicate; the end bound covers the whole last day.
    Catalyst pushes these predicates to the scan.
    """
    cond = F.lit(True)
    if seasons:
        cond = cond & F.col("season").isin(list(seasons))
    if channels and "channel" in df.columns:
        cond = cond & F.col("channel").isin(list(channels))
    if start is not None and end is not None:
        end_ts = dt.datetime(end.year, end.month, end.day, 23, 59, 59)
        cond = cond & F.col("event_date").between(lit_ts(start), lit_ts(end_ts))
    return df.where(cond)


def default_seasons(df: DataFrame, keep: int = 5) -> DataFrame:
    """The last ``keep`` seasons by text order."""
    return (df.where(F.col("season").isNotNull()).select("season").distinct()
            .orderBy(F.col("season").desc()).limit(keep))


def all_seasons(df: DataFrame) -> DataFrame:
    """Every season, in text order."""
    return df.where(F.col("season").isNotNull()).select("season").distinct().orderBy("season")


def all_channels(df: DataFrame) -> DataFrame:
    """Every sales channel, in text order."""
    return df.where(F.col("channel").isNotNull()).select("channel").distinct().orderBy("channel")


def default_date_bounds(df: DataFrame, as_of: dt.date, first: dt.date = dt.date(2016, 1, 1)) -> DataFrame:
    """Event-date picker bounds: fixed start, min(latest event, as_of + 365 days)."""
    cap = F.lit(as_of + dt.timedelta(days=365))
    last = F.to_date(F.max("event_date"))
    return df.agg(F.lit(first).alias("min_event"),
                  F.when(last.isNull(), cap).otherwise(F.least(last, cap)).alias("max_event"))


def default_as_of(df: DataFrame) -> DataFrame:
    """Latest sale day at midnight."""
    return df.agg(F.to_date(F.max("sale_date")).alias("as_of"))
