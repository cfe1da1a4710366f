"""Running sums, cumulative shares and curve finishing."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..config import DEFAULT, PacingConfig
from ..functions.numeric import safe_ratio
from .prep import order_columns


def sale_order(df: DataFrame, cfg: PacingConfig = DEFAULT) -> list[Column]:
    """Booking order inside an event: farthest days_out first, then the sale key."""
    return [F.col("days_out").desc()] + [F.col(c).asc() for c in order_columns(df, cfg)]


# Names of the levels of booking order, coarse to fine, and of the running sum inside the finest one.
DAY, TIME, SLOT, LOCAL = "_rs_day", "_rs_time", "_rs_slot", "_rs_local"
_LOW, _HIGH = -(1 << 62), 1 << 62


def booking_levels(df: DataFrame, cfg: PacingConfig = DEFAULT) -> dict[str, Column]:
    """The levels, by name, that split a key's sales in booking order into bounded stretches.

    ``DAY`` is days_out turned round; ``TIME`` the minute of the sale; ``SLOT`` splits the sales dated exactly at that
    minute (all of them where sales carry dates only) by ranges of ``cfg.order_span`` of the first order column, if
    that is a number; later sales of the minute come last. (DAY, TIME, SLOT) never falls along the booking
    order, so a running sum is the sum of all earlier stretches and a running sum inside its own.
    """
    first = next((c for c in order_columns(df, cfg) if c != "sale_date"), None)
    sale = F.col("sale_date")
    minute = F.unix_date(F.to_date(sale)).cast("long") * 1440 + F.hour(sale) * 60 + F.minute(sale)
    slot = order_slot(df, first, cfg) if first else F.lit(0)
    return {
        DAY: F.coalesce(-F.col("days_out").cast("long"), F.lit(_HIGH)), TIME: F.coalesce(minute, F.lit(_LOW)),
        SLOT: F.when(F.date_part(F.lit("SECOND"), sale) == 0, slot).otherwise(F.lit(_HIGH)).cast("long")}


def order_slot(df: DataFrame, column: str, cfg: PacingConfig = DEFAULT) -> Column:
    """Range of ``cfg.order_span`` values that a number of an order column lies in; 0 for columns of other types."""
    if not isinstance(df.schema[column].dataType, NumericType):
        return F.lit(0).cast("long")
    # A number beyond the bounds keeps its place before or after all others; NULL sorts first.
    number = F.least(F.greatest(F.col(column).cast("double") / cfg.order_span, F.lit(-1e15)), F.lit(1e15))
    return F.coalesce(F.floor(number).cast("long"), F.lit(_LOW))


def _local_sums(df: DataFrame, key: str, cfg: PacingConfig, qty: str, ties: list[str] | None = None) -> DataFrame:
    """Add the levels and the running sum inside a stretch: one sort of each (key, DAY, TIME, SLOT).

    ``ties`` order rows that the booking order leaves equal. The window names the minute first: the sort then mostly compares
    one number of a row, not the keys' texts.
    """
    rows = df.withColumns(booking_levels(df, cfg))
    w = (Window.partitionBy(TIME, SLOT, key, DAY).orderBy(*[F.col(c).asc() for c in [*order_columns(df, cfg), *(ties or [])]])
         .rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(LOCAL, F.sum(F.coalesce(F.col(qty).cast("double"), F.lit(0.0))).over(w))


def stretch_sums(df: DataFrame, key: str, cfg: PacingConfig = DEFAULT, qty: str = "qty_sold",
                 carry: dict[str, Column] | None = None, ties: list[str] | None = None) -> DataFrame:
    """One row per (key, DAY, TIME, SLOT): its sum, highest running sum, and what its day's earlier stretches hold.

    Columns ``_rs_sum``, ``_rs_top`` (rows without qty don't count; NULL if no row has one) and ``_rs_before``.
    ``carry`` adds aggregates of the rows of a stretch.
    """
    has_qty = F.col(qty).isNotNull()
    # With ties the caller's key is never NULL, and a filter would make another plan of the same rows.
    g = (_local_sums(df if ties else df.where(F.col(key).isNotNull()), key, cfg, qty, ties).groupBy(key, DAY, TIME, SLOT)
         .agg(F.sum(F.coalesce(F.col(qty).cast("double"), F.lit(0.0))).alias("_rs_sum"),
              F.max(F.when(has_qty, F.col(LOCAL))).alias("_rs_top"), *[c.alias(n) for n, c in (carry or {}).items()]))
    earlier = Window.partitionBy(key, DAY).orderBy(TIME, SLOT).rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("_rs_before", F.coalesce(F.sum("_rs_sum").over(earlier), F.lit(0.0)))


def day_sums(stretches: DataFrame, key: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per (key, DAY): ``_rs_offset`` = what earlier days hold, ``_rs_day_top`` the day's highest running
    sum and ``final_qty`` the key's. ``carry`` adds aggregates of the day's stretches."""
    days = stretches.groupBy(key, DAY).agg(
        F.sum("_rs_sum").alias("_rs_day_sum"), F.max(F.col("_rs_before") + F.col("_rs_top")).alias("_rs_top"),
        *[c.alias(n) for n, c in (carry or {}).items()])
    earlier = Window.partitionBy(key).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_rs_offset", F.coalesce(F.sum("_rs_day_sum").over(earlier), F.lit(0.0)))
    days = days.withColumn("_rs_day_top", F.col("_rs_offset") + F.col("_rs_top")).drop("_rs_day_sum", "_rs_top")
    return days.withColumn("final_qty", F.max("_rs_day_top").over(Window.partitionBy(key)))


def share_of_final(cum, final, positive_final: bool = False) -> Column:
    """100 * cum / final: NULL where the final is 0 or, with ``positive_final``, not above 0."""
    final = F.col(final) if isinstance(final, str) else final
    return F.lit(100.0) * safe_ratio(F.col(cum) if isinstance(cum, str) else cum,
                                     F.when(final > 0, final) if positive_final else final)


def running_share(df: DataFrame, key: str, cfg: PacingConfig = DEFAULT, qty: str = "qty_sold",
                  pct_col: str = "cum_pct", positive_final: bool = False, one_shuffle: bool = False) -> DataFrame:
    """Running qty per ``key`` in booking order; final = peak of the running sum.

    Adds ``cum_qty``, ``final_qty`` and ``pct_col`` (:func:`share_of_final`). A row without qty adds nothing and
    has no cum_qty; a row without key has neither sum; NaN makes every later sum of its key NaN.

    The order is cut into levels (:func:`booking_levels`): sums per day and per stretch of a day give what
    comes before a stretch, a window inside the stretch gives the rest. No task needs all sales of a key, the
    tables between have one row per stretch, and the rows are shuffled once.

    With ``one_shuffle`` the stretches are summed from the rows' own shuffle, so the input is read once: both readings sort by
    all columns of ``df``, which Spark then can't prune on one side only, and rows without key have a stretch key too.
    """
    part, ties, has_key = key, None, F.col(key).isNotNull()
    rows = df
    if one_shuffle:
        part, has_key = "_rs_key", F.col("_rs_key") != ""
        ties = [c for c in df.columns if c not in order_columns(df, cfg)]
        rows = df.withColumn(part, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
        if df.schema[key].dataType == StringType() and key in ties:
            # The stretch key holds a text key, which isn't shuffled beside it.
            rows, ties = rows.drop(key), [c for c in ties if c != key]
        # The rows are dealt by their stretch, whose levels are worked out after the shuffle.
        rows = rows.repartition(part, *booking_levels(rows, cfg).values())
    # Both sides of this join name the same columns of the stretches (one without qty needs no start): Spark runs them once.
    stretches = stretch_sums(rows, part, cfg, qty, ties=ties)
    days = day_sums(stretches, part).drop("_rs_day_top")
    offsets = (stretches.join(days, [part, DAY])
               .select(*[F.col(c).alias(f"_o{c}") for c in (part, DAY, TIME, SLOT)],
                       F.when(F.col("_rs_top").isNotNull(), F.col("_rs_offset") + F.col("_rs_before")).alias("_rs_start"), "final_qty"))
    same = [F.col(c) == F.col(f"_o{c}") for c in (part, DAY, TIME, SLOT)]
    out = _local_sums(rows, part, cfg, qty, ties).join(offsets, reduce(lambda a, b: a & b, same), "left")
    out = out.withColumns({"cum_qty": F.when(F.col(qty).isNotNull() & has_key, F.col("_rs_start") + F.col(LOCAL)),
                           "final_qty": F.when(has_key, F.col("final_qty"))})
    if key not in out.columns:
        out = out.withColumn(key, F.when(has_key, F.expr(f"substring({part}, 2)")))
    out = out.withColumn(pct_col, share_of_final("cum_qty", "final_qty", positive_final))
    return out.select(*df.columns, "cum_qty", "final_qty", pct_col)


def grid_cum_share(rows: DataFrame, event_keys: list[str], cfg: PacingConfig = DEFAULT, qty: str = "qty_sold",
                   scale: float = 1.0) -> DataFrame:
    """Cumulative share per event over the full bin grid, max_lead -> 0.

    One aggregation per event computes the sum of every bin (map-side
    combined, so the shuffle carries one row per event and task), then the
    running sums over the fixed grid are plain column arithmetic and one
    ``posexplode`` turns them into (event, d_bin, cum_share) rows. Bins without
    sales carry the running value on; a zero total gives NULL shares.
    """
    bins_desc = cfg.bins[::-1]
    q = F.col(qty)
    sums = [F.sum(F.when(F.col("d_bin") == b, q)).alias(f"_b{b}") for b in bins_desc]
    wide = rows.groupBy(*event_keys).agg(*sums)
    per_bin = F.array(*[F.coalesce(F.col(f"_b{b}").cast("double"), F.lit(0.0)) for b in bins_desc])
    long = wide.select(*event_keys, F.posexplode(per_bin).alias("_pos", "_q"))
    # The aggregation already clusters rows by event: this window adds no exchange.
    w = Window.partitionBy(*event_keys).orderBy("_pos")
    long = (long.withColumn("_cum", F.sum("_q").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("event_total", F.sum("_q").over(Window.partitionBy(*event_keys))))
    return long.select(*event_keys,
                       (F.lit(cfg.max_lead) - F.col("_pos") * cfg.bin_size).cast("int").alias("d_bin"),
                       "event_total", (F.lit(scale) * safe_ratio("_cum", "event_total")).alias("cum_share"))


def finish_curve(curve: DataFrame, cols: list[str], hi: float, band: tuple[str, str, str] | None = None,
                 d_bin: str = "d_bin") -> DataFrame:
    """Forward fill (max_lead -> 0), NULL -> 0, running max, clip [0, hi].

    Then optionally force p25 <= median <= p75 (W7). Runs on one row per
    bin, so the window without a partition stays a tiny single task.
    """
    w = Window.orderBy(F.col(d_bin).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = curve
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.last(F.col(c), ignorenulls=True).over(w), F.lit(0.0)))
        out = out.withColumn(c, F.least(F.greatest(F.max(F.col(c)).over(w), F.lit(0.0)), F.lit(float(hi))))
    if band:
        lo, mid, up = band
        out = out.withColumn(lo, F.least(F.col(lo), F.col(mid))).withColumn(up, F.greatest(F.col(up), F.col(mid)))
    return out


def centered_mean3(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Mean of the previous, current and next row; NULL at both ends.

    One row per month, so the unpartitioned window is small.
    """
    w = Window.orderBy(order).rowsBetween(-1, 1)
    return df.withColumn(out, F.when(F.count(F.col(value)).over(w) == 3, F.avg(value).over(w)))
