"""Shares, per-event averages and period comparisons."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, DEFAULT_CATEGORY, POST_LABEL, PRE_LABEL, PacingConfig
from ..functions.classify import collab_category, label_event_type
from ..functions.numeric import safe_ratio
from .prep import lit_ts, periodize


def category_share(df: DataFrame, group_col: str = "event_type", label: str = "event_type") -> DataFrame:
    """Share of qty per group, NULL group kept; a zero grand total gives 0 (A1).

    The grand total is one row over the same aggregate, read as a scalar; Spark runs the aggregate once.
    """
    g = df.groupBy(group_col).agg(F.coalesce(F.sum("qty_sold"), F.lit(0.0)).alias("qty_sold"))
    total = g.agg(F.sum("qty_sold")).scalar()
    return g.select(F.col(group_col).alias(label), safe_ratio(F.col("qty_sold"), total, 0.0).alias("share_ratio"))


def average_tickets_per_event(df: DataFrame, label: str) -> DataFrame:
    """Total qty / distinct event instances per event type, NULL types dropped (A2)."""
    g = (df.groupBy("event_type")
         .agg(F.coalesce(F.sum("qty_sold"), F.lit(0.0)).alias("total_qty"),
              F.count_distinct("event_instance").alias("event_count"), F.count("event_type").alias("_typed")))
    return (g.where((F.col("event_count") > 0) & (F.col("_typed") > 0))
            .select("event_type", (F.col("total_qty") / F.col("event_count")).alias("avg_tickets"),
                    F.lit(label).alias("window")))


def window_labels(cfg: PacingConfig = DEFAULT) -> tuple[str, str]:
    """'Pre (sale < Mar 1 2020)' / 'Post (sale ≥ Jul 1 2021)' for the configured dates."""
    a, b = cfg.pre_end, cfg.post_start
    return (f"Pre (sale < {a:%b} {a.day} {a.year})", f"Post (sale ≥ {b:%b} {b.day} {b.year})")


def avg_tickets_pre_post(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """A2 for the pre and the post window, stacked with their labels."""
    pre_l, post_l = window_labels(cfg)
    pre = average_tickets_per_event(df.where(F.col("sale_date") < lit_ts(cfg.pre_end)), pre_l)
    post = average_tickets_per_event(df.where(F.col("sale_date") >= lit_ts(cfg.post_start)), post_l)
    return pre.unionByName(post)


def events_common(df: DataFrame, cfg: PacingConfig = DEFAULT, top_n: int | None = None) -> DataFrame:
    """Events sold in both windows, top by combined qty.

    One aggregation with conditional sums replaces the two per-window
    aggregations and their key intersection.
    """
    top_n = cfg.top_events if top_n is None else top_n
    pre = F.col("sale_date") < lit_ts(cfg.pre_end)
    post = F.col("sale_date") >= lit_ts(cfg.post_start)
    q = F.coalesce(F.col("qty_sold"), F.lit(0.0))
    g = (df.groupBy("event_name")
         .agg(F.sum(F.when(pre, q)).alias("qty_pre"), F.sum(F.when(post, q)).alias("qty_post"),
              F.count_if(pre).alias("_npre"), F.count_if(post).alias("_npost"), F.count("event_name").alias("_named")))
    g = g.where((F.col("_npre") > 0) & (F.col("_npost") > 0) & (F.col("_named") > 0))
    return (g.orderBy((F.col("qty_pre") + F.col("qty_post")).desc(), F.col("event_name"))
            .limit(top_n).select("event_name", "qty_pre", "qty_post"))


def _ensure(df: DataFrame) -> DataFrame:
    """Rows with a sale date, name and qty; qty NULL -> 0."""
    return df.na.drop(subset=["sale_date", "event_name", "qty_sold"]).withColumn(
        "qty_sold", F.coalesce(F.col("qty_sold").cast("double"), F.lit(0.0)))


def category_totals(df: DataFrame, cfg: PacingConfig = DEFAULT, drop_other: bool = True) -> DataFrame:
    """Qty per regex category of the event name, the unmapped bucket dropped (A4).

    Sales are summed per name first, so the patterns are tried once per name.
    """
    names = _ensure(df).groupBy("event_name").agg(F.sum("qty_sold").alias("qty_sold"))
    g = (names.withColumn("event_category", collab_category("event_name", cfg))
         .groupBy("event_category").agg(F.sum("qty_sold").alias("qty_sold")))
    return g.where(F.col("event_category") != DEFAULT_CATEGORY) if drop_other else g


def categories_pre(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """A4 on sales before the pre-window end (A5)."""
    return category_totals(df.where(F.col("sale_date") < lit_ts(cfg.pre_end)), cfg)


def categories_post(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """A4 on sales from the post-window start (A5)."""
    return category_totals(df.where(F.col("sale_date") >= lit_ts(cfg.post_start)), cfg)


def top_categories_pre_post(df: DataFrame, cfg: PacingConfig = DEFAULT, top_n: int | None = None) -> DataFrame:
    """Top categories by pre volume with their post volume, 0 when absent."""
    top_n = cfg.top_categories if top_n is None else top_n
    pre = F.col("sale_date") < lit_ts(cfg.pre_end)
    post = F.col("sale_date") >= lit_ts(cfg.post_start)
    names = _ensure(df).groupBy("event_name").agg(
        F.sum(F.when(pre, F.col("qty_sold"))).alias("qty_pre"), F.sum(F.when(post, F.col("qty_sold"))).alias("qty_post"),
        F.count_if(pre).alias("_npre"))
    g = (names.withColumn("event_category", collab_category("event_name", cfg)).groupBy("event_category")
         .agg(F.sum("qty_pre").alias("qty_pre"), F.coalesce(F.sum("qty_post"), F.lit(0.0)).alias("qty_post"),
              F.sum("_npre").alias("_npre")))
    g = g.where((F.col("_npre") > 0) & (F.col("event_category") != DEFAULT_CATEGORY))
    return g.orderBy(F.col("qty_pre").desc(), "event_category").limit(top_n).select(
        "event_category", "qty_pre", "qty_post")


def avg_tickets_by_type(df: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Avg tickets per (name, date) event by type label and period, both periods per type.

    Per-event sums first, then distinct names and total per (type, period);
    a type missing in a period gets zeros. The two periods come from
    conditional aggregates per type, so no type x period cross product is joined.
    """
    d = periodize(df, cfg)
    et = F.col("event_type") if "event_type" in d.columns else None
    ep = F.col("event_part") if "event_part" in d.columns else None
    # Whether any row has a type is known only after all are read: the sums carry both labels and the flag.
    typed = F.max(et.isNotNull()) if et is not None else F.max(F.lit(False))
    d = d.withColumns({"_with": label_event_type(et, ep, F.lit(True)), "_without": label_event_type(et, ep, F.lit(False))})
    ev = d.where(F.col("event_name").isNotNull()).groupBy("_with", "_without", "period", "event_name", "event_date").agg(
        F.sum("qty_sold").alias("tickets_event"), typed.alias("_typed"))
    has_type = ev.agg(F.struct(F.max("_typed").alias("t"), F.count("tickets_event").alias("n")).alias("s")).scalar()
    ev = ev.where(F.col("_typed").isNotNull()).withColumn("etype", F.when(has_type.getField("t"), F.col("_with")).otherwise(F.col("_without")))
    per = F.col("period")
    g = ev.groupBy("etype").agg(
        *[x for lab in (PRE_LABEL, POST_LABEL) for x in (
            F.count_distinct(F.when(per == lab, F.col("event_name"))).alias(f"n_{lab}"),
            F.coalesce(F.sum(F.when(per == lab, F.col("tickets_event"))), F.lit(0.0)).alias(f"t_{lab}"))])
    rows = F.array(*[F.struct(F.lit(lab).alias("period"), F.col(f"n_{lab}").cast("long").alias("n_events"),
                              F.col(f"t_{lab}").cast("double").alias("total_tickets")) for lab in (PRE_LABEL, POST_LABEL)])
    out = g.select("etype", F.explode(rows).alias("r")).select("etype", "r.*")
    return out.withColumn("avg_tickets_per_event",
                          F.when(F.col("n_events") > 0, F.col("total_tickets") / F.col("n_events")).otherwise(0.0))


def pick_top_types(by_type: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Keep the top-k type labels by total tickets over both periods.

    The top list has at most k rows, so its broadcast has a fixed bound.
    """
    top = (by_type.groupBy("etype").agg(F.sum("total_tickets").alias("_t"))
           .orderBy(F.col("_t").desc(), "etype").limit(cfg.top_k_types).select("etype"))
    return by_type.join(F.broadcast(top), "etype", "left_semi")


def share_shift(pre_share: DataFrame, post_share: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Shares re-normalised to 100 per window; unmapped kept only from 5 %.

    If that filter leaves nothing, every row is kept. Works on the small
    share tables (one row per type and window).
    """
    comb = (pre_share.withColumn("window", F.lit("Pre"))
            .unionByName(post_share.withColumn("window", F.lit("Post"))))
    w = Window.partitionBy("window")
    s = F.sum("share_ratio").over(w)
    comb = comb.withColumn("share_pct", F.when(s > 0, F.col("share_ratio") / s * 100.0).otherwise(0.0))
    keep = (~F.col("event_type").eqNullSafe(F.lit(DEFAULT_CATEGORY))) | (F.col("share_ratio") >= cfg.share_min_other)
    comb = comb.withColumn("_keep", keep)
    some = comb.agg(F.max("_keep")).scalar()
    return comb.where(F.col("_keep") | ~some).select("window", "event_type", "share_ratio", "share_pct")
