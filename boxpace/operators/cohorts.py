"""Cohort libraries and cohort resolution.

A cohort tier is a tuple of key columns (``cfg.tiers``, most specific first,
the empty tuple = all events). Instead of one pass per tier, every row is
expanded once into one copy per tier, with the keys outside the tier set to
NULL, and a single aggregation handles all tiers (the same plan shape as
GROUPING SETS). Rows with a NULL in one of their tier's own keys are left out
of that tier, as a pandas groupby would drop them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, TIER_LABELS, PacingConfig, tier_name
from .quantiles import group_quantiles, null_safe_join, quantiles_of_buckets, value_bucket

# Coarse buckets to a factor of e, four times as many as in group_quantiles: a bin's shares lie close together, so wider ones
# would let many sales through that are near no rank.
COARSE_PER_E = 1 << 10
# Coarse buckets in a range: sales are dealt to tasks by cohort, bin and range.
RANGE = 64


def tier_keys(cfg: PacingConfig = DEFAULT) -> list[str]:
    """Union of the tier key columns, in first-seen order."""
    seen: list[str] = []
    for t in cfg.tiers:
        for k in t:
            if k not in seen:
                seen.append(k)
    return seen


def global_rank(cfg: PacingConfig = DEFAULT) -> int | None:
    for i, t in enumerate(cfg.tiers):
        if not t:
            return i
    return None


def explode_tiers(df: DataFrame, cfg: PacingConfig = DEFAULT, ranks: list[int] | None = None,
                  prefix: str | None = None) -> DataFrame:
    """One copy of each row per tier whose own keys are all non-NULL.

    Adds ``tier_rank`` and ``tier``; key columns outside the copy's tier are
    NULL. With ``prefix`` the masked keys get new names and the originals stay.
    """
    keys = tier_keys(cfg)
    structs = []
    for rank, tier in enumerate(cfg.tiers):
        if ranks is not None and rank not in ranks:
            continue
        cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in tier], F.lit(True))
        st = F.struct(F.lit(rank).alias("tier_rank"), F.lit(tier_name(tier)).alias("tier"),
                      *[(F.col(k) if k in tier else F.lit(None)).cast("string").alias((prefix or "") + k)
                        for k in keys])
        structs.append(F.when(cond, st))
    rest = df.columns if prefix else [c for c in df.columns if c not in keys]
    return (df.select(*rest, F.explode(F.array_compact(F.array(*structs))).alias("_t"))
              .select(*rest, "_t.*"))


def cohort_figures(rows: DataFrame, cfg: PacingConfig = DEFAULT, pct: str = "hist_cum_pct", final: str = "final_qty",
                   event: str = "event_name", kinds: tuple[bool, ...] = (True, False)) -> DataFrame:
    """Per tier and keys: (tier_rank, tier, keys..., at_bin, d_bin, median, n), the ``at_bin`` ones of ``kinds``.

    With ``at_bin`` the row is about one ``d_bin``: the median of pct over the sale rows and the distinct events there.
    Without, it is about all bins: the median of the events' finals over the sale rows (a long event weighs more, as
    in the source) and the distinct events. Both medians are one selection over (value, row count) pairs; a final, constant per
    event, has one pair per event and keys.

    Sale rows are counted by event, keys, bin and coarse bucket of pct, and only these counts are expanded into tiers. The rows
    are dealt by keys, bin and a range of buckets, so a cohort's counts lie in a few tasks and no task has a whole
    wide one. The values near a rank are read from the same shuffle: counts and values both name the event, the final and the
    value of a row, which Spark then can't prune on one side only.
    """
    keys = tier_keys(cfg)
    group = ["tier_rank", *keys, "at_bin", "d_bin"]
    sales = rows.select(F.col(event).alias("event"), *keys, F.col("d_bin").cast("int").alias("d_bin"),
                        F.col(pct).cast("double").alias("_v"), F.col(final).cast("double").alias("final"))
    dealt = [*keys, "d_bin", "_range"]
    sales = (sales.withColumn("_range", F.floor(value_bucket(F.col("_v"), COARSE_PER_E) / RANGE)).repartition(*dealt)
             .withColumn("_z", value_bucket(F.col("_v"), COARSE_PER_E)))
    # All readers of the counts name their count and their grouping columns only, so that they share one shuffle.
    cells = sales.groupBy("event", *dealt, "_z", "final").agg(F.count(F.lit(1)).alias("_c"))
    at, whole, no_bin = F.lit(True).alias("at_bin"), F.lit(False).alias("at_bin"), F.lit(None).cast("int").alias("d_bin")
    finals = (cells.groupBy("event", *keys, "final").agg(F.sum("_c").alias("_c"))
              .select("event", *keys, whole, no_bin, F.col("final").alias("_v"), "_c")
              .withColumn("_z", value_bucket(F.col("_v"), COARSE_PER_E)))
    here = cells.groupBy(*dealt, "_z").agg(F.sum("_c").alias("_c")).select(*keys, at, "d_bin", "_z", "_c")
    # A row without event or final has no value.
    one = F.when(F.col("event").isNull() | F.col("final").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    values = sales.select(*keys, at, "d_bin", "_v", one.alias("_c"), "_z")

    def both(of_bins, of_all):
        return of_bins.unionByName(of_all) if len(kinds) == 2 else of_bins if kinds[0] else of_all
    buckets = (explode_tiers(both(here, finals.drop("event", "_v")), cfg).drop("tier").groupBy(*group, "_z")
               .agg(F.sum("_c").alias("_c")))
    values = both(values, finals.drop("event"))
    places = [[F.lit(rank), *[(F.col(k) if k in tier else F.lit(None)).cast("string") for k in keys], F.col("at_bin"), F.col("d_bin"),
               F.col("_z")] for rank, tier in enumerate(cfg.tiers)]
    medians = quantiles_of_buckets(values, buckets, group, {"median": 0.5},
                                   expand=lambda near: explode_tiers(near, cfg).drop("tier"), places=places)
    # Distinct events: a row per event, keys and bin, then per cohort.
    seen = both(cells.where(F.col("_c") > 0).groupBy("event", *dealt).agg(F.lit(1).alias("_one")).select("event", *keys, at, "d_bin"),
                finals.where(F.col("_c") > 0).select("event", *keys, "at_bin", "d_bin"))
    events = explode_tiers(seen, cfg).groupBy(*group, "event").agg(F.lit(1).alias("_one")).groupBy(*group).agg(F.count("event").alias("n"))
    names = F.array(*[F.lit(tier_name(t)) for t in cfg.tiers])
    return null_safe_join(medians, events, group).withColumn("tier", F.element_at(names, F.col("tier_rank") + 1))


def cohort_library(rows: DataFrame, cfg: PacingConfig = DEFAULT, pct: str = "hist_cum_pct",
                   final: str = "final_qty", event: str = "event_name") -> tuple[DataFrame, DataFrame]:
    """Medians and finals by tier.

    medians: (tier_rank, tier, keys..., d_bin, median_pct, n) with n the distinct events at the bin; finals:
    (tier_rank, tier, keys..., median_final, n_events). Both medians are over sale rows (:func:`cohort_figures`).
    """
    keys = ["tier_rank", "tier", *tier_keys(cfg)]
    medians, finals = (cohort_figures(rows, cfg, pct, final, event, (kind,)) for kind in (True, False))
    return (medians.select(*keys, "d_bin", F.col("median").alias("median_pct"), "n"),
            finals.select(*keys, F.col("median").alias("median_final"), F.col("n").alias("n_events")))


def cohort_stats(pacing: DataFrame, cfg: PacingConfig = DEFAULT) -> DataFrame:
    """p25 / median / p75 of cum_pct and instances per tier and bin.

    ``pacing`` has one row per (event_instance, d_bin), as :func:`curves.event_pacing` gives.
    """
    keys = tier_keys(cfg)
    tiered = explode_tiers(pacing.where(F.col("event_instance").isNotNull()).select(*keys, "d_bin", "cum_pct"), cfg)
    return group_quantiles(tiered, ["tier_rank", "tier", *keys, "d_bin"], "cum_pct",
                           {"median_cum_pct": 0.5, "p25_cum_pct": 0.25, "p75_cum_pct": 0.75}, cfg, n_rows="sample_size")


def resolve_figures(events: DataFrame, figures: DataFrame, key_cols: list[str], cfg: PacingConfig) -> DataFrame:
    """:func:`resolve_cohorts` on the combined ``figures`` (:func:`cohort_figures`), which are read once."""
    keys = tier_keys(cfg)
    last, none = len(cfg.tiers) + 1, len(cfg.tiers) + 2  # ranks of the last resort and of the first final
    # A cohort's final next to each of its medians.
    cohort = Window.partitionBy("tier_rank", "tier", *keys)
    f = figures.withColumn("_f", F.first(F.when(~F.col("at_bin"), F.struct("median", "n")), ignorenulls=True).over(cohort))
    # Every row says what it stands for: its own cohort, the last resort of its bin (a median of medians), and the
    # library's first final. Each becomes one candidate row.
    place = F.struct("tier_rank", "tier", *[F.col(k) for k in keys])

    def role(rank, masked, d_bin):
        return F.struct(F.lit(rank).alias("_rank") if isinstance(rank, int) else rank.alias("_rank"),
                        *[(F.lit(None).cast("string") if masked else F.col(k)).alias(f"_k_{k}") for k in keys], d_bin.alias("_bin"))
    nowhere = F.lit(None).cast("int")
    own = F.when(F.col("at_bin") & (F.col("n") >= cfg.min_cohort) & F.col("_f").isNotNull(), role(F.col("tier_rank"), False, F.col("d_bin")))
    roles = F.array_compact(F.array(own, F.when(F.col("at_bin"), role(last, True, F.col("d_bin"))),
                                    F.when(~F.col("at_bin"), role(none, True, nowhere))))
    said = f.select(F.explode(roles).alias("_c"), place.alias("_place"), "median", "n", "_f").select("_c.*", "_place", "median", "n", "_f")
    place_keys = ["_rank", *[f"_k_{k}" for k in keys], "_bin"]
    # One value per cohort: an own cohort's median is its one value, the last resort the median of the cohorts' medians.
    cand = said.groupBy(*[F.col(c).alias(f"_c{c}") for c in place_keys]).agg(F.struct(
        F.first("_rank").alias("tier_rank"), F.percentile("median", F.lit(0.5)).alias("median_at_d"), F.sum("n").cast("long").alias("n"),
        F.min_by("_f.median", "_place").cast("double").alias("baseline_final"), F.min_by("_f.n", "_place").cast("long").alias("n_final"),
        F.min_by("median", "_place").cast("double").alias("first_final"), F.min_by("n", "_place").cast("long").alias("first_n")).alias("_cand"))

    # Events ask for each of their tiers, for the last resort of their bin, and for the first final.
    asks = []
    for rank, tier in enumerate(cfg.tiers):
        has = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in tier], F.lit(True))
        asks.append(F.when(has, F.struct(F.lit(rank).alias("_rank"), *[
            (F.col(k).cast("string") if k in tier else F.lit(None).cast("string")).alias(f"_k_{k}") for k in keys],
            F.col("d_bin").cast("int").alias("_bin"))))
    asks += [role(last, True, F.col("d_bin").cast("int")), role(none, True, nowhere)]
    payload = [c for c in events.columns if c not in key_cols]
    asked = events.select(*events.columns, F.explode(F.array_compact(F.array(*asks))).alias("_q"))
    asked = asked.select(*events.columns, *[F.col(f"_q.{c}").alias(c) for c in place_keys])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in place_keys])
    hit = asked.join(cand, match, "left")
    rank, c = F.col("_rank"), F.col("_cand")
    best = hit.groupBy(*key_cols).agg(
        F.any_value(F.struct(*payload)).alias("_p") if payload else F.any_value(F.lit(1)).alias("_p"),
        F.min_by(F.when(rank < last, c), F.when((rank < last) & c.isNotNull(), rank)).alias("_own"),
        F.max(F.when(rank == last, c)).alias("_last"), F.max(F.when(rank == none, c)).alias("_none"))
    own = F.col("_own").isNotNull()
    tiers = F.element_at(F.array(*[F.lit(tier_name(t)) for t in cfg.tiers]), F.col("_own.tier_rank") + 1)

    def pick(name, spare):
        return F.when(own, F.col(f"_own.{name}")).otherwise(spare).alias(name)
    no_bin = F.col("_last.n").isNull()
    return best.select(
        *key_cols, *[F.col(f"_p.{c}").alias(c) for c in payload],
        pick("tier_rank", F.lit(last)), F.when(own, tiers).otherwise(F.lit("all")).alias("tier"),
        pick("median_at_d", F.when(no_bin, F.lit(0.0)).otherwise(F.col("_last.median_at_d"))),
        pick("n", F.coalesce(F.col("_last.n"), F.lit(0)).cast("long")),
        pick("baseline_final", F.coalesce(F.col("_none.first_final"), F.lit(1.0))),
        pick("n_final", F.coalesce(F.col("_none.first_n"), F.lit(0)).cast("long")))


def resolve_cohorts(events: DataFrame, medians: DataFrame, finals: DataFrame, key_cols: list[str],
                    cfg: PacingConfig = DEFAULT) -> DataFrame:
    """Pick per event the most specific tier with n >= min_cohort at its bin.

    ``events`` has one row per ``key_cols`` with the tier keys and ``d_bin``. Candidates are the eligible cohorts of every
    tier, a last resort per bin (the median of all cohort medians there with the sum of their n) and the finals of the
    first cohort in tier and key order. Events ask for each of these by null-safe keys in one equi-join; the asked side of a
    hot key, such as the global tier, is split by AQE if the candidates are too large to broadcast. Without any cohort the
    median is 0.0, n and n_final 0 and the final 1.0. The event's other columns ride along.

    Adds tier, tier_rank, median_at_d, n, baseline_final, n_final.
    """
    keys = ["tier_rank", "tier", *tier_keys(cfg)]
    figures = (medians.select(*keys, F.lit(True).alias("at_bin"), F.col("d_bin").cast("int").alias("d_bin"),
                              F.col("median_pct").alias("median"), "n")
               .unionByName(finals.select(*keys, F.lit(False).alias("at_bin"), F.lit(None).cast("int").alias("d_bin"),
                                          F.col("median_final").alias("median"), F.col("n_events").alias("n"))))
    return resolve_figures(events, figures, key_cols, cfg)


def cohort_label(tier: Column, n: Column, cfg: PacingConfig = DEFAULT) -> Column:
    """'<tier label> (n=<n>)' plus ': key · key' for the tier's keys (F16)."""
    expr = None
    for t in cfg.tiers:
        name = tier_name(t)
        text = [F.lit(TIER_LABELS.get(name, name)), F.lit(" (n="), n.cast("string"), F.lit(")")]
        if t:
            text.append(F.lit(": "))
            for i, k in enumerate(t):
                if i:
                    text.append(F.lit(" · "))
                text.append(F.coalesce(F.col(k).cast("string"), F.lit("Unknown")))
        cond = tier == name
        expr = F.when(cond, F.concat(*text)) if expr is None else expr.when(cond, F.concat(*text))
    return expr.otherwise(F.concat(tier, F.lit(" (n="), n.cast("string"), F.lit(")")))
