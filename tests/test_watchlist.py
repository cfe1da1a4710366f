"""Watchlist pieces: running sums, cohort resolution, last resort (W2, J6, quirks 1-8)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from boxpace.config import PacingConfig
from boxpace.operators.cohorts import cohort_library, resolve_cohorts, tier_keys
from boxpace.operators.cumulate import running_share
from boxpace.plans import watchlist as W
from boxpace.sources import tables as T

CFG = PacingConfig(order_key=("k",))


def test_running_share_uses_name_across_dates(spark):
    # F-multi-date: one name with a past and an upcoming date shares one running sum.
    rows = [("A", dt.datetime(2020, 5, 1), 30, 2.0, 1), ("A", dt.datetime(2021, 5, 1), 10, 2.0, 2),
            ("A", dt.datetime(2021, 5, 1), 10, 4.0, 3)]
    df = spark.createDataFrame(rows, "event_name string, event_date timestamp_ntz, days_out int, qty_sold double, "
                                     "k int").withColumn("sale_date", F.col("event_date"))
    got = sorted((r["k"], r["cum_qty"], r["final_qty"]) for r in running_share(df, "event_name", CFG).collect())
    assert got == [(1, 2.0, 8.0), (2, 4.0, 8.0), (3, 8.0, 8.0)]


def _lib(spark):
    med = spark.createDataFrame(
        [(0, "event_type|weekday|venue", "T", "Monday", "V", 3, 40.0, 5),
         (1, "event_type|weekday", "T", "Monday", None, 3, 50.0, 8),
         (2, "event_type", "T", None, None, 3, 60.0, 12),
         (3, "all", None, None, None, 3, 70.0, 15)],
        "tier_rank int, tier string, event_type string, weekday string, venue string, d_bin int, median_pct double, n bigint")
    fin = spark.createDataFrame(
        [(0, "event_type|weekday|venue", "T", "Monday", "V", 90.0, 5),
         (1, "event_type|weekday", "T", "Monday", None, 80.0, 8),
         (2, "event_type", "T", None, None, 70.0, 12),
         (3, "all", None, None, None, 60.0, 15)],
        "tier_rank int, tier string, event_type string, weekday string, venue string, median_final double, n_events bigint")
    ev = spark.createDataFrame([("E", "T", "Monday", "V", 3), ("F", "T", "Monday", "V", 6)],
                               "event_name string, event_type string, weekday string, venue string, d_bin int")
    return med, fin, ev


@pytest.mark.parametrize("min_cohort,tier,median,n,final", [
    (5, "event_type|weekday|venue", 40.0, 5, 90.0),
    (8, "event_type|weekday", 50.0, 8, 80.0),
    (12, "event_type", 60.0, 12, 70.0),
    (15, "all", 70.0, 15, 60.0),
])
def test_resolution_ladder(spark, min_cohort, tier, median, n, final):
    med, fin, ev = _lib(spark)
    r = {x["event_name"]: x for x in resolve_cohorts(ev, med, fin, ["event_name"],
                                                     PacingConfig(min_cohort=min_cohort)).collect()}
    assert (r["E"]["tier"], r["E"]["median_at_d"], r["E"]["n"], r["E"]["baseline_final"]) == (tier, median, n, final)


def test_last_resort(spark):
    # F-thin: nothing reaches min_cohort -> median of all medians at the bin, n summed,
    # finals of the first cohort in tier/key order; a bin without medians -> 0.0 / 0.
    med, fin, ev = _lib(spark)
    r = {x["event_name"]: x for x in resolve_cohorts(ev, med, fin, ["event_name"], PacingConfig(min_cohort=99)).collect()}
    assert (r["E"]["tier"], r["E"]["median_at_d"], r["E"]["n"], r["E"]["baseline_final"]) == ("all", 55.0, 40, 90.0)
    assert (r["F"]["median_at_d"], r["F"]["n"], r["F"]["baseline_final"]) == (0.0, 0, 90.0)


def test_fixture_watchlist_summary_and_order(spark):
    wl = W.watchlist(T.fact(spark, "/root/testdata/sf0.001"), T.FIXTURE_AS_OF, T.FIXTURE_CFG)
    s = wl.summary.first()
    assert s["evaluated"] == wl.scored.count() and 0 <= s["behind"] <= s["evaluated"]
    rows = wl.table.collect()
    assert len(rows) <= 50
    assert all(r["sold_so_far_pct"] < 98.0 for r in rows)
    gaps = [r["gap_pp"] for r in rows if r["gap_pp"] is not None]
    assert gaps == sorted(gaps)
    c = W.status_counts(wl.table).first()
    assert c["n_total"] == c["n_behind"] + c["n_on_pace"] + c["n_ahead"]


def _running(rows):
    """pandas' rules: NULL qty adds nothing and has no sum, a NULL key has neither sum."""
    by, out = {}, []
    for k, lead, t, seq, q in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2], r[3])):
        if k is None or q is None:
            out.append((seq, None))
        else:
            by[k] = by.get(k, 0.0) + q
            out.append((seq, by[k]))
    peak = {}
    for (k, *_, seq, q), (s2, c) in zip(sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2], r[3])), out):
        if c is not None:
            peak[k] = max(peak.get(k, c), c)
    keys = {r[3]: r[0] for r in rows}
    return {s: (c, peak.get(keys[s])) for s, c in out}


@pytest.mark.parametrize("span", [1 << 20, 7])
def test_running_sums_of_a_hot_day_with_nulls(spark, span):
    """One key holds most rows, nearly all in one second; the levels give pandas' sums, however the day is split."""
    import random

    from boxpace.operators import cumulate
    rnd, rows = random.Random(4), []
    for seq in range(900):
        hot = seq % 3 < 2
        lead = 7 if hot else rnd.randint(0, 9)
        t = dt.datetime(2020, 1, 1, 10, 0, 0 if seq % 5 else rnd.randint(0, 59))
        key = "hot" if hot else rnd.choice(["a", "b", None])
        rows.append((key, lead, t, seq, None if seq % 11 == 0 else float(rnd.randint(-3, 6))))
    rows += [("none", 1, dt.datetime(2020, 1, 1), 900 + i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "name string, days_out int, sale_date timestamp_ntz, k long, qty_sold double").repartition(6)
    out = cumulate.running_share(df, "name", CFG.with_(order_span=span)).collect()
    assert {r["k"]: (r["cum_qty"], r["final_qty"]) for r in out} == _running(rows)


def test_levels_equal_a_plain_window(spark):
    """Missing lead days, dates, order numbers and quantities, NaN, dates with and without seconds: the plain window's sums."""
    import random

    from pyspark.sql import Window
    rnd, rows = random.Random(4), []
    for seq in range(3000):
        hot = seq % 3 < 2
        key = "hot" if hot else rnd.choice(["a", "b", None])
        t = None if seq % 50 == 0 else dt.datetime(2020, 1, 1, 10, rnd.choice([0, 0, 1]), rnd.choice([0, 0, 0, 30]), rnd.choice([0, 0, 5]))
        q = None if seq % 11 == 0 else float("nan") if key == "b" and seq > 2000 and seq % 7 == 0 else float(rnd.randint(-3, 6))
        rows.append((key, 7 if hot else rnd.choice([None, *range(10)]), t, None if seq % 80 == 0 else seq - 1500, seq, q))
    df = spark.createDataFrame(rows, "name string, days_out int, sale_date timestamp_ntz, k long, k2 long, qty_sold double").repartition(6)
    w = (Window.partitionBy("name").orderBy(F.col("days_out").desc(), "sale_date", "k", "k2")
         .rowsBetween(Window.unboundedPreceding, 0))
    want = df.withColumn("c", F.when(F.col("qty_sold").isNotNull() & F.col("name").isNotNull(), F.sum("qty_sold").over(w)))
    want = want.withColumn("f", F.max("c").over(Window.partitionBy("name")))
    got = running_share(df, "name", PacingConfig(order_key=("k", "k2"), order_span=97))
    assert got.columns == [*df.columns, "cum_qty", "final_qty", "cum_pct"]
    assert ({r["k2"]: (repr(r["cum_qty"]), repr(r["final_qty"])) for r in got.collect()}
            == {r["k2"]: (repr(r["c"]), repr(r["f"])) for r in want.collect()})


def test_order_keys_of_text_are_summed_too(spark):
    rows = [("A", 3, dt.datetime(2020, 1, 1), x, 1.0) for x in "edcba"]
    df = spark.createDataFrame(rows, "name string, days_out int, sale_date timestamp_ntz, k string, qty_sold double")
    assert sorted((r["k"], r["cum_qty"]) for r in running_share(df, "name", CFG).collect()) == list(zip("abcde", [1.0, 2.0, 3.0, 4.0, 5.0]))


def test_pacing_has_the_running_sums_highest_value_per_bin(spark):
    """The one-pass figures of A18 equal the rows' running shares, also with refunds."""
    from boxpace.operators import curves
    from boxpace.operators.prep import pacing_rows
    f = T.fact_with_refunds(spark, "/root/testdata/sf0.001")
    cfg = T.FIXTURE_CFG.with_(order_span=500)
    rows = running_share(pacing_rows(f, cfg), "event_instance", cfg, positive_final=True)
    want = rows.groupBy("event_instance", "d_bin").agg(F.max("cum_pct").alias("p")).collect()
    got = curves.event_pacing(f, cfg).select("event_instance", "d_bin", F.col("cum_pct").alias("p")).collect()
    key = lambda r: (r["event_instance"], r["d_bin"])
    assert {key(r): r["p"] for r in got} == pytest.approx({key(r): r["p"] for r in want}, nan_ok=True)


def test_refunds_only_have_no_percentage(spark):
    from boxpace.operators.cumulate import running_share
    rows = [("r", 5, dt.datetime(2020, 1, 1), 1, -2.0), ("r", 4, dt.datetime(2020, 1, 2), 2, -1.0)]
    df = spark.createDataFrame(rows, "name string, days_out int, sale_date timestamp_ntz, k long, qty_sold double")
    assert [r["p"] for r in running_share(df, "name", CFG, pct_col="p", positive_final=True).collect()] == [None, None]
    assert sorted(r["p"] for r in running_share(df, "name", CFG, pct_col="p").collect()) == [100.0, 150.0]


def test_an_absent_order_key_is_an_error(spark):
    import pytest

    from boxpace.operators.prep import order_columns
    with pytest.raises(ValueError, match="no_such"):
        order_columns(spark.range(1), PacingConfig(order_key=("no_such",)))


def test_library_counts_no_event_without_a_name(spark):
    rows = [("A", 10, 50.0, 4.0), ("A", 20, 30.0, 4.0), ("B", 10, 40.0, 6.0), (None, 10, 60.0, 8.0)]
    df = spark.createDataFrame(rows, "event_name string, d_bin int, hist_cum_pct double, final_qty double")
    df = df.select("*", *[F.lit("x").alias(k) for k in tier_keys()])
    _, finals = cohort_library(df, PacingConfig())
    got = finals.select("n_events", "median_final").distinct().collect()
    assert [tuple(r) for r in got] == [(2, 5.0)]


def test_strict_as_of_leaves_later_sales_out(spark):
    import datetime as dt

    from boxpace.config import DEFAULT
    from boxpace.plans import watchlist as W
    cols = "event_name string, sale_date string, event_date string, qty_sold double, sale_seq long"
    raw = spark.createDataFrame([("A", "2020-01-01 10:00", "2020-01-20", 3.0, 1), ("A", "2020-01-05 23:59", "2020-01-20", 2.0, 2),
                                 ("A", "2020-01-06 00:00", "2020-01-20", 7.0, 3), ("B", "2019-12-01", "2019-12-20", 4.0, 4)], cols)
    from boxpace.plans.enrich import enrich
    fact, day = enrich(raw), dt.date(2020, 1, 5)
    for cfg, want in ((DEFAULT, 12.0), (DEFAULT.with_(strict_as_of=True), 5.0)):
        assert [r["tickets_so_far"] for r in W.sold_now(fact, day, cfg).collect()] == [want]
        assert [r["ticket_count"] for r in W.watchlist(fact, day, cfg).scored.collect()] == [want]


def test_event_key_parts_the_dates_of_a_name(spark):
    import datetime as dt

    from boxpace.config import DEFAULT
    from boxpace.plans import watchlist as W
    from boxpace.plans.enrich import enrich
    cols = "event_name string, sale_date string, event_date string, qty_sold double, sale_seq long"
    raw = spark.createDataFrame([("A", "2020-01-01", "2020-01-20", 1.0, 1), ("A", "2020-01-10", "2020-01-20", 1.0, 2),
                                 ("A", "2020-02-01", "2020-02-20", 6.0, 3), ("U", "2020-03-01", "2020-03-05", 1.0, 4)], cols)
    fact, day = enrich(raw), dt.date(2020, 3, 1)
    name = {(r["days_out"], r["qty_sold"]): r["final_qty"] for r in W.library_rows(fact, day).collect()}
    date = {(r["days_out"], r["qty_sold"]): r["final_qty"] for r in W.library_rows(fact, day, DEFAULT.with_(event_key="event_instance")).collect()}
    assert set(name.values()) == {8.0}
    assert date == {(19, 1.0): 2.0, (10, 1.0): 2.0, (19, 6.0): 6.0}
    got = W.watchlist(fact, day, DEFAULT.with_(event_key="event_instance", min_cohort=1)).scored.collect()
    assert [(r["event_name"], r["ticket_count"]) for r in got] == [("U", 1)]


def _sales(spark, n):
    """n past sales of 40 names and three venues with some missing names, types, quantities and as many refunds."""
    i = F.col("id")
    day = F.to_timestamp_ntz(F.lit("2020-06-20"))
    return spark.range(0, n, 1, 4).select(
        F.when(i % 97 != 0, F.concat(F.lit("e"), (i % 40).cast("string"))).alias("event_name"), day.alias("event_date"),
        (day - F.make_dt_interval((i * 7919 % 110).cast("int"))).alias("sale_date"),
        F.when(i % 89 != 0, F.lit("T")).alias("event_type"), F.concat(F.lit("v"), (i * 31 % 3).cast("string")).alias("venue"),
        F.lit("Saturday").alias("weekday"), F.when(i % 83 != 0, (i % 5 - F.when(i % 7 == 0, 4).otherwise(0)).cast("double")).alias("qty_sold"),
        i.alias("k"))


def test_running_sums_of_one_shuffle_equal_those_of_two(spark):
    """Rows without key or quantity too, and the sale rows are shuffled once."""
    from test_quantiles import _shuffled

    from boxpace.operators.prep import pacing_rows
    n = 20_000
    rows = pacing_rows(_sales(spark, n), CFG).drop("d_bin")
    got = running_share(rows, "event_name", CFG, one_shuffle=True)
    got.write.format("noop").mode("overwrite").save()
    want = running_share(rows, "event_name", CFG)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r["final_qty"] is None for r in got.where("event_name is null").collect()} == {True}
    assert sum(_shuffled(got._jdf.queryExecution().executedPlan()).values()) < 1.7 * n


def test_library_equals_percentiles_of_the_expanded_rows(spark):
    from boxpace.operators import cohorts
    rows = W.library_rows(_sales(spark, 3_000), dt.date(2021, 1, 1), CFG)
    keys = ["tier_rank", "tier", *tier_keys(CFG)]
    far = cohorts.explode_tiers(rows.select(*tier_keys(CFG), "event_name", "d_bin", "hist_cum_pct", "final_qty"), CFG)
    medians, finals = cohort_library(rows, CFG)
    at = far.groupBy(*keys, "d_bin").agg(F.percentile("hist_cum_pct", F.lit(0.5)).alias("median_pct"), F.count_distinct("event_name").alias("n"))
    of = far.groupBy(*keys).agg(F.percentile("final_qty", F.lit(0.5)).alias("median_final"), F.count_distinct("event_name").alias("n_events"))
    for got, want in ((medians, at), (finals, of)):
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_the_library_shuffles_a_sale_once_for_its_running_sums(spark):
    """Twice before, once for the sums of stretches and once for the rows."""
    from test_quantiles import _shuffled
    n = 20_000
    rows = W.library_rows(_sales(spark, n), dt.date(2021, 1, 1), CFG)
    assert len(rows.collect()) == n
    assert n <= sum(_shuffled(rows._jdf.queryExecution().executedPlan()).values()) < 1.7 * n


def _left_joined(plan):
    """Rows that come out of an executed plan's left joins, each join once."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _left_joined(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _left_joined(plan.plan())
    if name == "ReusedExchangeExec":
        return 0
    rows = sum(_left_joined(plan.children().apply(i)) for i in range(plan.children().size()))
    if name.endswith("JoinExec") and plan.joinType().toString() == "LeftOuter":
        rows += plan.metrics().get("numOutputRows").get().value()
    return rows


def test_counts_and_values_near_a_rank_read_one_shuffle(spark):
    """The sales were sorted, summed and joined with their stretches' starts once for the counts and once more for the values."""
    from boxpace.operators.cohorts import cohort_figures
    n = 5_000
    figures = cohort_figures(W.library_rows(_sales(spark, n), dt.date(2021, 1, 1), CFG), CFG)
    figures.collect()
    assert n <= _left_joined(figures._jdf.queryExecution().executedPlan()) < 1.7 * n


def test_a_text_key_is_shuffled_once(spark):
    """It was shuffled twice, in the stretch key too, and the levels beside it; the columns come out as they went in."""
    from boxpace.operators.prep import pacing_rows
    rows = pacing_rows(_sales(spark, 500), CFG).drop("d_bin")
    got = running_share(rows, "event_name", CFG, one_shuffle=True)
    assert got.columns == [*rows.columns, "cum_qty", "final_qty", "cum_pct"]
    assert sorted(map(repr, got.select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    shuffled = [below for line, below in zip(plan, plan[1:]) if "RepartitionByExpression" in line]
    assert shuffled and not any("_rs_time" in x or "event_name#" in x.replace("concat(=, event_name#", "") for x in shuffled)


def test_line_items_are_shuffled_for_orders_suppliers_and_parts_only(spark):
    """Customers are joined to the orders; the line items were shuffled for them too."""
    from test_quantiles import _shuffled
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(adaptive, "-1")
    try:
        sales = T.sales(spark, "/root/testdata/sf0.001")
        n = len(sales.collect())
        shuffles = list(_shuffled(sales._jdf.queryExecution().executedPlan()).values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.unset(adaptive)
    assert sum(x == n for x in shuffles) == 4  # orders, suppliers, parts and, by one short number, nations
