"""Shares, period comparison, heatmaps, trend and allocation."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from boxpace.config import PacingConfig
from boxpace.operators import compare as CMP
from boxpace.operators import timing as TM
from boxpace.operators.allocate import allocate
from boxpace.operators.prep import post_slice, pre_slice, with_lead
from boxpace.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_category_shares_bounded_and_sum_to_one(spark):
    base = with_lead(T.fact(spark, SF), T.FIXTURE_CFG)
    for part in (pre_slice(base, T.FIXTURE_CFG), post_slice(base, T.FIXTURE_CFG)):
        shares = [r["share_ratio"] for r in CMP.category_share(part).collect()]
        assert shares and all(0 <= s <= 1 for s in shares)
        assert sum(shares) == pytest.approx(1.0, rel=1e-6, abs=1e-6)


def test_category_share_keeps_null_group(spark):
    # F-null-keys: a NULL event_type is its own group in the share table.
    df = spark.createDataFrame([(None, 1.0), ("A", 3.0)], "event_type string, qty_sold double")
    got = {r["event_type"]: r["share_ratio"] for r in CMP.category_share(df).collect()}
    assert got == {None: 0.25, "A": 0.75}


def test_avg_tickets_by_type_has_both_periods(spark):
    by = CMP.avg_tickets_by_type(T.fact(spark, SF), T.FIXTURE_CFG)
    per_type = by.groupBy("etype").agg(F.count(F.lit(1)).alias("c")).collect()
    assert {r["c"] for r in per_type} == {2}


def _heat_rows(spark, n_rows, n_names):
    e = dt.datetime(2020, 6, 1)
    rows = [(f"N{i % n_names}", e, e - dt.timedelta(days=i % 100), 1.0) for i in range(n_rows)]
    return spark.createDataFrame(rows, "event_name string, event_date timestamp_ntz, sale_date timestamp_ntz, "
                                       "qty_sold double")


def test_timing_heatmap_gate(spark):
    # F-heat: 499 rows or 19 names -> empty; 500 rows and 20 names -> the full 7 x 6 matrix.
    assert TM.timing_heatmap(_heat_rows(spark, 499, 20)).count() == 0
    assert TM.timing_heatmap(_heat_rows(spark, 500, 19)).count() == 0
    m = TM.timing_heatmap(_heat_rows(spark, 500, 20)).collect()
    assert len(m) == 42
    assert sum(r["share"] or 0.0 for r in m) == pytest.approx(1.0)


def test_rolling_mean_ends_null(spark):
    # F-months: centred mean, NULL at both ends, a missing month is not filled.
    rows = [(dt.datetime(2020, m, 5), float(q)) for m, q in [(1, 3), (2, 6), (4, 9), (5, 12)]]
    df = spark.createDataFrame(rows, "sale_date timestamp_ntz, qty_sold double")
    got = [r["roll3"] for r in TM.monthly_trend(df).orderBy("month").collect()]
    assert got == [None, 6.0, 9.0, None]


def test_allocation_adds_up(spark):
    # F-alloc: floor of the share, remainder one by one to the first rows.
    df = spark.createDataFrame([("g", 1, 1, 10), ("g", 2, 1, 10), ("g", 3, 1, 10), ("h", 1, 3, 7), ("h", 2, 1, 7)],
                               "grp string, k int, w bigint, total bigint")
    got = {(r["grp"], r["k"]): r["alloc"] for r in allocate(df, ["grp"], "w", "total", ["k"]).collect()}
    assert got == {("g", 1): 4, ("g", 2): 3, ("g", 3): 3, ("h", 1): 6, ("h", 2): 1}


def test_events_common_intersection(spark):
    cfg = PacingConfig(pre_end=dt.date(2020, 1, 1), post_start=dt.date(2021, 1, 1))
    rows = [("A", dt.datetime(2019, 1, 1), 1.0), ("A", dt.datetime(2021, 2, 1), 2.0),
            ("B", dt.datetime(2019, 1, 1), 9.0), ("C", dt.datetime(2021, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "event_name string, sale_date timestamp_ntz, qty_sold double")
    got = [(r["event_name"], r["qty_pre"], r["qty_post"]) for r in CMP.events_common(df, cfg).collect()]
    assert got == [("A", 1.0, 2.0)]


def test_composite_reports_build(spark):
    from boxpace.plans import reports
    f = T.fact(spark, SF)
    core = reports.derive_core(f, T.FIXTURE_AS_OF, T.FIXTURE_CFG)
    assert len(core) == 9 and core["global_pacing_curve"].count() == 41
    assert set(reports.period_compare(f, T.FIXTURE_CFG)) >= {"top_events", "share_shift"}
    assert reports.booking_curves(f, f, T.FIXTURE_AS_OF, T.FIXTURE_CFG)["sample_size"].first()["n"] > 0
    assert reports.trend(f)["seasons"].count() > 0


def test_allocation_over_slots_equals_one_window(spark):
    """Equal rows, several slots and groups, a total given or summed: floors, then one unit to each of the first rows."""
    import random
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randint(0, 9), rnd.randint(0, 300), rnd.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows + rows[:40], "grp string, w bigint, k bigint, q bigint").repartition(4)
    got = allocate(df, ["grp"], "w", None, ["k", "w", "q"], cfg=PacingConfig(order_span=16), total_of="q").collect()
    want = []
    for g in "ab":
        mine = sorted((r for r in rows + rows[:40] if r[0] == g), key=lambda r: (r[2], r[1], r[3]))
        weight, total = sum(r[1] for r in mine), sum(r[3] for r in mine)
        floors = [r[1] * total // weight for r in mine]
        rest = total - sum(floors)
        want += [(*r, total, f + (i < rest)) for i, (r, f) in enumerate(zip(mine, floors))]
    assert sorted((r["grp"], r["w"], r["k"], r["q"], r["q_sum"], r["alloc"]) for r in got) == sorted(want)


def test_share_shift_keeps_all_when_nothing_passes(spark):
    from boxpace.config import DEFAULT_CATEGORY
    one = spark.createDataFrame([(DEFAULT_CATEGORY, 0.01)], "event_type string, share_ratio double")
    assert CMP_rows(one, one) == [("Post", DEFAULT_CATEGORY), ("Pre", DEFAULT_CATEGORY)]
    two = spark.createDataFrame([(DEFAULT_CATEGORY, 0.01), ("Dance", 0.5), (None, 0.2)], "event_type string, share_ratio double")
    assert CMP_rows(two, one) == [("Pre", None), ("Pre", "Dance")]


def CMP_rows(a, b):
    from boxpace.operators.compare import share_shift
    return sorted(((r["window"], r["event_type"]) for r in share_shift(a, b).collect()), key=lambda r: (r[0], r[1] or ""))
