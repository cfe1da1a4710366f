"""Booking curves (W4-W8, A19-A22) on hand-computed and fixture data."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from boxpace.config import PacingConfig
from boxpace.operators import curves
from boxpace.sources import tables as T

AS_OF = dt.date(2021, 1, 1)


def _sales(spark, rows):
    """rows: (name, event_date, lead_days, qty)."""
    out = []
    for seq, (name, ev, lead, qty) in enumerate(rows):
        e = dt.datetime.fromisoformat(ev)
        out.append((name, e, e - dt.timedelta(days=lead), float(qty), seq))
    return spark.createDataFrame(out, "event_name string, event_date timestamp_ntz, sale_date timestamp_ntz, "
                                      "qty_sold double, sale_seq long")


F_CURVE = [("E1", "2020-06-10", 0, 1), ("E1", "2020-06-10", 6, 1),
           ("E2", "2020-07-10", 3, 2), ("E2", "2020-07-10", 9, 2),
           ("E3", "2020-08-10", 0, 4)]


def test_baseline_curve_hand_computed(spark):
    curve, cohort = curves.baseline_curve(_sales(spark, F_CURVE), AS_OF, PacingConfig())
    got = {r["d_bin"]: r for r in curve.collect()}
    assert len(got) == 41
    assert got[0]["median_pct"] == pytest.approx(100.0)
    assert got[3]["median_pct"] == pytest.approx(50.0)
    assert got[6]["median_pct"] == pytest.approx(50.0)
    assert got[6]["p25_pct"] == pytest.approx(25.0)
    assert got[9]["median_pct"] == pytest.approx(0.0)
    assert got[120]["p75_pct"] == pytest.approx(0.0)
    assert {r["n"] for r in got.values()} == {3}
    c = cohort.first()
    assert (c["cohort_label"], c["n_events"]) == ("all events (global)", 3)


def test_baseline_curve_empty_history(spark):
    curve, _ = curves.baseline_curve(_sales(spark, F_CURVE), dt.date(2000, 1, 1), PacingConfig())
    assert curve.count() == 0


def test_fixture_curve_invariants(spark):
    """Median non-increasing in d_bin, 100 at bin 0, p25 <= median <= p75."""
    curve, _ = curves.baseline_curve(T.fact(spark, "/root/testdata/sf0.001"), T.FIXTURE_AS_OF, T.FIXTURE_CFG)
    rows = sorted(curve.collect(), key=lambda r: r["d_bin"])
    med = [r["median_pct"] for r in rows]
    assert all(b - a <= 1e-6 for a, b in zip(med, med[1:]))
    assert med[0] == pytest.approx(100.0)
    g = curves.global_pacing_curve(T.fact(spark, "/root/testdata/sf0.001"), T.FIXTURE_AS_OF, T.FIXTURE_CFG)
    assert all(r["p25_pct"] <= r["median_pct"] <= r["p75_pct"] for r in g.collect())


def test_current_curve_gate(spark):
    # F-current: two upcoming events -> nothing; three -> a curve over the bins that occur.
    two = [("U1", "2021-02-01", 3, 1), ("U1", "2021-02-01", 0, 1), ("U2", "2021-02-02", 9, 2)]
    assert curves.current_curve(_sales(spark, two), AS_OF, PacingConfig()).count() == 0
    three = two + [("U3", "2021-02-03", 0, 5)]
    got = {r["d_bin"]: r["cum_pct"] for r in curves.current_curve(_sales(spark, three), AS_OF).collect()}
    assert sorted(got) == [0, 3, 9]
    # bin 9: U1 0%, U2 100%, U3 0%; bin 3: 50, 100, 0; bin 0: 100 each.
    assert got[9] == pytest.approx(100 / 3)
    assert got[3] == pytest.approx(50.0)
    assert got[0] == pytest.approx(100.0)


def test_event_pacing_peak_not_total(spark):
    # F-refund: +5 at lead 10, -5 at lead 5 -> peak 5, cum % 100 then 0.
    rows = [("R", "2020-05-01", 10, 5), ("R", "2020-05-01", 5, -5)]
    df = T.with_event_fields(_sales(spark, rows))
    got = {r["d_bin"]: r["cum_pct"] for r in curves.event_pacing(df).collect()}
    assert got == {9: 100.0, 3: 0.0}
