"""Driver contract: entry, queries and oracles; every query equals its DuckDB oracle on sf0.001."""
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from boxpace.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 41
    assert df.columns == ["d_bin", "median_pct", "p25_pct", "p75_pct", "n"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = _rows(E.queries()[name](spark, SF).toPandas())
    want = _rows(con.execute(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


ORDERED = {
    "r3_baseline_curve": lambda r: -r["d_bin"], "a20_global_pacing_curve": lambda r: -r["d_bin"],
    "a21_global_curve": lambda r: -r["d_bin"], "a22_current_curve": lambda r: -r["d_bin"],
    "a11_sales_heatmap": lambda r: (["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
                                    .index(r["weekday"]), r["lead_bucket"]),
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_the_source_order(spark, con, name):
    """Curves run from the farthest bin to 0; heatmap rows by weekday, then the bucket's text. The oracles order alike."""
    got = [r.asDict() for r in E.queries()[name](spark, SF).collect()]
    assert len(got) > 5 and got == sorted(got, key=ORDERED[name])
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    keys = [c for c in ("d_bin", "weekday", "lead_bucket") if c in names]
    assert [[r[c] for c in keys] for r in got] == [[r[c] for c in keys] for r in want]


READS = {"r2_watchlist": 2.0, "a15_cohort_medians": 2.0, "w2_running_name": 2.0, "a18_event_pacing": 1.05, "a17_cohort_stats": 1.05,
         "a21_global_curve": 1.05, "r3_baseline_curve": 1.05, "u7_allocation": 1.05,
         "a12_timing_heatmap": 1.05, "a3_avg_tickets_by_type": 1.05, "r5_derive_core": 3.0}


@pytest.fixture(scope="module")
def logged(tmp_path_factory):
    """(rows that tasks read, own jobs before the action) of each query in READS, by one session's event log."""
    import json
    import subprocess
    import sys
    folder = tmp_path_factory.mktemp("events")
    code = f"""
import json, sys, time
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from boxpace.session import get_session
spark = get_session("local[4]", 4, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{folder}",
    "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}})
import __spark_entry__ as E
for name in {sorted(READS)!r}:
    built = time.time()
    df = E.queries()[name](spark, {SF!r})
    ran = time.time()
    df.write.format("noop").mode("overwrite").save()
    print("AT", json.dumps([name, built, ran, time.time()]))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    marks = [json.loads(x[3:]) for x in out.stdout.split("\n") if x.startswith("AT ")]
    assert len(marks) == len(READS), out.stderr[-2000:]
    log = [json.loads(x) for f in folder.iterdir() if not f.name.startswith(".") for x in f.read_text().split("\n") if x]
    result = {}
    for name, built, ran, done in marks:
        read = sum(e["Task Metrics"]["Input Metrics"]["Records Read"] for e in log if e["Event"] == "SparkListenerTaskEnd"
                   and e.get("Task Metrics") and ran <= e["Task Info"]["Launch Time"] / 1000 <= done)
        # Reading a Parquet footer is the only job that may run before the action.
        jobs = [s["Stage Name"] for e in log if e["Event"] == "SparkListenerJobStart"
                and built <= e["Submission Time"] / 1000 < ran - 0.002 for s in e["Stage Infos"]]
        result[name] = read, [j for j in jobs if "parquet" not in j]
    return result


@pytest.mark.parametrize("name", sorted(READS))
def test_the_fact_is_read_once_or_twice(logged, name):
    tables = sum(len(pd.read_parquet(f"{SF}/{t}.parquet")) for t in ("lineitem", "orders", "part", "supplier", "nation", "customer"))
    read, jobs = logged[name]
    assert 0 < read <= READS[name] * tables
    assert jobs == []


@pytest.mark.parametrize("broken", ["leftover", "no_tokenizers"])
def test_entry_without_the_optional_parts(broken, tmp_path):
    """A leftover folder of the subpackage, or a library that it needs and isn't there, costs its queries only."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "boxpace"), tmp_path / "boxpace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    if broken == "leftover":
        (tmp_path / "boxpace/llm/__pycache__").mkdir(parents=True)
    else:
        (tmp_path / "corpus_pipeline.py").write_text("import no_such_tokenizers\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as E; print('N', len(E.queries()), len(E.oracle_sql()))"],
                         cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert f"N {len(QUERIES)} {len(QUERIES)}" in out.stdout, out.stderr[-2000:]
