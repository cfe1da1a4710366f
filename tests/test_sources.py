"""CSV scan, header rules, listing and export."""
import os
import tempfile
import uuid

import pytest

from boxpace.plans.enrich import enrich, load_sales
from boxpace.sources import csv as S
from boxpace.sources import tables as T


def test_header_normalisation_and_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`Sale Date` int, ` qty sold ` int")
    assert S.normalize_headers(df).columns == ["sale_date", "qty_sold"]
    clash = spark.createDataFrame([(1, 2)], "`Sale Date` int, `sale date` int")
    with pytest.raises(ValueError, match="collide"):
        S.normalize_headers(clash)


def test_required_columns_message(spark):
    df = spark.createDataFrame([(1,)], "event_name int")
    with pytest.raises(ValueError, match="Missing required columns: event_date, qty_sold, sale_date"):
        S.require_columns(df)


def test_csv_round_trip_listing_and_enrich(spark):
    raw = T.raw_sales(spark, "/root/testdata/sf0.001")
    out = tempfile.mkdtemp(prefix="boxpace-csv-")
    S.write_csv(raw, os.path.join(out, "sales"))
    files = S.list_data_files(spark, os.path.join(out, "sales"), (".csv",)).collect()
    assert files and all(r["path"].endswith(".csv") for r in files)
    back = load_sales(spark, os.path.join(out, "sales"))
    direct = enrich(raw)
    assert back.count() == direct.count()
    cols = ["event_name", "event_type", "event_category", "event_label", "venue", "weekday"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA", "x"), ("n/a", "null")], "a string, b string")
    got = S.null_tokens(df).collect()
    assert [tuple(r) for r in got] == [(None, "x"), (None, None)]


def test_data_stamp(spark):
    r = S.data_stamp(T.fact(spark, "/root/testdata/sf0.001")).first()
    assert r["n_rows"] > 0 and r["sale_min"] <= r["sale_max"]


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_folder_with_other_column_order_and_multi_line_cells(spark):
    d = tempfile.mkdtemp(prefix="boxpace-csv-")
    _write(d, "1.csv", "Sale Date,Event Date,Event Name,Qty Sold,Amount\n2024-01-01,2024-02-01,A,2,70\n")
    _write(d, "2.CSV", 'Event Name,Amount,Qty Sold,Event Date,Sale Date,Venue\n"B\nand C",35,1,2024-02-02,2024-01-02,"Hall ""X"""\n'
           + "".join(f"D,{i},1,2024-02-03,2024-01-03,Y\n" for i in range(300)))
    _write(d, "notes.txt", "not,data\n")
    out = load_sales(spark, d).orderBy("sale_seq").collect()
    assert [(r["event_name"], r["qty_sold"], r["amount"], r["venue"]) for r in out[:2]] == [
        ("A", 2.0, 70.0, "Unknown"), ("B\nand C", 1.0, 35.0, 'Hall "X"')]
    assert [r["amount"] for r in out[2:]] == [float(i) for i in range(300)]


def test_named_file_of_any_suffix_and_missing_folder(spark):
    from boxpace.plans.enrich import load_or_report
    d = tempfile.mkdtemp(prefix="boxpace-csv-")
    _write(d, "sales.txt", "sale_date,event_date,event_name,qty_sold\n2024-01-01,2024-02-01,A,2\n")
    assert load_sales(spark, os.path.join(d, "sales.txt")).count() == 1
    assert S.list_data_files(spark, os.path.join(d, "none")).count() == 0
    for bad in (os.path.join(d, "none"), d):
        fact, why = load_or_report(spark, bad)
        assert fact is None and why
    _write(d, "x.csv", "a,b\n1,2\n")
    assert "Missing required columns" in load_or_report(spark, d)[1]


def test_export_of_the_clean_fact_is_read_back(spark):
    raw = T.raw_sales(spark, "/root/testdata/sf0.001")
    fact = enrich(raw).withColumn("event_name", __import__("pyspark").sql.functions.concat_ws('"', "event_name", "venue"))
    fact = enrich(fact.drop("event_type", "event_label", "event_instance", "weekday"))
    out = os.path.join(tempfile.mkdtemp(prefix="boxpace-csv-"), "x")
    S.write_csv(fact, out)
    back = load_sales(spark, out)
    cols = ["sale_date", "event_date", "event_name", "qty_sold", "amount", "venue", "event_label", "event_instance"]
    assert sorted(map(repr, back.select(*cols).collect())) == sorted(map(repr, fact.select(*cols).collect()))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        S.write_csv(fact, out)


@pytest.mark.parametrize("text,want", [
    ("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-05T19:30:00", "2024-01-05 19:30:00"), ("1/5/2024", "2024-01-05 00:00:00"),
    ("2024-01-05 19:30:00.250", "2024-01-05 19:30:00.250000"), ("Jan 5, 2024", "2024-01-05 00:00:00"),
    ("01/05/2024 07:30 PM", "2024-01-05 19:30:00"), ("2024-01-05T19:30:00Z", "2024-01-05 19:30:00"),
    ("2024-01-05 19:30:00+02:00", "2024-01-05 19:30:00"), ("5 January 2024", "2024-01-05 00:00:00"), ("25/12/2023", "2023-12-25 00:00:00"),
    ("01/05/2024 12:05 am", "2024-01-05 00:05:00"), ("20240105", "2024-01-05 00:00:00"), ("2024-1-5 9:03", "2024-01-05 09:03:00"),
    ("\u00a02024-01-05\t", "2024-01-05 00:00:00"), ("2024-02-30", None), ("not a date", None), ("2024-01-05 25:00", None),
    ("05.01.2024", "2024-05-01 00:00:00"), ("25.12.2023 18:00", "2023-12-25 18:00:00"), ("Fri Jan 5 2024", "2024-01-05 00:00:00"),
    ("Friday, January 5th, 2024 7:30 pm", "2024-01-05 19:30:00"), ("Fri, 05 Jan 2024 19:30:00 +0200", "2024-01-05 19:30:00"),
    ("5-Jan-24", "2024-01-05 00:00:00"), ("2024-01-05T19:30-05:00", "2024-01-05 19:30:00"), ("Sept 3 1999", "1999-09-03 00:00:00"),
    ("1/2/98", "1998-01-02 00:00:00"), ("2024/13/05", "2024-05-13 00:00:00"), ("2024-01-05 7 PM", "2024-01-05 19:00:00"),
    ("2024-01-05 19:30:00 GMT+01:00", "2024-01-05 19:30:00"), ("13/13/2024", None), ("Foo 5 2024", None), ("Jan 2024 5 6", None), ("5 2024", None),
    ("May 32 2024", None), ("99999999999/1/1", None), ("--", None), ("Monday", None),
    ("", None), (None, None), ("12d", None)])
def test_dates(spark, text, want):
    from boxpace.plans.enrich import to_timestamp
    got = spark.createDataFrame([(text,)], "t string").select(to_timestamp("t").alias("x")).first()["x"]
    assert (str(got) if got else None) == want


def test_numbers_and_trim(spark):
    from pyspark.sql import functions as F

    from boxpace.functions.classify import strip
    from boxpace.plans.enrich import dropped_rows, to_number, venue_default
    texts = ["12", " 12.5 ", "-3", "1e3", ".5", "12d", "0x1F", "NaN", "1_000", "", None]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_number("t").alias("x")).collect()]
    assert got == [12.0, 12.5, -3.0, 1000.0, 0.5, None, None, None, None, None, None]
    one = spark.createDataFrame([("Show\u00a0", "\u00a0")], "n string, v string")
    assert tuple(one.select(strip("n"), venue_default("v")).first()) == ("Show", "Unknown")
    raw = spark.createDataFrame([("2024-01-01", "x", "A", "1"), ("2024-01-01", "2024-01-02", "A", "12d"),
                                 ("2024-01-01", "2024-01-02", "A", "2")], "sale_date string, event_date string, event_name string, qty_sold string")
    assert dropped_rows(raw).first().asDict() == {"n_rows": 3, "bad_sale_date": 0, "bad_event_date": 1, "bad_event_name": 0,
                                                  "bad_qty_sold": 1, "n_kept": 1}


def _jobs(spark, work):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plain_files_are_split_and_keep_their_order(spark):
    d = tempfile.mkdtemp(prefix="boxpace-csv-")
    head = "sale_date,event_date,event_name,qty_sold\n"
    _write(d, "a.csv", head + "".join(f'2024-01-01,2024-02-01,"A ""{i}"", x",{i}\n' for i in range(45_000)))
    _write(d, "b.csv", head + "".join(f"2024-01-01,2024-02-01,B,{i}\r\n" for i in range(9_000)))
    _write(d, "c.csv", head + '2024-01-01,2024-02-01,"C\n",1\n' * 50)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    try:
        df = S.read_csv_text(spark, d)
        assert df.rdd.getNumPartitions() > 9
        got = df.orderBy("sale_seq").select("event_name", "qty_sold", "sale_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["qty_sold"] for r in got] == [str(i) for i in range(45_000)] + [str(i) for i in range(9_000)] + ["1"] * 50
    assert (got[7]["event_name"], got[-1]["event_name"]) == ('A "7", x', "C\n")
    assert len({r["sale_seq"] for r in got}) == len(got)


def test_jobs_do_not_grow_with_the_files(spark):
    counts = []
    for n in (2, 12):
        d = tempfile.mkdtemp(prefix="boxpace-csv-")
        for i in range(n):
            _write(d, f"file {i:02d}.csv", f"sale_date,event_date,event_name,qty_sold,extra{i % 2}\n2024-01-01,2024-02-01,A{i},{i}\n")
        _write(d, "empty.csv", "")
        _write(d, "head only.csv", "\nsale_date,event_date,event_name,qty_sold\n")
        df, jobs = _jobs(spark, lambda d=d: S.read_csv_text(spark, d))
        counts.append(jobs)
        assert [r["event_name"] for r in df.orderBy("sale_seq").collect()] == [f"A{i}" for i in range(n)]
    assert counts[0] == counts[1] <= 3


@pytest.mark.parametrize("cell,plain", [
    ("x", True), ('"x"', True), ('"a,b"', True), ('""', True), ('"a ""b"" c"', True), ('"""a"', True), ('"a\nb"', False), ('"a\r\nb"', False),
    ('5" pipe', False), ('"a ""\n"" b"', False), ('"a\n\n""b"', False), ('"""\n"""', False)])
def test_plain_files_have_no_cell_over_lines(spark, cell, plain):
    d = tempfile.mkdtemp(prefix="boxpace-csv-")
    _write(d, "a.csv", f"k,v,w\n1,{cell},2\n3,y,{cell}\n{cell},z,4\n")
    assert [r["plain"] for r in S.first_lines(spark, [d + "/a.csv"]).collect()] == [plain]
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(d + "/a.csv").collect()
    got = S.read_csv_text(spark, d).orderBy("sale_seq").select("k", "v", "w").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in whole]


def test_headers(spark):
    assert S.header_names('a,"b, ""c""",,A') == ("a0", 'b, "c"', "_c2", "A3")
    d = tempfile.mkdtemp(prefix="boxpace-csv-")
    _write(d, "a.csv", 'k,"two\nlines"\n1,2\n')
    _write(d, "b.csv", 'k,w\n3,4\n')
    got = S.read_csv_text(spark, d)
    assert got.columns == ["k", "two\nlines", "sale_seq", "w"]
    assert [(r["k"], r["w"]) for r in got.orderBy("sale_seq").collect()] == [("1", None), ("3", "4")]
