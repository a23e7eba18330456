"""Finance-pack rules on edge fixtures."""

import json

from pyspark.sql import functions as F

from evalpack.operators import facts as fx


def test_unit_fallback_and_positions(spark):
    doc1 = {"facts": {"us-gaap": {"Rev": {"units": {"EUR": [{"val": 1.0, "fy": 2024, "fp": "FY", "form": "10-K",
                                                              "filed": "2024-02-01", "end": "2023-12-31"}]}}}}}
    doc2 = {"facts": {"us-gaap": {"Rev": {"units": {"EUR": [{"val": 9.0}],
                                                     "USD": [{"val": 2.0}, {"val": "bad"}, {"val": 3.0}]}}}}}
    df = spark.createDataFrame([(1, json.dumps(doc1)), (2, json.dumps(doc2))], "e long, doc string")
    got = [(r["e"], r["unit"], r["pos"], r["val"]) for r in
           fx.explode_facts(df, "doc", ["e"], "USD").orderBy("e", "pos").collect()]
    assert got == [(1, "EUR", 0, 1.0), (2, "USD", 0, 2.0), (2, "USD", 1, None), (2, "USD", 2, 3.0)]


def test_latest_fact_ties_go_to_first_record(spark):
    rows = [("E", "C", 1, 10.0, "2024-01-01", "2023-12-31"), ("E", "C", 2, 20.0, "2024-01-01", "2023-12-31"),
            ("E", "C", 3, 30.0, "2023-01-01", "2022-12-31"), ("E", "C", 4, None, "2025-01-01", "2024-12-31"),
            ("E", "C", 5, 50.0, "", "2026-12-31")]
    df = spark.createDataFrame(rows, "entity string, concept string, seq long, val double, filed string, end string") \
        .withColumn("form", F.lit("10-K"))
    r = fx.latest_fact(df, ["entity", "concept"], ["seq"], "10-K").first()
    assert r["val"] == 10.0 and r["seq"] == 1


def test_round_half_up_and_change(spark):
    df = spark.createDataFrame([(-0.125,), (2.345,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(fx.round_half_up(F.col("x"), 2)).collect()] == [-0.12, 2.35, -2.5]
    prices = spark.createDataFrame([("A", 0, 105.0), ("A", 1, 101.0), ("A", 2, 100.0), ("Z", 0, 5.0), ("Z", 1, 0.0)],
                                   "t string, pos long, close double")
    got = {r["t"]: r["change_pct"] for r in fx.window_change_pct(prices, ["t"], "pos", "close").collect()}
    assert got["A"] == 5.0 and got["Z"] is None


def test_number_and_date_parsing(spark):
    df = spark.createDataFrame([("$1,234.50",), ("",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(fx.parse_number(F.col("s"))).collect()]
    assert got[0] == 1234.5 and got[1] == 0.0 and got[2] != got[2] and got[3] == 0.0
    d = spark.createDataFrame([("3/7/2026",), ("12/25/2025",), ("3/2026",)], "s string")
    assert [r[0] for r in d.select(fx.us_date_to_iso(F.col("s"))).collect()] == ["2026-03-07", "2025-12-25", ""]


def test_compact_number(spark):
    df = spark.createDataFrame([("416160000000",), ("999.999",), ("1500",), ("12.5",), (None,), ("-2345678",)],
                               "s string").select(F.col("s").cast("decimal(38,6)").alias("x"))
    got = [r[0] for r in df.select(fx.compact_number(F.col("x"))).collect()]
    assert got == ["416.16B", "1K", "1.5K", "12.5", "n/a", "-2.35M"]


def test_zip_explode_and_filing_rules(spark):
    df = spark.createDataFrame([("0000320193", ["10-K", "S-1", "8-K", "10-Q"], ["0000320193-24-000001", "x", "", "a-b"],
                                 ["d1.htm", "d2", "d3", "d4"])], "cik string, f array<string>, a array<string>, d array<string>")
    z = fx.zip_explode(df, ["cik"], {"form": "f", "acc": "a", "doc": "d"})
    kept = z.filter(fx.keep_filing(F.col("form"), F.col("acc"), F.col("doc")))
    got = kept.select("idx", fx.filing_url(F.col("cik"), F.col("acc"), F.col("doc")).alias("u")).collect()
    assert [(r["idx"], r["u"]) for r in got] == [
        (0, "https://www.sec.gov/Archives/edgar/data/320193/000032019324000001/d1.htm"),
        (3, "https://www.sec.gov/Archives/edgar/data/320193/ab/d4")]


def test_metric_records_first_unit_in_document_order(spark):
    import json
    from evalpack.operators import facts as fx
    rec = lambda v, form="10-K", filed="2020-02-01", **kw: {"val": v, "fy": 2019, "fp": "FY", "form": form, "filed": filed, "end": "2019-12-31", **kw}
    doc = {"facts": {"us-gaap": {
        "Zeta": {"units": {"USD": [rec(1)]}},                                                    # unknown concept
        "Revenues": {"units": {"ZAR": [rec(5)], "AUD": [rec(7)]}},                               # ZAR is named first
        "SalesRevenueNet": {"units": {"AUD": [rec(9)], "USD": [rec(1), rec(2, filed="2020-03-01"), rec("x"), rec(3, filed="")]}},
        "ProfitLoss": {"units": {"USD": {"a": 1}}}, "Assets": {"units": {}}, "Liabilities": {}, "EarningsPerShareDiluted": {
            "units": {"USD": [rec(4)], "USD/shares": [rec(1.5, form="10-Q", frame="CY")]}}}}}
    rows = [(1, json.dumps(doc)), (2, "{}"), (3, None), (4, "not json"), (5, '{"facts": {"us-gaap": {"Assets": {"units": {"USD": []}}}}}')]
    out = fx.metric_records(spark.createDataFrame(rows, "id int, doc string"), "doc", ["id"])
    got = sorted(((r.metric, r.concept, r.unit, r.used_unit, r.pos, r.val) for r in out.collect()), key=str)
    assert got == sorted([("revenue", "Revenues", "USD", "ZAR", 0, 5.0), ("revenue", "SalesRevenueNet", "USD", "USD", 0, 1.0),
                          ("revenue", "SalesRevenueNet", "USD", "USD", 1, 2.0), ("revenue", "SalesRevenueNet", "USD", "USD", 2, None),
                          ("revenue", "SalesRevenueNet", "USD", "USD", 3, 3.0),
                          ("diluted_eps", "EarningsPerShareDiluted", "USD/shares", "USD/shares", 0, 1.5)], key=str)
    usable = {(r.concept, r.val) for r in fx.usable_records(out).collect()}
    assert usable == {("Revenues", 5.0), ("SalesRevenueNet", 1.0), ("SalesRevenueNet", 2.0), ("EarningsPerShareDiluted", 1.5)}
    # the later filing leads, whatever its concept's place; the earlier concept only breaks ties
    snap = fx.company_snapshots(spark.createDataFrame([(1, "a"), (2, "b")], "id2 int, name string"), "id2", ["name"],
                                [fx.metric_children(out, "id", ["pos"])]).orderBy("id2").collect()
    assert {k: (v.toPython()["concept"], v.toPython()["value"]) for k, v in snap[0].annual_metrics.items()} == {"revenue": ("SalesRevenueNet", 2.0)}
    assert snap[0].quarterly_metrics["diluted_eps"].toPython()["frame"] == "CY"
    assert snap[1].annual_metrics == {} and snap[1].latest_filings == [] and snap[1].market is None


def test_snapshot_deals_children_once(spark):
    from evalpack.plans import facts as pf
    plan = pf._snapshots(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial, before the shuffle, and final
    assert "Cartesian" not in plan and "NestedLoop" not in plan
