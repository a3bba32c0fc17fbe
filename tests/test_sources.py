"""CSV landing, preparation, the Parquet table, exports and views."""

import datetime
import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sample import dicts, line, sales
from tillroll.operators import marts
from tillroll.operators.marts import mart_counts, register_views
from tillroll.operators.quality import null_blank_counts, rule_violations
from tillroll.plans.catalogue import REPORTS, TITLES, export_reports
from tillroll.sources.files import (
    as_report, export_results, file_stem, prepare_sales, read_sales, read_sales_csv, rejected_lines, write_sales,
)
from tillroll.sources.schema import RAW_COLUMNS, SALES_SCHEMA

HEADER = ",".join(RAW_COLUMNS) + "\n"
GOOD = "536365,85123A,  WHITE HOLDER ,6,01-12-2010 08:26,2.55,17850,United Kingdom,15.3,2010,4,December,Wednesday\n"


def csv(tmp_path, body):
    path = tmp_path / "lines.csv"
    path.write_text(HEADER + body, encoding="utf-8")
    return str(path)


def test_quotes_commas_and_line_breaks(spark, tmp_path):
    odd = '536366,22633,"LETTER ""O"" BLING, KEY\nRING",1,01-12-2010 08:28,1.85,17850,Spain,1.85,2010,4,December,Wednesday\n'
    rows = read_sales_csv(spark, csv(tmp_path, GOOD + odd), multi_line=True).collect()
    assert [r.Description for r in rows] == ["  WHITE HOLDER ", 'LETTER "O" BLING, KEY\nRING']


def test_large_files_are_split(spark, tmp_path):
    path = csv(tmp_path, GOOD * 4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split, whole = (read_sales_csv(spark, path, multi_line=m) for m in (False, True))
        counts = [df.select(F.spark_partition_id()).distinct().count() for df in (split, whole)]
        assert counts[0] > 4 and counts[1] == 1 and split.count() == whole.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("bad", ["1,2,3,4,5,6,7,8,9,10,11,12\n", "1,2,3,4,5,6,7,8,9,10,11,12,13,14\n"])
def test_wrong_number_of_fields_fails(spark, tmp_path, bad):
    landed = read_sales_csv(spark, csv(tmp_path, GOOD + bad))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        landed.collect()
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        landed.select("InvoiceNo").collect()


def test_prepared_line(spark, tmp_path):
    (row,) = prepare_sales(read_sales_csv(spark, csv(tmp_path, GOOD))).collect()
    assert row.asDict() == {
        "InvoiceNo": "536365", "StockCode": "85123A", "Description": "WHITE HOLDER", "Quantity": 6,
        "UnitPrice": Decimal("2.5500"), "CustomerID": 17850, "Country": "United Kingdom", "Revenue": Decimal("15.3000"),
        "Year": 2010, "Quarter": 4, "MonthName": "December", "WeekdayName": "Wednesday",
        "InvoiceDateTime": datetime.datetime(2010, 12, 1, 8, 26), "InvoiceDay": datetime.date(2010, 12, 1),
        "YearMonth": "2010-12", "MonthNum": 12, "HourOfDay": 8,
    }


def test_schema_of_prepared_table(spark, tmp_path):
    prepared = prepare_sales(read_sales_csv(spark, csv(tmp_path, GOOD)))
    assert [(f.name, f.dataType) for f in prepared.schema] == [(f.name, f.dataType) for f in SALES_SCHEMA]


def test_unreadable_lines_are_set_aside(spark, tmp_path):
    body = GOOD
    for date in ("31-02-2011 08:26", "1-2-2011 8:26", "2011-02-01 08:26", ""):
        body += GOOD.replace("01-12-2010 08:26", date)
    body += GOOD.replace(",6,", ",six,")
    raw = read_sales_csv(spark, csv(tmp_path, body))
    assert prepare_sales(raw).count() == 1
    assert rejected_lines(raw).count() == 5


def test_blank_numbers_are_missing_not_rejected(spark, tmp_path):
    blank = GOOD.replace(",6,", ",,").replace("17850", " ").replace("  WHITE HOLDER ", "   ")
    raw = read_sales_csv(spark, csv(tmp_path, GOOD + blank))
    assert rejected_lines(raw).count() == 0
    counts = {r.column_name: r.null_or_blank for r in null_blank_counts(prepare_sales(raw)).collect()}
    assert counts["Quantity"] == counts["CustomerID"] == counts["Description"] == 1
    assert counts["UnitPrice"] == counts["Country"] == counts["InvoiceNo"] == 0


def test_cancelled_invoices_keep_their_letter(spark, tmp_path):
    body = GOOD.replace("536365", "C581484") + GOOD.replace("536365", "c581484").replace(",6,", ",-6,")
    (row,) = rule_violations(prepare_sales(read_sales_csv(spark, csv(tmp_path, body)))).collect()
    assert row.cancelled_invoices == 2
    assert row.non_positive_quantity == 1
    assert row.revenue_formula_mismatch == 1


def test_no_time_zone_moves_a_timestamp(spark, tmp_path):
    # 01:30 does not exist in London on that day
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        path = csv(tmp_path, GOOD.replace("01-12-2010 08:26", "27-03-2011 01:30"))
        (row,) = prepare_sales(read_sales_csv(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.InvoiceDateTime == datetime.datetime(2011, 3, 27, 1, 30)
    assert row.HourOfDay == 1


def test_parquet_round_trip_and_partition_pruning(spark, tmp_path):
    s = sales(spark, [line(ts="2011-01-03 10:00"), line(invoice="2", ts="2011-02-03 10:00"), line(invoice=None)])
    path = str(tmp_path / "sales")
    write_sales(s, path)
    write_sales(s, path)
    back = read_sales(spark, path)
    assert back.schema.names == SALES_SCHEMA.names
    assert sorted(map(str, back.collect())) == sorted(map(str, s.collect()))
    plan = back.where("YearMonth = '2011-02'")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(YearMonth" in plan


def test_reports_show_dates_as_text(spark):
    (row,) = as_report(REPORTS["Q2.1"](sales(spark, [line()]))).collect()
    assert row.first_transaction == "2011-01-03 10:00:00"
    assert row.days_covered == 1


def test_file_names():
    assert file_stem("Q4.3", "Quarterly performance") == "Q4_3_quarterly_performance"
    assert file_stem("Q2.2", TITLES["Q2.2"]) == "Q2_2_null_blank_count_for_every_column"
    assert file_stem("Q4.9", TITLES["Q4.9"]) == "Q4_9_average_daily_revenue_by_month_adjusts_for_the_dif"


def test_export_replaces_and_writes_one_csv(spark, tmp_path):
    s = sales(spark, [line(country='Say "hi", world')])
    for _ in range(2):
        (path,) = export_reports(s, str(tmp_path), ["Q7.1"])
    (part,) = glob.glob(f"{path}/*.csv")
    text = open(part, encoding="utf-8").read().splitlines()
    assert text[0].startswith("Country,customers,orders")
    assert text[1].startswith('"Say ""hi"", world",1,1')


def test_export_as_parquet(spark, tmp_path):
    (path,) = export_results({"months": REPORTS["Q4.1"](sales(spark, [line()]))}, str(tmp_path), "parquet", one_file=False)
    assert spark.read.parquet(path).count() == 1


def test_views_and_their_counts(spark):
    s = sales(spark, [line(), line(invoice="2", customer=2, code="POST", ts="2011-02-03 10:00")])
    marts = register_views(spark, s)
    assert spark.sql("SELECT count(*) AS n FROM vw_rfm").first().n == 2
    assert dicts(mart_counts(marts)) == [
        {"monthly_rows": 2, "customer_rows": 2, "product_rows": 2, "country_rows": 1, "rfm_rows": 2}
    ]


def test_stored_marts_equal_the_views(spark, tmp_path):
    s = sales(spark, [line(invoice=str(i), customer=i % 3, code=f"1000{i % 4}") for i in range(12)])
    computed = {name: build(s) for name, build in marts.MARTS.items()}
    stored = marts.register_views(spark, s, str(tmp_path / "marts"))
    for name, mart in computed.items():
        assert stored[name].dtypes == mart.dtypes
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, mart.collect()))


def test_malformed_lines_can_be_set_aside(spark, tmp_path):
    names = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country,Revenue,Year,Quarter,Month,Day"
    good = '536365,85123A,"WHITE, ""BIG"" CUP",6,01-12-2010 08:26,2.55,17850,United Kingdom,15.30,2010,4,December,Wednesday'
    short, long, blank = good.rsplit(",", 2)[0], good + ",more,and more", good.replace("01-12-2010", "soon")
    path = tmp_path / "lines.csv"
    path.write_text("\n".join([names, good, short, long, blank, good]) + "\n", encoding="utf-8")
    raw = read_sales_csv(spark, str(path), keep_malformed=True)
    kept = prepare_sales(raw)
    assert kept.columns == prepare_sales(read_sales_csv(spark, str(path))).columns
    assert [r["Description"] for r in kept.collect()] == ['WHITE, "BIG" CUP'] * 2
    aside = rejected_lines(raw)
    assert sorted(r["Malformed"] or "" for r in aside.collect()) == sorted([short, long, ""])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_sales_csv(spark, str(path)).collect()
