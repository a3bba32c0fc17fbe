"""Reports from shared sums must equal those from the lines, distinct counts above all; and read the lines less often."""

import datetime
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as registry
from compare import differences, duck
from sample import line, sales
from tillroll.plans import grains as G
from tillroll.plans.catalogue import REPORTS, export_reports, marts_from, report_from
from tillroll.operators import marts
from tillroll.sources import star
from tillroll.sources.files import read_sales, write_sales


def awkward_lines(n=400, seed=1):
    """Orders over noon, over months and with two customers; missing customers, orders, countries, prices and codes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        invoice = rng.randrange(60)
        rows.append(
            line(
                invoice=rng.choice([str(invoice)] * 9 + [None]),
                code=rng.choice([f"1000{rng.randrange(8)}", f"1000{rng.randrange(3)}A", "POST", None]),
                description=rng.choice(["cup", "Cup", "tray", None]),
                quantity=rng.choice([1, 2, 12, None]),
                price=rng.choice(["1.00", "25.50", "0.35", None]),
                customer=rng.choice([invoice % 7] * 8 + [invoice % 5, None]),
                country=rng.choice(["United Kingdom", ["France", "Spain", "Eire"][invoice % 3], None]),
                ts=f"2011-{1 + invoice % 4 + rng.randrange(2):02}-{1 + rng.randrange(3):02} {rng.choice([9, 11, 12, 16, 19]):02}:00",
            )
        )
    return rows + rows[:20]


@pytest.fixture(scope="module")
def lines(spark):
    return sales(spark, awkward_lines()).repartition(3).cache()


@pytest.fixture(scope="module")
def stored(lines, tmp_path_factory):
    return G.write_grains(lines, str(tmp_path_factory.mktemp("grains")))


def test_every_report_knows_what_it_reads():
    assert set(G.READS) == set(REPORTS) and set(G.MART_READS) == set(marts.MARTS)


@pytest.mark.parametrize("tag", [tag for tag, read in G.READS.items() if read != "lines"])
def test_reports_from_sums_equal_reports_from_lines(lines, stored, tag):
    expected, got = REPORTS[tag](lines), report_from(tag, stored)
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_marts_from_sums_equal_marts_from_lines(lines, stored):
    for name, mart in marts_from(stored).items():
        assert sorted(map(tuple, mart.collect()), key=str) == sorted(map(tuple, marts.MARTS[name](lines).collect()), key=str)


def test_distinct_counts_do_not_add_up_but_are_kept(lines, stored):
    """Customers of the months add up to more than there are; the sums still know how many there are."""
    monthly = sum(r["customers"] for r in REPORTS["Q4.1"](stored.orders).collect())
    total = REPORTS["Q3.1"](stored.items).first()["total_customers"]
    assert monthly > total == lines.where("CustomerID IS NOT NULL").select("CustomerID").distinct().count()


def test_a_report_that_counts_what_the_sums_do_not_keep_is_refused(stored):
    for tag, grain in (("Q6.1", stored.orders), ("Q4.6", stored.items), ("Q6.5", stored.items)):
        with pytest.raises(Exception, match="UNRESOLVED_COLUMN|cannot be resolved"):
            REPORTS[tag](grain).collect()


def test_control_finds_an_outdated_grain(lines, stored):
    assert all(r["agrees"] for r in G.control(stored).collect())
    old = G.Grains(lines.union(lines.limit(1)), stored.orders, stored.items)
    wrong = {r["measure"] for r in G.control(old).collect() if not r["agrees"]}
    assert "Lines" in wrong


@pytest.fixture(scope="module")
def star_dir(tmp_path_factory):
    """Orders, customers and parts that repeat, that are missing, and that have no key; lines without a key or an amount."""
    rng, path = random.Random(3), tmp_path_factory.mktemp("star")
    day = lambda i: datetime.datetime(1995, 1 + i % 12, 1 + i % 28, i % 24)
    tables = {
        "lineitem": {
            "l_orderkey": (pa.int64(), [rng.choice([*range(40), None]) for _ in range(300)]),
            "l_partkey": (pa.int64(), [rng.choice([*range(40, 60), 100_000, None]) for _ in range(300)]),
            "l_suppkey": (pa.int64(), [1] * 300),
            "l_linenumber": (pa.int32(), [1 + i % 7 for i in range(300)]),
            "l_quantity": (pa.float64(), [rng.choice([1.0, 12.0, None]) for _ in range(300)]),
            "l_extendedprice": (pa.float64(), [rng.choice([0.35, 25.5, 1000.01, None]) for _ in range(300)]),
            "l_shipdate": (pa.timestamp("us"), [day(i) for i in range(300)]),
        },
        "orders": {
            "o_orderkey": (pa.int64(), [*range(30), *range(5), None, None]),
            "o_custkey": (pa.int64(), [i % 7 if i % 6 else None for i in range(37)]),
            "o_orderdate": (pa.timestamp("us"), [day(i) if i % 11 else None for i in range(37)]),
        },
        "customer": {
            "c_custkey": (pa.int64(), [0, 1, 2, 2, 3, 4, None]),
            "c_nationkey": (pa.int32(), [0, 1, 0, 1, None, 9, 0]),
        },
        "supplier": {"s_suppkey": (pa.int64(), [1]), "s_nationkey": (pa.int32(), [0])},
        "nation": {"n_nationkey": (pa.int32(), [0, 1]), "n_name": (pa.string(), ["NATION_0", "NATION_1"])},
        "part": {
            "p_partkey": (pa.int64(), [*range(40, 55), 41, 42, None]),
            "p_name": (pa.string(), [*[f"part {i % 4}" for i in range(16)], None, "no key"]),
            "p_brand": (pa.string(), ["Brand#1"] * 18),
        },
    }
    for name, columns in tables.items():
        pq.write_table(pa.table({c: pa.array(v, kind) for c, (kind, v) in columns.items()}), path / f"{name}.parquet")
    return str(path)


def test_lines_that_meet_their_orders_last_are_the_same(spark, star_dir):
    plain, last = (star.sales_lines(spark, star_dir, countries=True, parts=True, orders_last=x) for x in (False, True))
    assert plain.schema == last.schema and plain.count() > 300
    assert sorted(map(str, plain.collect())) == sorted(map(str, last.collect()))


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_control_of_joined_lines_agrees_with_sql(spark, star_dir, threshold):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = registry.queries()["s7_grain_control"](spark, star_dir)
        assert not differences(found, duck(star_dir), registry.oracle_sql()["s7_grain_control"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_control_counts_nothing_as_none(spark, lines):
    found = {r["measure"]: tuple(r)[1:] for r in G.control(G.grains_of(lines.where("false"), together=True)).collect()}
    assert found["Quantity"] == found["Revenue"] == (None, None, None, True)
    assert found["StockCode"] == (0, None, 0, True) and found["Lines"] == (0, 0, 0, True)


def test_control_finds_codes_that_a_grain_lacks(lines, stored):
    for column, lost in (("StockCode", "POST"), ("Description", "tray")):
        short = G.Grains(lines, stored.orders, stored.items.where(f"NOT coalesce({column} = '{lost}', false)"))
        row = {r["measure"]: r for r in G.control(short).collect()}[column]
        assert (row["lines"] - row["items"], row["orders"], row["agrees"]) == (1, None, False)


def test_months_can_be_replaced_alone(spark, lines, tmp_path):
    path = str(tmp_path)
    G.write_grains(lines, path)
    changed = lines.where("YearMonth <> '2011-02'").union(lines.where("YearMonth = '2011-02'").limit(3))
    G.write_grains(changed.where("YearMonth = '2011-02'"), path, months_only=True)
    now = G.read_grains(spark, path, changed)
    assert all(r["agrees"] for r in G.control(now).collect())


def scans(df, path) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan parquet" in x and f"{path}" in x for x in plan.split("\n"))


def test_an_export_reads_the_lines_less_than_45_times(spark, lines, tmp_path):
    path = str(tmp_path / "s")
    write_sales(lines, path)
    table = read_sales(spark, path)
    shared = G.write_grains(table, str(tmp_path / "g"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        reports = {tag: report_from(tag, shared) for tag in REPORTS}
        from_lines = {tag: scans(report, str(tmp_path / "s")) for tag, report in reports.items()}
        from_sums = {tag: scans(report, str(tmp_path / "g")) for tag, report in reports.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {tag for tag, n in from_lines.items() if n} == {tag for tag, read in G.READS.items() if read == "lines"}
    assert sum(from_lines.values()) + 2 <= 20  # two for the sums
    assert sum(from_sums.values()) <= 71


def test_export_with_sums_writes_the_same_files(lines, tmp_path):
    tags = ["Q4.1", "Q6.3", "Q9.5"]
    paths = export_reports(lines, str(tmp_path / "a"), tags)
    shared = export_reports(lines, str(tmp_path / "b"), tags, grain_dir=str(tmp_path / "g"))
    for one, other in zip(paths, shared):
        assert re.sub(r"^.*/", "", one) == re.sub(r"^.*/", "", other)
        read = lines.sparkSession.read.option("header", True).csv
        assert read(one).collect() == read(other).collect()
