"""Refresh by month: late and corrected months, reruns, failures on the way, and marts that follow."""

import random

import pytest
from pyspark.sql import functions as F

from sample import line, sales
from tillroll.operators import marts
from tillroll.plans.catalogue import REPORTS, marts_from, report_from
from tillroll.plans.grains import control
from tillroll.sources.store import SalesStore


def lines_of(seed, months, n=60):
    rng = random.Random(seed)
    return [
        line(
            invoice=f"{seed}-{rng.randrange(20)}",
            code=f"1000{rng.randrange(5)}",
            quantity=rng.randrange(1, 9),
            customer=rng.choice([1, 2, 3, 4, None]),
            country=rng.choice(["United Kingdom", "France"]),
            ts=f"2011-{rng.choice(months):02}-0{rng.randrange(1, 9)} 10:00",
        )
        for _ in range(n)
    ]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path, name):
    return {str(f.relative_to(path)) for f in (path / name).rglob("part-*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    found = SalesStore(spark, str(tmp_path))
    assert found.add_lines(sales(spark, lines_of(1, [1, 2, 3])), "first") == ["2011-01", "2011-02", "2011-03"]
    return found


def test_a_late_month_rewrites_one_partition(spark, store, tmp_path):
    before = {name: files(tmp_path, name) for name in ("lines", "orders", "items")}
    late = sales(spark, lines_of(2, [2], 7))
    expected = rows(store.lines().unionByName(late.select(*store.lines().columns)))
    assert store.add_lines(late, "late") == ["2011-02"]
    assert rows(store.lines()) == expected
    for name, old in before.items():
        untouched = {f for f in old if "2011-02" not in f}
        now = files(tmp_path, name)
        assert untouched == {f for f in now if "2011-02" not in f}  # the same files
        assert not {f for f in old if "2011-02" in f} & now
    assert {r["lines"] for r in store.manifest().where("batch = 'late' AND step = 'done'").collect()} == {
        store.lines().where("YearMonth = '2011-02'").count()
    }


def test_a_rerun_changes_nothing(spark, store, tmp_path):
    late = sales(spark, lines_of(2, [2, 4], 9))
    store.add_lines(late, "late")
    before, kept = rows(store.lines()), files(tmp_path, "lines")
    assert store.add_lines(late, "late") == ["2011-02", "2011-04"]
    assert rows(store.lines()) == before and files(tmp_path, "lines") == kept


@pytest.mark.parametrize("fails", ["_stage", "write_grains", "_note"])
def test_a_run_that_failed_is_finished_by_the_next(spark, store, monkeypatch, fails):
    late = sales(spark, lines_of(3, [1, 3], 8))
    expected = rows(store.lines().unionByName(late.select(*store.lines().columns)))
    with monkeypatch.context() as broken:

        def fail(*args, **kw):
            raise RuntimeError("lost")

        if fails == "write_grains":
            broken.setattr("tillroll.sources.store.write_grains", fail)
        elif fails == "_stage":
            broken.setattr(SalesStore, "_staged", fail)
        else:
            real = SalesStore._note
            broken.setattr(SalesStore, "_note", lambda self, b, step, df: fail() if step == "done" else real(self, b, step, df))
        with pytest.raises(RuntimeError):
            store.add_lines(late, "late")
    store.add_lines(late, "late")
    assert rows(store.lines()) == expected
    assert all(r["agrees"] for r in control(store.grains()).collect())


def test_marts_and_reports_after_a_month_is_replaced_equal_a_full_rebuild(spark, store):
    fixed = sales(spark, lines_of(4, [2], 30))
    store.replace_months(fixed, "correction")
    whole = store.lines().cache()
    assert rows(whole.where("YearMonth = '2011-02'")) == rows(fixed.select(*whole.columns))
    grains = store.grains()
    assert all(r["agrees"] for r in control(grains).collect())
    for name, mart in marts_from(grains).items():
        assert rows(mart) == rows(marts.MARTS[name](whole))
    for tag in ("Q3.1", "Q4.1", "Q5.10", "Q6.3", "Q7.1"):
        assert rows(report_from(tag, grains)) == rows(REPORTS[tag](whole))


def test_an_empty_batch_and_an_empty_store(spark, tmp_path):
    store = SalesStore(spark, str(tmp_path))
    assert store.lines().count() == 0 and store.manifest().count() == 0
    assert store.add_lines(sales(spark, []), "nothing") == []
    assert store.replace_months(sales(spark, lines_of(1, [5])), "some") == ["2011-05"]
    assert store.lines().agg(F.count_distinct("YearMonth")).first()[0] == 1
