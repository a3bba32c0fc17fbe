"""Names and order of every report's columns, as listed in FIXTURES.md, also on empty input."""

import re
from pathlib import Path

import pytest

from sample import line, sales
from tillroll.plans.catalogue import REPORTS, TITLES

FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text(encoding="utf-8")
COLUMNS = {
    tag: columns.split(", ") for tag, columns in re.findall(r"^\| (Q\d+\.\d+) \| \d+ \| ([^|]+?) \|", FIXTURES, re.M)
}


def test_catalogue_is_complete():
    assert len(COLUMNS) == 62
    assert set(REPORTS) == set(TITLES) == set(COLUMNS)


@pytest.mark.parametrize("tag", list(COLUMNS))
def test_columns_and_empty_input(spark, tag):
    report = REPORTS[tag](sales(spark, []))
    assert report.columns == COLUMNS[tag]
    report.collect()


@pytest.mark.parametrize("tag", list(COLUMNS))
def test_a_line_with_everything_missing(spark, tag):
    nothing = tuple([None] * 17)
    REPORTS[tag](sales(spark, [nothing, line()])).collect()
