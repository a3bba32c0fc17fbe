"""Sales lines from CSV, the prepared Parquet table, and result sets to files."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillroll.functions.calendar import year_month
from tillroll.sources.schema import MONEY, RAW_SCHEMA, SALES_SCHEMA

# Fixed value: dates arrive as 'DD-MM-YYYY HH:MM'.
DATE_PATTERN = r"^(\d{2})-(\d{2})-(\d{4}) (\d{2}:\d{2})$"
DATE_AS_ISO = "$3-$2-$1 $4:00"

# numeric columns of the input file and their types
NUMBERS = {
    "Quantity": T.LongType(),
    "UnitPrice": MONEY,
    "CustomerID": T.LongType(),
    "Revenue": MONEY,
    "Year": T.IntegerType(),
    "Quarter": T.IntegerType(),
}


# the whole text of a line with another number of fields, where such lines are kept
MALFORMED = "Malformed"


def read_sales_csv(spark: SparkSession, path: str, multi_line: bool = False, keep_malformed: bool = False) -> DataFrame:
    """The input file as 13 text columns; reading fails on a line with another number of fields.

    By default a line break ends a line, also within quotes, so that Spark can split a large file among tasks; a quoted
    line break then fails as a line with too few fields. ``multi_line`` allows it, and reads each file in one task.
    With ``keep_malformed`` such lines do not end the load: they come with their whole text in a 14th column, are left out by
    ``prepare_sales`` and listed by ``rejected_lines``.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(MALFORMED, T.StringType())]) if keep_malformed else RAW_SCHEMA
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE" if keep_malformed else "FAILFAST")
        .option("columnNameOfCorruptRecord", MALFORMED)
        # all fields are parsed even if a query needs few, so that a bad line is always noticed
        .option("columnPruning", False)
        .csv(path)
    )


def _timestamp() -> Column:
    """The parsed date; NULL where the text does not fit. NTZ: no session time zone moves it."""
    text = F.col("InvoiceDate")
    iso = F.regexp_replace(text, DATE_PATTERN, DATE_AS_ISO)
    # text that does not match comes back as it was
    return F.when(iso != text, iso.try_cast("timestamp_ntz"))


def _number(name: str) -> Column:
    return F.trim(F.col(name)).try_cast(NUMBERS[name])


def _unreadable() -> Column:
    bad = _timestamp().isNull()
    for name in NUMBERS:
        bad = bad | ((F.trim(F.col(name)) != "") & _number(name).isNull())
    return F.coalesce(bad, F.lit(False))


def _malformed(raw: DataFrame) -> Column:
    return F.col(MALFORMED).isNotNull() if MALFORMED in raw.columns else F.lit(False)


def rejected_lines(raw: DataFrame) -> DataFrame:
    """Lines ``prepare_sales`` leaves out: no readable date, a number that is none (a blank one is just missing), or, where they
    were kept, another number of fields."""
    return raw.where(_unreadable() | _malformed(raw))


def prepare_sales(raw: DataFrame) -> DataFrame:
    """The analysis table: typed columns, trimmed description, and the date's parts derived once for all queries.

    Dates and numbers are parsed once, in a row of their own that is then tested: Spark would move a plain filter below
    the parsing, and parse everything in both.
    """
    parsed = {"InvoiceDateTime": _timestamp(), **{name: _number(name) for name in NUMBERS}}
    given = {name: F.trim(F.col(name)) != "" for name in NUMBERS}
    line = F.struct(
        *[F.col(name) for name in raw.columns if name not in NUMBERS],
        *[value.alias(name) for name, value in parsed.items()],
        *[value.alias(f"_has_{name}") for name, value in given.items()],
    )
    readable = F.col("InvoiceDateTime").isNotNull() & ~_malformed(raw)
    for name in NUMBERS:
        readable &= ~F.coalesce(F.col(f"_has_{name}"), F.lit(False)) | F.col(name).isNotNull()
    ts = F.col("InvoiceDateTime")
    day = F.col("InvoiceDay")
    return (
        raw.select(F.inline(F.array(line)))
        .where(readable)
        .withColumns(
            {
                "Description": F.trim("Description"),
                "MonthName": F.col("Month"),
                "WeekdayName": F.col("Day"),
                "InvoiceDay": ts.cast("date"),
            }
        )
        .withColumns({"YearMonth": year_month(day), "MonthNum": F.month(day), "HourOfDay": F.hour(ts)})
        .select(*SALES_SCHEMA.names)
    )


def write_sales(s: DataFrame, path: str) -> None:
    """Write the analysis table as Parquet by month, replacing what is there.

    The rebalance hint gathers each month into files of a good size and lets Spark split a month that holds most of the
    lines; sorting by invoice keeps the lines of an order together, so that per-order sums shrink before their shuffle.
    """
    balanced = s.hint("rebalance", "YearMonth").sortWithinPartitions("YearMonth", "InvoiceNo")
    balanced.write.mode("overwrite").partitionBy("YearMonth").parquet(path)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """The analysis table; filters on ``YearMonth`` read only the months asked for."""
    return spark.read.schema(SALES_SCHEMA).parquet(path).select(*SALES_SCHEMA.names)


def as_report(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, the way result files show them."""
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, dated) else F.col(f.name) for f in df.schema]
    )


def file_stem(tag: str, title: str) -> str:
    """Name of a result: its tag and its title, e.g. 'Q4.3', 'Quarterly performance' -> 'Q4_3_quarterly_performance'."""
    slug = re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_")[:50]
    return f"{tag.replace('.', '_')}_{slug}"


def export_results(results: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv", one_file: bool = True) -> list[str]:
    """Write each result to ``out_dir/<name>``, replacing older output; returns the paths.

    Reports are small and go to one CSV file with a header. For results of unknown size use ``fmt='parquet'`` and
    ``one_file=False``, which keeps the writing distributed.
    """
    paths = []
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        shaped = as_report(df) if fmt == "csv" else df
        writer = (shaped.coalesce(1) if one_file else shaped).write.mode("overwrite")
        writer = writer.option("header", True).option("escape", '"') if fmt == "csv" else writer
        writer.format(fmt).save(path)
        paths.append(path)
    return paths
