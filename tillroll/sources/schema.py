"""The sales line: one row per invoice line, no primary key, duplicates possible."""

from __future__ import annotations

from pyspark.sql import types as T

# The 13 columns of an input file, all landed as text.
RAW_COLUMNS = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
    "Revenue",
    "Year",
    "Quarter",
    "Month",
    "Day",
)
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

MONEY = T.DecimalType(18, 4)

# The 17 columns of the analysis table. Invoice numbers stay text ('C581484' is a cancellation),
# quantities are BIGINT (their squares are summed), money is DECIMAL (sums do not depend on row order).
SALES_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("UnitPrice", MONEY),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
        T.StructField("Revenue", MONEY),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Quarter", T.IntegerType()),
        T.StructField("MonthName", T.StringType()),
        T.StructField("WeekdayName", T.StringType()),
        T.StructField("InvoiceDateTime", T.TimestampNTZType()),
        T.StructField("InvoiceDay", T.DateType()),
        T.StructField("YearMonth", T.StringType()),
        T.StructField("MonthNum", T.IntegerType()),
        T.StructField("HourOfDay", T.IntegerType()),
    ]
)
