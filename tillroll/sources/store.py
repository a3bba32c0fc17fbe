"""The sales table kept up to date by months: late and corrected months are written alone, and the marts follow.

Below ``path``: ``lines`` (the analysis table), ``orders`` and ``items`` (sums, see ``plans.grains``), all by month,
``manifest`` (a row for each month of each batch) and ``staging`` (months of a batch on their way). Sums of a month are additive:
a batch makes those of its months anew, and a mart of all months is made from sums alone.

A batch has a name and is applied once: run again it changes nothing, and run again after a failure at any point it ends in
the same table. Its months are first staged, whole, which the manifest notes; only then are they put in place of the old
ones, which can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tillroll.plans.grains import Grains, read_grains, write_grains
from tillroll.sources.files import read_sales
from tillroll.sources.schema import SALES_SCHEMA

MANIFEST = "batch string, step string, YearMonth string, lines long, revenue decimal(38,4)"
STAGED, DONE = "staged", "done"


class SalesStore:
    """A stored sales table with its sums. ``path`` must be a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def lines(self) -> DataFrame:
        return self._read("lines")

    def grains(self) -> Grains:
        """The lines and both sums as stored: what ``report_from`` and ``marts_from`` read."""
        return read_grains(self.spark, self.path, self.lines())

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def add_lines(self, new: DataFrame, batch: str) -> list[str]:
        """Late lines: the months they belong to are written again with them. Returns the months touched."""
        return self._apply(batch, new, keep=True)

    def replace_months(self, new: DataFrame, batch: str) -> list[str]:
        """Corrected months: all lines of the months that occur in ``new`` are replaced by it. Returns the months touched."""
        return self._apply(batch, new, keep=False)

    def _read(self, name: str) -> DataFrame:
        try:
            return read_sales(self.spark, f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SALES_SCHEMA)

    def _apply(self, batch: str, new: DataFrame, keep: bool) -> list[str]:
        steps = self.manifest().where(F.col("batch") == batch)
        known = {step: sorted(r["YearMonth"] for r in steps.where(F.col("step") == step).collect()) for step in (STAGED, DONE)}
        if known[DONE]:
            return known[DONE]
        months = known[STAGED] or self._stage(batch, new, keep)
        if not months:
            return []
        staged = self._staged(batch, months)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("YearMonth").parquet(f"{self.path}/lines")
        write_grains(self.lines().where(F.col("YearMonth").isin(months)), self.path, months_only=True)
        self._note(batch, DONE, staged)
        return months

    def _stage(self, batch: str, new: DataFrame, keep: bool) -> list[str]:
        months = sorted(r["YearMonth"] for r in new.select("YearMonth").distinct().collect())
        whole = new.select(*SALES_SCHEMA.names)
        if keep:
            whole = self.lines().where(F.col("YearMonth").isin(months)).unionByName(whole)
        balanced = whole.hint("rebalance", "YearMonth").sortWithinPartitions("YearMonth", "InvoiceNo")
        balanced.write.mode("overwrite").partitionBy("YearMonth").parquet(self._staging(batch))
        if months:
            self._note(batch, STAGED, self._staged(batch, months))
        return months

    def _staging(self, batch: str) -> str:
        return f"{self.path}/staging/{batch}"

    def _staged(self, batch: str, months: Sequence[str]) -> DataFrame:
        return read_sales(self.spark, self._staging(batch)).where(F.col("YearMonth").isin(list(months)))

    def _note(self, batch: str, step: str, lines: DataFrame) -> None:
        sums = [F.count(F.lit(1)).alias("lines"), F.sum("Revenue").cast("decimal(38,4)").alias("revenue")]
        rows = lines.groupBy("YearMonth").agg(*sums)
        rows = rows.select(F.lit(batch).alias("batch"), F.lit(step).alias("step"), "YearMonth", "lines", "revenue")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
