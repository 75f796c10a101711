"""Tables kept by day and run: a day is replaced by naming another run for it, never by overwriting files.

Each write goes to folders of its own, ``<root>/<table>/run=<id>/day=<d>``. ``<root>/log`` is append-only: one commit, one file,
names for every table and day that it changes the run that holds it from now on. Readers see the newest run of each day, so a
commit of several tables is seen whole or not at all. One writer at a time; any number of readers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

LOG = "table string, day date, run string, number bigint"


class DayStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def runs(self, table: str) -> dict[date | None, str]:
        """The run that holds each day of a table: a row per day of the calendar."""
        newest = self.log().filter(F.col("table") == table).groupBy("day").agg(F.max_by("run", "number").alias("run"))
        return {r["day"]: r["run"] for r in newest.collect()}

    def write(self, df: DataFrame, table: str, run: str) -> None:
        """Rows of ``df`` by its column ``day``. Not seen before ``commit`` names the run."""
        df.hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.root}/{table}/run={run}")

    def commit(self, run: str, days: Mapping[str, Sequence[date | None]]) -> None:
        number = 1 + (self.log().agg(F.max("number")).first()[0] or 0)
        rows = [(table, d, run, number) for table, own in days.items() for d in own]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def read(self, table: str, schema: StructType, days: Sequence[date | None] | None = None) -> DataFrame:
        """What the log names, of ``days`` only if given: literals on partition columns, so no other folder is opened.

        ``schema`` is that of the rows, ``day`` included.
        """
        by_run: dict[str, list[date | None]] = {}
        for day, run in self.runs(table).items():
            if days is None or day in days:
                by_run.setdefault(run, []).append(day)
        empty = self.spark.createDataFrame([], schema)
        if not by_run:
            return empty
        paths = [f"{self.root}/{table}/run={run}" for run in sorted(by_run)]
        stored = self.spark.read.schema(StructType([*schema.fields, StructField("run", StringType())])).option("basePath", f"{self.root}/{table}").parquet(*paths)
        named: Column = F.lit(False)
        for run, own in sorted(by_run.items()):
            some = F.col("day").isin(*[d for d in own if d is not None])
            named = named | ((F.col("run") == run) & ((some | F.col("day").isNull()) if None in own else some))
        return stored.filter(named).select(*empty.columns)
