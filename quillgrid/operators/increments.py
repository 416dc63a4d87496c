"""Summary, years and trends kept up to date by increments: exact states of a batch that merge on read.

Each batch leaves three tables of states. Ids seen, by kind and year, are bitmaps of 32,768 ids a row, which merge by or; the first report
of each company and year and the first result of each series and year merge by least. Both ways of merging take a repeated
batch, rows that several batches share and batches in any order without a change, so reads equal a full recount. For the same reason
``fold`` may write merged states beside the ones they stand for and remove those afterwards: whenever it
stops, reads give the same.

Ids are integers, as bitmaps need them (ids that are dense fill their bitmaps best). A row is told by its id: what is written for an id later, with
another value, doesn't replace it; a null id isn't counted, and a null year is a year of its own but in no series. Empty batches leave no states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators import analytics as A
from quillgrid.sources.tables import exists, remove

_IDS = ("entity", "year", "bucket")
_FIRSTS = ("company_id", "year")
_SERIES = ("company_id", "indicator", "unit", "year")


class Increments:
    """States below a folder ``target``; ``order`` is the type of the reports' order, by which the first of a year is told."""

    def __init__(self, spark: SparkSession, target: str, order: T.DataType | None = None, value: T.DataType | None = None):
        self.spark, self.target = spark, target.rstrip("/")
        long, text = T.LongType(), T.StringType()
        order = order or T.StructType([T.StructField("o_orderdate", T.TimestampNTZType())])
        shape = lambda *fields: T.StructType([T.StructField(n, t) for n, t in fields])
        self.schemas = {
            "ids": shape(("entity", text), ("year", long), ("bucket", long), ("bits", T.BinaryType()), ("batch_id", text)),
            "firsts": shape(("company_id", long), ("year", long), ("first", shape(("order", order), ("report_id", long))), ("batch_id", text)),
            "series": shape(("company_id", long), ("indicator", text), ("unit", text), ("year", long), ("first", shape(("result_id", long), ("value", value or T.DecimalType(18, 2)))), ("batch_id", text)),
        }

    def add(self, batch_id: str, reports: DataFrame, results: DataFrame) -> None:
        """Write a batch's states in place of those that it may have written before.

        ``reports`` has ``report_id, company_id, year, order``; ``results`` has ``result_id, company_id, indicator, unit, year, value``. Further columns aren't read.
        """
        kind = lambda name, c: F.struct(F.lit(name).alias("entity"), F.col(c).cast("long").alias("id"))
        year = F.col("year").cast("long").alias("year")
        seen = reports.select(year, F.inline(F.array(kind("reports", "report_id"), kind("companies", "company_id"))))
        seen = seen.unionByName(results.select(year, F.lit("results").alias("entity"), F.col("result_id").cast("long").alias("id"))).where("id IS NOT NULL")
        # ids are dealt by their bucket before they become bits: each task's own bitmap of every bucket would be many times the ids
        dealt = seen.withColumn("bucket", F.bitmap_bucket_number("id")).repartition(*_IDS)
        ids = dealt.groupBy(*_IDS).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        first = F.min(F.struct("order", F.col("report_id").cast("long").alias("report_id"))).alias("first")
        firsts = reports.where("report_id IS NOT NULL").groupBy(F.col("company_id").cast("long").alias("company_id"), year).agg(first)
        result = F.min(F.struct(F.col("result_id").cast("long").alias("result_id"), "value")).alias("first")
        series = results.where("result_id IS NOT NULL AND year IS NOT NULL").groupBy(F.col("company_id").cast("long").alias("company_id"), "indicator", "unit", year).agg(result)
        for name, rows in (("ids", ids), ("firsts", firsts), ("series", series)):
            self._write(name, rows, batch_id)

    def _write(self, name: str, rows: DataFrame, batch_id: str) -> None:
        shaped = rows.withColumn("batch_id", F.lit(batch_id)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields])
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.target}/{name}")

    def _states(self, name: str) -> DataFrame:
        path = f"{self.target}/{name}"
        return self.spark.read.schema(self.schemas[name]).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], self.schemas[name])

    def _merged(self, name: str, states: DataFrame | None = None) -> DataFrame:
        keys, merge = {"ids": (_IDS, F.bitmap_or_agg("bits").alias("bits")), "firsts": (_FIRSTS, F.min("first").alias("first")), "series": (_SERIES, F.min("first").alias("first"))}[name]
        return (self._states(name) if states is None else states).groupBy(*keys).agg(merge)

    def fold(self) -> None:
        """Merge the states of all batches into one; a batch that is added again afterwards changes nothing."""
        for name in self.schemas:
            old = [r[0] for r in self._states(name).select("batch_id").distinct().collect()]
            if len(old) < 2:
                continue
            self._write(name, self._merged(name, self._states(name).where(F.col("batch_id").isin(old))), f"folded-{uuid.uuid4().hex}")
            for batch in old:
                remove(self.spark, f"{self.target}/{name}/batch_id={batch}")

    def _counted(self, merged: DataFrame, year: Column) -> DataFrame:
        return merged.groupBy("entity", year.alias("year")).agg(F.sum(F.bitmap_count("bits")).alias("n"))

    def by_year(self) -> DataFrame:
        """``entity, year, n``: distinct reports, companies and results of each year."""
        return self._counted(self._merged("ids"), F.col("year"))

    def summary(self) -> DataFrame:
        """``entity, year, n``: distinct reports, companies and results over all years; ``year`` is null."""
        over_years = self._states("ids").groupBy("entity", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return self._counted(over_years, F.lit(None).cast("long"))

    def complete_years(self, wanted: list[int]) -> DataFrame:
        """``company_id, year, report_id``: the first report of each wanted year, of companies that have them all."""
        own = self._merged("firsts", self._states("firsts").where(F.col("year").isin(*wanted)))
        counted = own.withColumn("n_years", F.count("*").over(Window.partitionBy("company_id")))
        return counted.where(F.col("n_years") == len(set(wanted))).select("company_id", "year", F.col("first.report_id").alias("report_id"))

    def trends(self, of_batch: str | None = None) -> DataFrame:
        """Trends of each series' first result a year; with ``of_batch``, only of the series that this batch has rows of."""
        states = self._states("series")
        keys = ["company_id", "indicator", "unit"]
        if of_batch is not None:
            touched = states.where(F.col("batch_id") == of_batch).select(*[F.col(k).alias(f"touched_{k}") for k in keys]).distinct()
            states = states.join(touched, [F.col(k).eqNullSafe(F.col(f"touched_{k}")) for k in keys], "left_semi")
        return A.trend(self._merged("series", states).select(*keys, "year", F.col("first.value").alias("value")), keys)
