"""Unit normalisation: a small table, joined, and exact decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.schemas import UNIT

# Units, what they are counted in, and the factor (1 or more where possible).
UNITS = (
    ("t", "t", "1"),
    ("ton", "t", "1"),
    ("tons", "t", "1"),
    ("kt", "t", "1000"),
    ("kg", "t", "0.001"),
    ("tCO2e", "tCO2e", "1"),
    ("ktCO2e", "tCO2e", "1000"),
    ("kWh", "kWh", "1"),
    ("MWh", "kWh", "1000"),
    ("GWh", "kWh", "1000000"),
    ("GJ", "GJ", "1"),
    ("m3", "m3", "1"),
    ("L", "m3", "0.001"),
    ("CNY", "CNY", "1"),
    ("kCNY", "CNY", "1000"),
    ("mCNY", "CNY", "1000000"),
    ("%", "%", "1"),
    ("h", "h", "1"),
    ("hours", "h", "1"),
    ("person", "person", "1"),
    ("people", "person", "1"),
    ("吨", "t", "1"),
    ("万吨", "t", "10000"),
    ("千克", "t", "0.001"),
    ("公斤", "t", "0.001"),
    ("吨二氧化碳当量", "tCO2e", "1"),
    ("万吨二氧化碳当量", "tCO2e", "10000"),
    ("千瓦时", "kWh", "1"),
    ("万千瓦时", "kWh", "10000"),
    ("兆瓦时", "kWh", "1000"),
    ("吉焦", "GJ", "1"),
    ("立方米", "m3", "1"),
    ("万立方米", "m3", "10000"),
    ("元", "CNY", "1"),
    ("万元", "CNY", "10000"),
    ("亿元", "CNY", "100000000"),
    ("小时", "h", "1"),
    ("人", "person", "1"),
)


def unit_table(spark: SparkSession, units: tuple[tuple[str, str, str], ...] = UNITS) -> DataFrame:
    return spark.createDataFrame([(raw, unit, Decimal(factor)) for raw, unit, factor in units], UNIT)


def normalise(candidates: DataFrame, units: DataFrame, value: str = "value", raw_unit: str = "raw_unit") -> DataFrame:
    """``value`` and ``unit`` in the canonical unit; an unknown unit keeps the value and gets a null ``unit``.

    The unit table is small by nature (its rows are written by hand), so Spark broadcasts it.
    """
    known = units.select(F.col("raw_unit").alias("_raw"), F.col("canonical_unit").alias("_unit"), "factor")
    joined = candidates.drop("unit").join(known, F.col(f"`{raw_unit}`") == F.col("_raw"), "left")
    scaled = (F.col(f"`{value}`").cast("decimal(28,6)") * F.coalesce(F.col("factor"), F.lit(Decimal(1)))).cast("decimal(28,6)")
    return joined.withColumn(value, scaled).withColumn("unit", F.col("_unit")).drop("_raw", "_unit", "factor")
