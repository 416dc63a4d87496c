"""Content-hash de-duplication and admission of report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """One row for each hash, that of the smallest ``order_col``.

    An aggregation, not a window: copies combine on the map side, so a hash that many rows share is no hot partition.
    """
    others = [c for c in rows.columns if c != hash_col]
    first = F.min(F.struct(F.col(order_col).alias("_order"), *[F.col(c).alias(c) for c in others])).alias("_first")
    return rows.groupBy(hash_col).agg(first).select(*[F.col(hash_col) if c == hash_col else F.col(f"_first.{c}") for c in rows.columns])


def repeated(rows: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """Hashes that occur more than once: how often, and the first row."""
    return rows.groupBy(hash_col).agg(F.count("*").alias("n_files"), F.min(order_col).alias("first_id")).where("n_files > 1")


def not_stored(batch: DataFrame, stored: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """Rows of a batch whose hash is new, the first of each."""
    return keep_first(batch, hash_col, order_col).join(stored.select(hash_col).distinct(), hash_col, "left_anti")


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def admit(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``failed`` (rule names) and ``decision``: pass or review. No row is dropped."""
    return rows.withColumn("failed", failed_rules(rules)).withColumn("decision", F.when(F.size("failed") == 0, "pass").otherwise("review"))


def tally(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))
