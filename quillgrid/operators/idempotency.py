"""Whether a repeated run changes anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows that only one of the runs has, with multiplicity."""
    a = first.exceptAll(second).agg(F.count("*").alias("only_first"))
    b = second.exceptAll(first).agg(F.count("*").alias("only_second"))
    return a.crossJoin(b)


def latest_runs(rows: DataFrame, runs: DataFrame, key: str, run: str = "run_id", ts: str = "ts") -> DataFrame:
    """Rows of each key's latest run; a run without rows leaves none, and rows of runs that aren't listed don't count."""
    last = runs.groupBy(key).agg(F.max(F.struct(ts, run)).alias("last")).select(key, F.col(f"last.{run}").alias(run))
    return rows.join(last, [key, run], "left_semi")


def by_key(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, state``: same, changed, added or removed, of the natural keys of two runs (each unique)."""
    values = [c for c in first.columns if c not in keys]
    digest = F.sha2(F.to_json(F.struct(*values)), 256)
    a = first.select(*keys, digest.alias("_a"))
    b = second.select(*keys, digest.alias("_b"))
    joined = a.join(b, keys, "full_outer")
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return joined.select(*keys, state.alias("state"))
