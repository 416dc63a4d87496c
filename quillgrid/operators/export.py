"""CSV export of results and JSON artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def results_csv(results: DataFrame, path: str, columns: list[str], order: list[Column], one_file: bool = False) -> None:
    """Write results in a fixed order with a header.

    The range partitions of the sort become files in order; ``one_file`` is for exports small enough for one task.
    """
    ordered = results.select(*columns).orderBy(*order)
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_line(columns: list[str]) -> Column:
    """A row as a line of CSV: fields with a comma, quote or line end are quoted."""

    def field(name: str) -> Column:
        x = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return F.concat_ws(",", *[field(c) for c in columns])


def artefact(rows: DataFrame, path: str) -> None:
    """The outcome of a verification as JSON lines."""
    rows.write.mode("overwrite").json(path)
