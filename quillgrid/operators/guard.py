"""The evidence guard: one acceptance step over candidates of every source, grading, and disclosure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.files import failed_rules

HIGH, MEDIUM = "0.8500", "0.6000"


def guard(candidates: DataFrame, pages: DataFrame, catalogue: DataFrame, reports: DataFrame) -> DataFrame:
    """``candidates`` with ``risk_flags``: fragment not on its page, value not in the fragment, unit or year that doesn't fit.

    ``pages``: ``report_id, page, text``. All joins are outer: a candidate never disappears, it gets a flag.
    """
    own = pages.select("report_id", "page", F.col("text").alias("_page"))
    kinds = catalogue.select("indicator_id", F.col("canonical_unit").alias("_unit"), F.col("kind").alias("_kind"))
    years = reports.select("report_id", F.col("report_year").alias("_year"))
    joined = candidates.join(own, ["report_id", "page"], "left").join(kinds, "indicator_id", "left").join(years, "report_id", "left")
    value_year = F.regexp_extract("fragment", "(19|20)[0-9]{2}", 0)
    rules = {
        "no_fragment": F.col("fragment").isNotNull() & F.contains("_page", "fragment"),
        "no_value": (F.col("_kind") == "qualitative") | F.contains("fragment", "raw_value"),
        "no_unit": (F.col("_kind") == "qualitative") | (F.col("unit") == F.col("_unit")),
        "other_year": (value_year == "") | (value_year == F.col("_year").cast("string")),
    }
    return joined.withColumn("risk_flags", failed_rules(rules)).drop("_page", "_unit", "_kind", "_year")


def review_status(confidence: Column, risk_flags: Column) -> Column:
    """Grade of automatic acceptance; it says nothing of accuracy."""
    n = F.size(risk_flags)
    return F.when((n == 0) & (confidence >= F.lit(HIGH).cast("decimal(5,4)")), "auto_verified_high").when((n == 0) & (confidence >= F.lit(MEDIUM).cast("decimal(5,4)")), "auto_verified_medium").otherwise("candidate_found")


def accept(guarded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, evidence) of guarded candidates, one result for each (report, indicator) slot."""
    graded = guarded.withColumn("review_status", review_status(F.col("confidence"), F.col("risk_flags")))
    key = F.sha2(F.concat_ws("|", "report_id", "indicator_id"), 256).alias("result_id")
    order = F.struct(F.size("risk_flags").alias("n"), (-F.col("confidence")).alias("c"), "candidate_id")
    chosen = graded.groupBy("report_id", "indicator_id").agg(F.min_by(F.struct("value", "raw_value", "unit", "review_status"), order).alias("b"))
    results = chosen.select(key, "report_id", "indicator_id", F.col("b.value").alias("value"), F.col("b.raw_value").alias("text_value"), F.col("b.unit").alias("unit"), F.lit("disclosed").alias("disclosure_status"), F.col("b.review_status").alias("review_status"))
    evidence = graded.select(F.col("candidate_id").alias("evidence_id"), key, "page", "fragment", "source_type", "confidence", "risk_flags", "review_status")
    return results, evidence


def disclosure(results: DataFrame, reports: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``report_id, indicator_id, disclosure_status`` of every slot of the grid report x catalogue."""
    own = results.where("report_id IS NOT NULL AND indicator_id IS NOT NULL").select("report_id", "indicator_id", F.col("disclosure_status").alias("_s")).dropDuplicates(["report_id", "indicator_id"])
    found = own.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("indicator_id", "_s"))).alias("_own"))
    grid = reports.select("report_id").join(found, "report_id", "left").crossJoin(F.broadcast(catalogue.select("indicator_id")))
    return grid.select("report_id", "indicator_id", F.coalesce(F.col("_own")[F.col("indicator_id")], F.lit("not_disclosed")).alias("disclosure_status"))


def open_grid(results: DataFrame, reports: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``report_id, indicator_id`` of the slots of the grid report x catalogue that have no result.

    A report's row meets the set of its own indicators before it is laid out, so the grid itself is neither moved nor sorted.
    """
    own = results.where("report_id IS NOT NULL AND indicator_id IS NOT NULL").groupBy("report_id").agg(F.collect_set("indicator_id").alias("_own"))
    grid = reports.select("report_id").join(own, "report_id", "left").crossJoin(F.broadcast(catalogue.select("indicator_id")))
    return grid.where(~F.coalesce(F.array_contains("_own", F.col("indicator_id")), F.lit(False))).select("report_id", "indicator_id")


def with_undisclosed(results: DataFrame, slots: DataFrame) -> DataFrame:
    """``results`` and, for each slot (``report_id, indicator_id``) that has none, a row without a value."""
    return _with_open(results, slots.join(results.select("report_id", "indicator_id").distinct(), ["report_id", "indicator_id"], "left_anti"))


def grid_with_undisclosed(results: DataFrame, reports: DataFrame, catalogue: DataFrame) -> DataFrame:
    """As ``with_undisclosed``, where the slots are the whole grid report x catalogue."""
    return _with_open(results, open_grid(results, reports, catalogue))


def _with_open(results: DataFrame, open_: DataFrame) -> DataFrame:
    own = {
        "result_id": F.sha2(F.concat_ws("|", "report_id", "indicator_id"), 256),
        "report_id": F.col("report_id"),
        "indicator_id": F.col("indicator_id"),
        "disclosure_status": F.lit("not_disclosed"),
        "review_status": F.lit("no_candidate"),
    }
    return results.unionByName(open_.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in results.schema.fields]))


def reviewed(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """``results`` with the status of their latest review, where one was appended."""
    last = reviews.groupBy("result_id").agg(F.max(F.struct("ts", "reviewer", "review_status")).alias("last")).select("result_id", F.col("last.review_status").alias("of_review"))
    return results.join(last, "result_id", "left").withColumn("review_status", F.coalesce("of_review", "review_status")).select(*results.columns)
