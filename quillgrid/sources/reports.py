"""Report files: registering, upload checks, and the collection manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import columns as C
from quillgrid.schemas import MANIFEST, REPORT_TYPES, UPLOAD_LIMIT


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of each file; Spark's file listing leaves out files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def check_metadata(company_id: str, report_year: int, report_type: str) -> None:
    """ValueError for what can't be a report's company, year or type."""
    if report_type not in REPORT_TYPES:
        raise ValueError(f"report_type must be one of {', '.join(REPORT_TYPES)}")
    if not isinstance(report_year, int) or isinstance(report_year, bool) or not 1900 <= report_year <= 2200:
        raise ValueError("report_year must be a year")
    if not company_id:
        raise ValueError("company_id is empty")


def register(files: DataFrame, company_id: str, report_year: int, report_type: str, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Report rows of files, with the names of failed checks; no row is dropped.

    ``content`` isn't carried on: only its hash, length and header are read.
    """
    check_metadata(company_id, report_year, report_type)
    digest = C.sha256(F.col("content"))
    checks = F.array_compact(
        F.array(
            F.when(~C.has_pdf_header(F.col("content")), "header"),
            F.when(F.col("length") > limit, "size"),
            F.when(F.col("length") == 0, "empty"),
        )
    )
    return files.select(
        F.sha2(F.concat_ws("|", F.lit(company_id), F.lit(report_year), digest), 256).alias("report_id"),
        F.lit(company_id).alias("company_id"),
        F.lit(report_year).cast("int").alias("report_year"),
        F.lit(report_type).alias("report_type"),
        digest.alias("file_sha256"),
        F.col("length").cast("long").alias("file_bytes"),
        F.col("path").alias("source_url"),
        checks.alias("failed"),
        F.when(F.size(checks) == 0, "pass").otherwise("review").alias("admission"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows; ``_bad`` holds the whole row where a field didn't fit."""
    schema = T.StructType([*MANIFEST.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", encoding="UTF-8")
