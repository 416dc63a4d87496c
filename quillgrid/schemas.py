"""Schemas and closed value sets. Every reader is given one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "binary": T.BinaryType(),
    "decimal(5,4)": T.DecimalType(5, 4),
    "decimal(28,6)": T.DecimalType(28, 6),
    "decimal(28,12)": T.DecimalType(28, 12),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """Name and type pairs; works without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in spec.split(", "))])


REPORT = _struct("report_id string, company_id string, report_year int, report_type string, file_sha256 string, file_bytes bigint, source_url string, admission string")
PAGE_LINE = _struct("report_id string, page int, line_no int, text string")
TABLE_CELL = _struct("report_id string, page int, table_no int, row int, col int, cell string")
INDICATOR = _struct("indicator_id string, pillar string, kind string, canonical_unit string, pattern string")
UNIT = _struct("raw_unit string, canonical_unit string, factor decimal(28,12)")
CANDIDATE = _struct(
    "candidate_id string, report_id string, indicator_id string, raw_value string, raw_unit string, value decimal(28,6), unit string, "
    "source_type string, page int, fragment string, confidence decimal(5,4)"
)
RESULT = _struct("result_id string, report_id string, indicator_id string, value decimal(28,6), text_value string, unit string, disclosure_status string, review_status string")
EVIDENCE = _struct("evidence_id string, result_id string, page int, fragment string, source_type string, confidence decimal(5,4), risk_flags array<string>, review_status string")
JOB_EVENT = _struct("job_id string, event_id bigint, state string, ts timestamp_ntz, reason string")
#: Which report a job extracts; a run of an extraction that is published; the content of an upload; the text of a page's picture; a review of a result.
JOB = _struct("job_id string, report_id string")
RUN = _struct("run_id string, report_id string, ts timestamp_ntz")
UPLOAD = _struct("file_sha256 string, content binary")
OCR_CACHE = _struct("page_sha256 string, text string")
REVIEW = _struct("result_id string, review_status string, reviewer string, ts timestamp_ntz, note string")
MANIFEST = _struct("url string, company_id string, report_year int, report_type string")

# The report types, the upload limit and the job timeout of the public interface.
REPORT_TYPES = ("ESG", "SD", "CSR", "ENV", "OTHER")
UPLOAD_LIMIT = 31_457_280
JOB_TIMEOUT_SECONDS = 7200

#: Extractors, the cheapest first.
SOURCE_TYPES = ("rule", "table", "ocr", "model")
REVIEW_STATUSES = ("auto_verified_high", "auto_verified_medium", "candidate_found", "no_candidate", "rejected")
DISCLOSURE_STATUSES = ("disclosed", "not_disclosed")
JOB_STATES = ("queued", "running", "succeeded", "failed", "timed_out")
FINAL_STATES = ("succeeded", "failed", "timed_out")
PILLARS = ("E", "S", "G")
KINDS = ("quantitative", "qualitative")
