"""Column functions: hashes, addresses, fragments, numbers, units and changes. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with optional thousands separators and decimals, and a word or sign after it.
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
PDF_HEADER = b"%PDF-"


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def host(url: Column) -> Column:
    """Lower-cased host, null for a malformed address."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def scheme(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))


def url_path(url: Column) -> Column:
    """Path with a leading slash; a slash where there is none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when((path == "") | path.isNull(), "/").otherwise(path)


def is_https(url: Column) -> Column:
    """True only for a well-formed https address."""
    return F.coalesce(scheme(url) == "https", F.lit(False))


def host_allowed(url: Column, domains: Iterable[str]) -> Column:
    """Whether the host is one of the domains or below one; nothing is allowed by an empty list."""
    own, allowed = host(url), F.lit(False)
    for d in domains:
        d = d.lower().strip(".")
        allowed = allowed | (own == d) | own.endswith("." + d)
    return F.coalesce(allowed, F.lit(False))


def has_pdf_header(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, len(PDF_HEADER)) == F.lit(bytearray(PDF_HEADER)), F.lit(False))


def fragment(text: Column, term: str, before: int = 30, after: int = 30) -> Column:
    """The text around the first hit of ``term``, null where there is none."""
    at = F.instr(text, term)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(term) + after))


def parse_number(raw: Column) -> Column:
    """A decimal out of a number with thousands separators; null where it is none."""
    return F.regexp_replace(raw, ",", "").try_cast("decimal(28,6)")


def change(value: Column, before: Column) -> tuple[Column, Column]:
    """Absolute and relative change."""
    return value - before, F.try_divide(value - before, before)
