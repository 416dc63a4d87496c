"""Documents to page lines and table cells.

The readers are one interface: a callable on bytes that gives the pages' texts (or cells). Plain text and HTML are
built in; a PDF or OCR reader is passed in as such a callable, as no such library is part of this package.
OCR is kept in a table by the hash of a page's content, and only pages that the table lacks are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A page with fewer characters of text than this counts as scanned.
SCANNED_BELOW = 50


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, page, line_no, text``: lines that aren't blank, counted from 1; form feeds part pages."""
    pages = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\f")).alias("page", "body"))
    lines = pages.select(id_col, (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("line_no", "text"))
    return lines.where(F.trim("text") != "").select(id_col, "page", (F.col("line_no") + 1).alias("line_no"), "text")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, basic entities are resolved, white space is joined."""
    out = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(out, "[ \\t\\r\\n]+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def read_pages(files: DataFrame, reader: Callable[[bytes], Iterable[str]], id_col: str = "report_id", content_col: str = "content") -> DataFrame:
    """``id, page, line_no, text`` of binary documents by a reader that gives each page's text.

    A document that the reader can't read gives one row with a null page and the reason as text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    for page, text in enumerate(reader(content or b""), 1):
                        rows += [(key, page, n, line) for n, line in enumerate(text.split("\n"), 1) if line.strip()]
                except Exception as problem:  # noqa: BLE001  a broken file must not end the job
                    rows.append((key, None, None, f"{type(problem).__name__}: {problem}"))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], ["report_id", "page", "line_no", "text"])

    source = files.select(F.col(id_col).cast("string").alias("report_id"), F.col(content_col))
    return source.mapInArrow(run, "report_id string, page int, line_no int, text string")


def read_cells(files: DataFrame, reader: Callable[[bytes], Iterable[tuple[int, int, int, int, str]]], id_col: str = "report_id", content_col: str = "content") -> DataFrame:
    """``report_id, page, table_no, row, col, cell`` by a reader that gives these for a document.

    A document that the reader can't read gives one row with a null page and the reason as cell.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(key, *cell) for cell in reader(content or b"")]
                except Exception as problem:  # noqa: BLE001  a broken file must not end the job
                    rows.append((key, None, None, None, None, f"{type(problem).__name__}: {problem}"))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["report_id", "page", "table_no", "row", "col", "cell"])

    source = files.select(F.col(id_col).cast("string").alias("report_id"), F.col(content_col))
    return source.mapInArrow(run, "report_id string, page int, table_no int, row int, col int, cell string")


def delimited_cells(content: bytes) -> Iterator[tuple[int, int, int, int, str]]:
    """Tables in plain text: runs of lines with tabs or bars; a form feed parts pages."""
    for page, body in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        table, row = 0, 0
        for line in body.split("\n"):
            mark = "\t" if "\t" in line else "|" if "|" in line else None
            if mark is None:
                row = 0
                continue
            if row == 0:
                table += 1
            row += 1
            for col, cell in enumerate(line.strip().strip("|").split(mark), 1):
                yield page, table, row, col, cell.strip()


def page_images(files: DataFrame, images: Callable[[bytes], Iterable[bytes | None]], id_col: str = "report_id", content_col: str = "content") -> DataFrame:
    """``report_id, page, image`` of binary documents by a function that gives each page's picture, null where a page has none.

    A document that it can't read gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = list(images(content or b""))
                except Exception:  # noqa: BLE001  a broken file must not end the job
                    found = []
                yield pa.record_batch([pa.array([key] * len(found), pa.string()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array(found, pa.binary())], ["report_id", "page", "image"])

    return files.select(F.col(id_col).cast("string").alias("report_id"), F.col(content_col)).mapInArrow(run, "report_id string, page int, image binary")


def scanned(pages: DataFrame, text_col: str = "text", below: int = SCANNED_BELOW) -> DataFrame:
    """``pages`` with ``route``: whether a page's text is enough or its picture must be read."""
    return pages.withColumn("route", F.when(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) < below, "ocr").otherwise("text"))


def ocr(pages: DataFrame, cache: DataFrame, engine: Callable[[bytes], str], image_col: str = "image") -> tuple[DataFrame, DataFrame]:
    """(texts of all pages, new cache rows): only pages whose content hash the cache lacks reach the engine.

    ``pages``: scanned pages, i.e. filtered first, so that the engine never sees others. ``cache``: ``page_sha256, text``.
    """
    hashed = pages.withColumn("page_sha256", F.sha2(F.col(image_col), 256))
    wanted = hashed.select("page_sha256", image_col).dropDuplicates(["page_sha256"]).join(cache, "page_sha256", "left_anti")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([engine(x) for x in b.column(1).to_pylist()], pa.string())], ["page_sha256", "text"])

    new = wanted.select("page_sha256", image_col).mapInArrow(run, "page_sha256 string, text string")
    known = cache.select("page_sha256", "text").unionByName(new)
    return hashed.drop(image_col).join(known, "page_sha256", "left"), new
