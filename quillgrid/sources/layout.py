"""Tables out of the layout of plain text, in DataFrame functions.

Lines whose parts stand two or more blanks apart, or that begin with blanks, are rows; consecutive ones are a block. The parts of all rows of a block
are laid over each other as intervals of character positions: where two or more positions are blank in every row a column ends (gaps and
islands). A block of two rows and two columns or more is a table.

Rows above the first with a number (years aside) are headers; headers and units are carried down to each number, and a row's label,
the first column's text, to the rows below that have none.

A page is read where it is, as one row with an array of its rows, and only numbers leave it one by one: cells are never moved or sorted. So a page
must fit a task's memory some times over, as its text did when it was read.

Defined results: null texts and lines of over ``LONGEST_ROW`` characters are no rows; lines of dashes and the like are no rows but part no block; a table without
numbers has no facts; characters count as one position each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import anchors

LONGEST_ROW = 2000
#: Blank positions, in every row, that part columns.
GAP = 2
_ROW = r"\S {2,}\S|^ {2,}\S"
_PART = r"( *)(\S+(?: \S+)*)"
_RULER = r"^[-=_+|. ]+$"
NUMBER = r"^[0-9][0-9,]*(\.[0-9]+)?$"
YEAR = r"^(19|20)[0-9]{2}$"
# What the column of units is called.
UNIT_HEADERS = ("unit", "units", "单位")


def _parts(text: Column) -> Column:
    """``first, last, cell``: a row's parts and their positions from 0, the last one exclusive."""
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(_PART), F.lit(1)).alias("lead"), F.regexp_extract_all(text, F.lit(_PART), F.lit(2)).alias("cell"))
    kind = "array<struct<first:int,last:int,cell:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["lead"])
        last = first + F.length(x["cell"])
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(F.struct(first.alias("first"), last.alias("last"), x["cell"].alias("cell")))).alias("out"))

    return F.aggregate(cut, begin, step, lambda s: s["out"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(items: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """An array cut into arrays, one from each item (and its index) that begins a run to the next."""
    starts = F.filter(F.transform(items, lambda x, i: F.when(begins(x, i), i + 1)), F.isnotnull)
    return _let(starts, lambda s: F.transform(s, lambda a, k: F.slice(items, a, F.coalesce(F.get(s, k + 1), F.size(items) + 1) - a)))


def _is_row(text: Column) -> Column:
    return (F.length(text) <= LONGEST_ROW) & text.rlike(_ROW)


def _starts(rows: Column) -> Column:
    """Where the columns of a block begin: islands of what the parts of all its rows cover."""
    spans = F.flatten(F.transform(rows, lambda r: F.transform(r["parts"], lambda p: F.struct(p["first"], p["last"]))))
    begin = F.struct(F.lit(-GAP).alias("reach"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        out = F.when(x["first"] - state["reach"] >= GAP, F.concat(state["out"], F.array(x["first"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["reach"], x["last"]).alias("reach"), out.alias("out"))

    return F.aggregate(F.array_sort(F.array_distinct(spans)), begin, step, lambda s: s["out"])


def _cells(row: Column, starts: Column) -> Column:
    """``col, cell`` of a row; parts of a row in one column are one cell."""
    placed = F.transform(row["parts"], lambda p: F.struct(F.size(F.filter(starts, lambda s: s <= p["first"])).alias("col"), p["first"], p["last"]))

    def cell(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))["first"]
        return row["text"].substr(first + 1, F.element_at(parts, -1)["last"] - first)

    def cells(parts: Column) -> Column:
        cols = F.array_distinct(F.transform(parts, lambda p: p["col"]))
        return F.transform(cols, lambda c: F.struct(c.alias("col"), _let(F.filter(parts, lambda p: p["col"] == c), cell).alias("cell")))

    return _let(placed, cells)


def _tables(rows: Column) -> Column:
    """The tables of a page's rows, in order."""

    def block(lines: Column) -> Column:
        own = F.filter(lines, lambda x: ~x["text"].rlike(_RULER))
        parts = F.transform(own, lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), _parts(x["text"]).alias("parts")))
        return _let(parts, lambda r: F.struct(r.alias("rows"), _starts(r).alias("starts")))

    def grid(b: Column) -> Column:
        return F.transform(b["rows"], lambda r, i: F.struct(r["line_no"].alias("line_no"), r["text"].alias("text"), (i + 1).alias("row"), _cells(r, b["starts"]).alias("cells")))

    blocks = _runs(rows, lambda x, i: F.coalesce(x["line_no"] - F.get(rows, i - 1)["line_no"] != 1, F.lit(True)))
    sized = F.filter(F.transform(blocks, block), lambda b: (F.size(b["rows"]) > 1) & (F.size(b["starts"]) > 1))
    return F.transform(sized, grid)


def rows_of_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``report_id, page, rows`` of whole texts, as ``documents.text_lines`` counts pages and lines; nothing is shuffled."""
    pages = texts.select(F.col(id_col).alias("report_id"), F.posexplode(F.split(F.col(text_col), "\f")).alias("page", "body"))
    lines = F.transform(F.split("body", "\n"), lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text")))
    return pages.select("report_id", (F.col("page") + 1).alias("page"), F.filter(lines, lambda x: _is_row(x["text"])).alias("rows"))


def rows_of_lines(lines: DataFrame) -> DataFrame:
    """``report_id, page, rows`` of ``report_id, page, line_no, text``: a page's rows come together."""
    own = lines.where(_is_row(F.col("text"))).groupBy("report_id", "page")
    return own.agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))


def tables(pages: DataFrame) -> DataFrame:
    """``report_id, page, table_no, grid`` of ``report_id, page, rows``; a grid has ``line_no, text, row, cells`` of each row, cells ``col, cell``."""
    found = pages.select("report_id", "page", F.posexplode(_let(F.col("rows"), _tables)).alias("at", "grid"))
    return found.select("report_id", "page", (F.col("at") + 1).alias("table_no"), "grid")


def cells(lines: DataFrame) -> DataFrame:
    """``report_id, page, line_no, text, table_no, row, col, cell`` of ``report_id, page, line_no, text``."""
    rows = tables(rows_of_lines(lines)).select("report_id", "page", "table_no", F.inline("grid"))
    return rows.select("report_id", "page", "line_no", "text", "table_no", "row", F.inline("cells"))


def facts(cells: DataFrame, units: DataFrame) -> DataFrame:
    """``table_facts`` of tables that are given cell by cell."""
    table = ["report_id", "page", "table_no"]
    rows = cells.groupBy(*table, "line_no", "text", "row").agg(F.array_sort(F.collect_list(F.struct("col", "cell"))).alias("cells"))
    whole = F.array_sort(F.collect_list(F.struct("row", "line_no", "text", "cells")))
    return table_facts(rows.groupBy(*table).agg(whole.alias("grid")), units)


def table_facts(tables: DataFrame, units: DataFrame) -> DataFrame:
    """``report_id, page, line_no, text, table_no, row, col, label, header, year, unit, raw_value``: each number of a table with what stands above it and before it."""
    known = units.agg(F.collect_set("raw_unit").alias("known"))  # written by hand, so few
    number = lambda c: (c["col"] > 1) & c["cell"].rlike(NUMBER)
    of = lambda found: F.array_max(F.transform(found, lambda c: c["cell"]))

    def parted(grid: Column) -> Column:
        own = F.filter(grid, lambda r: F.exists(r["cells"], lambda c: number(c) & ~c["cell"].rlike(YEAR)))
        return _let(F.get(own, F.lit(0))["row"], lambda begins: above(F.filter(grid, lambda r: r["row"] < begins), F.filter(grid, lambda r: r["row"] >= begins)))

    def above(head: Column, body: Column) -> Column:
        heads = F.flatten(F.transform(head, lambda r: F.transform(r["cells"], lambda c: F.struct(c["col"].alias("col"), c["cell"].alias("cell"), F.array_contains("known", c["cell"]).alias("unit")))))
        last = F.array_max(F.transform(body, lambda r: F.element_at(r["cells"], -1)["col"]))

        def column(heads: Column, k: Column) -> Column:
            own = lambda unit: F.filter(heads, lambda h: (h["col"] == k) & (h["unit"] == unit))
            return F.struct(F.array_join(F.transform(own(False), lambda h: h["cell"]), " ").alias("header"), of(own(True)).alias("unit"))

        columns = _let(heads, lambda h: F.transform(F.sequence(F.lit(1), last), lambda k: column(h, k)))
        return _let(columns, lambda cols: numbers(cols, body))

    def numbers(cols: Column, body: Column) -> Column:
        top = lambda c: F.get(cols, c["col"] - 1)

        def row(r: Column) -> Column:
            beside = F.filter(r["cells"], lambda c: F.lower(top(c)["header"]).isin(*UNIT_HEADERS))
            first = of(F.filter(r["cells"], lambda c: c["col"] == 1))
            return F.struct(*[r[x].alias(x) for x in ("line_no", "text", "row", "cells")], of(beside).alias("beside"), first.alias("first"))

        def fact(label: Column, r: Column, c: Column) -> Column:
            own = [r["line_no"].alias("line_no"), r["text"].alias("text"), r["row"].alias("row"), c["col"].alias("col"), label.alias("label"), top(c)["header"].alias("header")]
            return F.struct(*own, r["beside"].alias("beside"), top(c)["unit"].alias("above"), c["cell"].alias("raw_value"))

        def labelled(run: Column) -> Column:
            of_row = lambda label, r: F.transform(F.filter(r["cells"], number), lambda c: fact(label, r, c))
            return _let(F.get(run, F.lit(0))["first"], lambda label: F.flatten(F.transform(run, lambda r: of_row(label, r))))

        # a label holds down to the next row that has one
        return _let(F.transform(body, row), lambda rows: F.flatten(F.transform(_runs(rows, lambda r, i: r["first"].isNotNull() | (i == 0)), labelled)))

    found = tables.crossJoin(F.broadcast(known)).select("report_id", "page", "table_no", F.inline(_let(F.col("grid"), parted)))
    inside = lambda x: F.nullif(F.regexp_extract(x, r"[(（]([^()（）]+)[)）]", 1), F.lit(""))
    unit = F.coalesce("beside", inside(F.col("label")), "above", inside(F.col("header")))
    years = F.regexp_extract("header", r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    return found.select("report_id", "page", "line_no", "text", "table_no", "row", "col", "label", "header", years.try_cast("int").alias("year"), unit.alias("unit"), "raw_value")


def table_candidates(facts: DataFrame, catalogue: DataFrame, years: DataFrame | None = None, confidence: str = "0.8500") -> DataFrame:
    """Candidates with source ``table``: a number, with its label before and its unit after it, is read as a line by the catalogue.

    With ``years`` (``report_id, report_year``) numbers of columns of another year are left out.
    """
    own = facts if years is None else facts.join(years, "report_id", "left").where("year is null or report_year is null or year = report_year")
    label = F.regexp_replace("label", r" *[(（][^()（）]*[)）]", "")
    lines = own.select("report_id", "page", F.concat_ws(":", "line_no", "col").alias("line_no"), F.concat_ws(" ", label, "raw_value", "unit").alias("text"), F.col("text").alias("row_text"))
    return anchors.by_anchors(lines, catalogue, "table", confidence, fragment="row_text")
