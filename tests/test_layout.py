"""Tables from layout against a plain reading, position by position, and down to candidates."""

from __future__ import annotations

import random
import re

from quillgrid import schemas as S
from quillgrid.catalogue import catalogue
from quillgrid.functions.units import unit_table
from quillgrid.platform import Platform
from quillgrid.sources import layout


def plain(lines):
    """(line_no, table_no, row, col, cell) of one page's (line_no, text), by marking every position."""
    rows = [(n, t) for n, t in lines if t is not None and len(t) <= layout.LONGEST_ROW and re.search(r"\S {2,}\S|^ {2,}\S", t)]
    blocks = []
    for n, t in rows:
        if blocks and blocks[-1][-1][0] == n - 1:
            blocks[-1].append((n, t))
        else:
            blocks.append([(n, t)])
    out, table = [], 0
    for block in blocks:
        own = [(n, t) for n, t in block if not re.fullmatch(r"[-=_+|. ]+", t)]
        width = max((len(t) for _, t in own), default=0)
        taken = [False] * (width + layout.GAP)
        for _, t in own:
            for m in re.finditer(r"\S+(?: \S+)*", t):
                for p in range(*m.span()):
                    taken[p] = True
        columns, begin = [], None
        for p in range(width + layout.GAP):
            if taken[p]:
                begin = p if begin is None else begin
            elif begin is not None and not any(taken[p : p + layout.GAP]):
                columns.append((begin, p))
                begin = None
        if len(own) < 2 or len(columns) < 2:
            continue
        table += 1
        for row, (n, t) in enumerate(own, 1):
            for col, (a, b) in enumerate(columns, 1):
                if t[a:b].strip(" "):
                    out.append((n, table, row, col, t[a:b].strip(" ")))
    return out


def lines_of(spark, pages):
    rows = [(r, p, n, t) for (r, p), own in pages.items() for n, t in own]
    return spark.createDataFrame(rows, "report_id string, page int, line_no int, text string").repartition(3)


def test_cells_are_those_of_marked_positions(spark):
    rng = random.Random(8)
    words = ["a", "12", "1,200", "total emissions", "é", "用电量", "t", "-", "x y z"]
    pages = {}
    for k in range(40):
        own, n = [], 0
        for _ in range(rng.randrange(0, 5)):
            n += rng.randrange(1, 3)
            widths = [rng.randrange(4, 16) for _ in range(rng.randrange(1, 5))]
            for _ in range(rng.randrange(1, 6)):
                kind = rng.random()
                text = "".join(("" if rng.random() < 0.2 else rng.choice(words)).ljust(w) for w in widths) if kind < 0.85 else rng.choice(["-----  ----", "plain text", "  centred", "x" * 30])
                if text.strip():
                    own.append((n, text))
                n += 1
        pages[f"r{k % 7}", k] = own
    pages["long", 1] = [(1, "a  " * 800), (2, "b  c"), (3, "d  e"), (4, None)]
    found = {}
    for r in layout.cells(lines_of(spark, pages)).collect():
        found.setdefault((r["report_id"], r["page"]), []).append((r["line_no"], r["table_no"], r["row"], r["col"], r["cell"].strip(" ")))
    wanted = {k: plain(own) for k, own in pages.items()}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items() if v} and len(found) > 10
    assert layout.cells(lines_of(spark, {("r", 1): [(1, None)]})).count() == 0


PAGE = """Performance
Indicator                    Unit     2023      2024
---------------------------  ------   -------   -------
Electricity consumption      MWh      1,200     1,350
  of which solar             MWh      10        20
Total employees              person   35        41
用水量                          立方米      900       950

Emissions                    2024
                             t
Hazardous waste              7.5
Paper use (kg)               80"""


def test_facts_carry_headers_units_and_labels(spark):
    lines = lines_of(spark, {("r1", 1): [(n, t) for n, t in enumerate(PAGE.split("\n"), 1) if t.strip()]})
    units = unit_table(spark)
    found = layout.facts(layout.cells(lines), units)
    got = {(r["label"], r["year"]): (r["raw_value"], r["unit"]) for r in found.collect()}
    assert got["Electricity consumption", 2023] == ("1,200", "MWh") and got["of which solar", 2024] == ("20", "MWh") and got["用水量", 2024] == ("950", "立方米")
    assert got["Hazardous waste", 2024] == ("7.5", "t") and got["Paper use (kg)", 2024] == ("80", "kg") and len(got) == 10
    years = spark.createDataFrame([("r1", 2024)], "report_id string, report_year int")
    own = {(r["indicator_id"], r["raw_value"], r["raw_unit"], r["source_type"], r["fragment"]) for r in layout.table_candidates(found, catalogue(spark), years).collect()}
    rows = {t.split("  ")[0]: t for t in PAGE.split("\n")}
    names = {r["indicator_id"]: r["pattern"] for r in catalogue(spark).collect()}
    assert {(re.search(r"\\b([a-z +]+)\\b", names[i])[1].replace(" +", " "), v, u, s, f) for i, v, u, s, f in own} == {
        ("electricity consumption", "1,350", "MWh", "table", rows["Electricity consumption"]),
        ("total employees", "41", "person", "table", rows["Total employees"]),
        ("water consumption", "950", "立方米", "table", rows["用水量"]),
        ("hazardous waste", "7.5", "t", "table", rows["Hazardous waste"]),
        ("paper use", "80", "kg", "table", rows["Paper use (kg)"]),
    }


def test_a_job_takes_what_only_a_table_has(spark, tmp_path):
    p = Platform(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    (tmp_path / "r.pdf").write_text(f"%PDF-1.4\nTraining hours 12 h in total.\n{PAGE}\n", "utf-8")
    p.register(str(tmp_path / "r.pdf"), "c1", 2024, "ESG")
    job = p.create_job(p.reports().first()["report_id"])
    assert p.job(job).first()["state"] == "succeeded"
    found = {(r["source_type"], r["raw_value"]) for r in p.candidates().select("source_type", "raw_value").collect()}
    assert ("rule", "12") in found and ("table", "1,350") in found and ("table", "1,200") not in found
    results = {str(r["value"]): r["unit"] for r in p.results().where("value is not null").collect()}
    assert results["1350000.000000"] == "kWh" and results["0.080000"] == "t"


def test_cells_are_neither_moved_nor_sorted(spark):
    texts = spark.createDataFrame([("r1", f"{PAGE}\f{PAGE}"), ("r2", None), ("r3", "no table")], "doc_id string, text string")
    found = layout.table_facts(layout.tables(layout.rows_of_texts(texts)), unit_table(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and plan.count("Aggregate") == 1  # that of the units
    lines = [(n, t) for n, t in enumerate(PAGE.split("\n"), 1)]
    by_lines = layout.facts(layout.cells(lines_of(spark, {("r1", 1): lines, ("r1", 2): lines})), unit_table(spark))
    assert sorted(found.collect(), key=str) == sorted(by_lines.collect(), key=str) and found.count() == 20
    # labels hold down until the next one, also below rows without any
    rows = [(1, "Item      Amount"), (2, "Paper     1"), (3, "          2"), (4, "Waste     3"), (5, "          4")]
    own = layout.table_facts(layout.tables(layout.rows_of_lines(lines_of(spark, {("r", 1): rows}))), unit_table(spark))
    assert sorted((r["row"], r["label"], r["header"]) for r in own.collect()) == [(2, "Paper", "Amount"), (3, "Paper", "Amount"), (4, "Waste", "Amount"), (5, "Waste", "Amount")]
