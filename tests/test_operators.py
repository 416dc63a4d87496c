"""Operators on small literals: the cases that no test table holds."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid import schemas as S
from quillgrid.functions import columns as C
from quillgrid.functions import units as U
from quillgrid.operators import analytics as A
from quillgrid.operators import collect, export, extract, files, guard, idempotency, jobs
from quillgrid.sources import documents as D
from quillgrid.sources import reports as R
from quillgrid.sources.tables import Store

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- Addresses ---------------------------------------------------------------------------------


def test_hosts_and_schemes(spark):
    urls = ["https://A.Example.com/x", "http://example.com", "https://evil-example.com/", "https://example.com.evil.org", "not a url", "https://[bad", None, "https://sub.example.com:8443/p?q#f"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", C.is_https(F.col("u")), C.host_allowed(F.col("u"), ["example.com"]), C.url_path(F.col("u")))
    by = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert by["https://A.Example.com/x"] == (True, True, "/x")
    assert by["http://example.com"][:2] == (False, True)
    assert by["https://evil-example.com/"][:2] == (True, False)
    assert by["https://example.com.evil.org"][:2] == (True, False)
    assert by["not a url"][:2] == (False, False)
    assert by["https://[bad"][:2] == (False, False)
    assert by[None][:2] == (False, False)
    assert by["https://sub.example.com:8443/p?q#f"] == (True, True, "/p")


def test_nothing_is_allowed_by_an_empty_list(spark):
    assert not spark.createDataFrame([("https://a.b",)], "u string").select(C.host_allowed(F.col("u"), [])).first()[0]


def test_robots_longest_prefix_wins(spark):
    urls = spark.createDataFrame([(1, "https://h/a/b"), (2, "https://h/a"), (3, "https://h/"), (4, "https://other/a"), (5, "https://h")], "id int, url string")
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("H", "/a", True)], "host string, prefix string, allow boolean")
    assert values(collect.robots_verdict(urls, rules), "id", "robots_allowed") == [(1, True), (2, True), (3, True), (4, True), (5, True)]
    strict = rules.where("host = 'h'")
    assert values(collect.robots_verdict(urls, strict), "id", "robots_allowed") == [(1, True), (2, False), (3, True), (4, True), (5, True)]


def test_pace(spark):
    urls = spark.createDataFrame([("https://a/1",), ("https://a/2",), ("https://b/1",)], "url string")
    assert values(collect.paced(urls, 2), "url", "not_before_seconds") == [("https://a/1", 0.0), ("https://a/2", 2.0), ("https://b/1", 0.0)]


def test_manifest_plan(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("url,company_id,report_year,report_type\nhttps://x.example.com/a.pdf,c1,2024,ESG\nhttp://x.example.com/a.pdf,c1,2024,ESG\nhttps://evil.org/a,c1,2024,CSR\nhttps://x.example.com/b,c1,later,ESG\nhttps://x.example.com/c,,2024,XXX\n", "utf-8")
    own = collect.plan(R.read_manifest(spark, str(path)).cache(), ["example.com"])
    got = [(r["planned"], r["failed"]) for r in own.orderBy("url", "company_id").collect()]
    assert sorted(got, key=str) == sorted([(True, []), (False, ["https"]), (False, ["domain"]), (False, ["report_year", "row"]), (False, ["company_id", "report_type"])], key=str)


def test_collector_executes_only_what_is_planned(spark):
    plan = collect.plan(spark.createDataFrame([("https://e.com/1", "c", 2024, "ESG"), ("http://e.com/2", "c", 2024, "ESG"), ("https://e.com/3", "c", 2024, "ESG"), ("https://e.com/4", "c", 2024, "ESG")], S.MANIFEST), ["e.com"])
    found = spark.createDataFrame([("https://e.com/1", 9, b"%PDF-1.7x"), ("https://e.com/2", 9, b"%PDF-1.7y"), ("https://e.com/3", 4, b"html"), ("https://e.com/4", 9, b"%PDF-1.7z")], "url string, length bigint, content binary")
    known = found.where("url = 'https://e.com/4'").select(F.sha2("content", 256).alias("file_sha256"))
    assert values(collect.execute(plan, found, known), "url") == [("https://e.com/1",)]


# --- Files -------------------------------------------------------------------------------------


def test_register_checks_each_file(spark, tmp_path):
    for name, body in (("good.pdf", b"%PDF-1.4 text"), ("text.pdf", b"hello"), ("large.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(body)
    own = R.register(R.read_files(spark, str(tmp_path), "*.pdf"), "600000", 2024, "ESG", limit=50)
    got = {r["source_url"].rsplit("/", 1)[1]: (r["admission"], r["failed"]) for r in own.collect()}
    assert got == {"good.pdf": ("pass", []), "text.pdf": ("review", ["header"]), "large.pdf": ("review", ["size"])}


def test_an_empty_upload_needs_review(spark):
    files_ = spark.createDataFrame([("a", None, 0, b"")], "path string, modificationTime timestamp, length bigint, content binary")
    assert values(R.register(files_, "c", 2024, "SD"), "admission", "failed") == [("review", ["header", "empty"])]


def test_upload_limit(spark):
    files_ = spark.createDataFrame([("a", None, S.UPLOAD_LIMIT, b"%PDF-"), ("b", None, S.UPLOAD_LIMIT + 1, b"%PDF-")], "path string, modificationTime timestamp, length bigint, content binary")
    assert values(R.register(files_, "c", 2024, "SD"), "source_url", "admission") == [("a", "pass"), ("b", "review")]


@pytest.mark.parametrize("args", [("c", 2024, "XXX"), ("c", 2024, "esg"), ("c", "2024", "ESG"), ("c", 24, "ESG"), ("", 2024, "ESG"), ("c", True, "ESG")])
def test_register_refuses_bad_parameters(args):
    with pytest.raises(ValueError):
        R.register(None, *args)


def test_dedup_within_a_batch_and_against_the_store(spark):
    batch = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None)], "id int, h string")
    assert values(files.keep_first(batch, "h", "id")) == [(1, "x"), (2, "y"), (4, None)]
    assert values(files.not_stored(batch, spark.createDataFrame([("y",), ("y",)], "h string"), "h", "id"), "id", "h") == [(1, "x"), (4, None)]
    assert values(files.repeated(batch.where("h is not null"), "h", "id")) == [("x", 2, 1)]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abcd")), max_size=20))
def test_dedup_twice_changes_nothing(spark, found):
    df = spark.createDataFrame(found, "id int, h string")
    once = files.keep_first(df, "h", "id")
    assert values(files.keep_first(once, "h", "id")) == values(once)
    assert not files.not_stored(df, once, "h", "id").count()


def test_admission_drops_no_row_and_null_fails(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    own = files.admit(df, {"small": F.col("v") < 10})
    assert values(own, "id", "decision") == [(1, "pass"), (2, "review"), (3, "review")]


# --- Units and numbers -------------------------------------------------------------------------


def test_numbers(spark):
    raw = ["1,234.5", "12", "", "abc", None, "1.2.3", "0.000001"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(C.parse_number(F.col("x"))).collect()]
    assert got == [Dec("1234.500000"), Dec("12.000000"), None, None, None, None, Dec("0.000001")]


def test_unit_table_and_missing_units(spark):
    df = spark.createDataFrame([(1, Dec("2"), "kt"), (2, Dec("1500"), "kg"), (3, Dec("7"), "crates"), (4, None, "t"), (5, Dec("0.000001"), "mCNY"), (6, Dec("3"), None)], "id int, value decimal(28,6), raw_unit string")
    got = values(U.normalise(df, U.unit_table(spark)), "id", "value", "unit")
    assert got == [(1, Dec("2000.000000"), "t"), (2, Dec("1.500000"), "t"), (3, Dec("7.000000"), None), (4, None, "t"), (5, Dec("1.000000"), "CNY"), (6, Dec("3.000000"), None)]


@SLOW
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=10))
def test_units_round_trip(spark, numbers):
    df = spark.createDataFrame([(i, Dec(n), "kt") for i, n in enumerate(numbers)], "id int, value decimal(28,6), raw_unit string")
    back = U.normalise(df, U.unit_table(spark)).select("id", (F.col("value") / 1000).cast("decimal(28,6)"))
    assert values(back) == values(df.select("id", "value"))


# --- Extraction and the guard ------------------------------------------------------------------


def catalogue(spark):
    return spark.createDataFrame([("E01", "E", "quantitative", "t", r"emissions of ([0-9][0-9,.]*) ?(kt|t)\b"), ("S01", "S", "qualitative", None, r"(training) (programme)")], S.INDICATOR)


def test_candidates_guard_and_results(spark):
    lines = spark.createDataFrame([("r1", 1, 1, "emissions of 1,200 kt in 2024"), ("r1", 1, 2, "a training programme runs"), ("r2", 3, 1, "emissions of 5 t in 2019")], S.PAGE_LINE)
    cat = catalogue(spark)
    found = U.normalise(extract.by_catalogue(lines, cat), U.unit_table(spark))
    pages = lines.groupBy("report_id", "page").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    reports = spark.createDataFrame([("r1", 2024), ("r2", 2024)], "report_id string, report_year int")
    own = guard.guard(found, pages, cat, reports)
    assert values(own, "report_id", "indicator_id", "value", "unit", "risk_flags") == [
        ("r1", "E01", Dec("1200000.000000"), "t", []),
        ("r1", "S01", None, None, []),
        ("r2", "E01", Dec("5.000000"), "t", ["other_year"]),
    ]
    results, evidence = guard.accept(own)
    assert values(results, "report_id", "indicator_id", "review_status") == [("r1", "E01", "auto_verified_high"), ("r1", "S01", "auto_verified_high"), ("r2", "E01", "candidate_found")]
    assert evidence.count() == 3 and results.select("result_id").distinct().count() == 3


def test_guard_flags(spark):
    cat, reports = catalogue(spark), spark.createDataFrame([("r", 2024)], "report_id string, report_year int")
    pages = spark.createDataFrame([("r", 1, "emissions of 5 t")], "report_id string, page int, text string")
    row = lambda i, page, fragment, raw, unit: (i, "r", "E01", raw, unit, Dec(5), unit, "rule", page, fragment, Dec("0.9"))
    found = spark.createDataFrame([row("a", 1, "emissions of 5 t", "5", "t"), row("b", 2, "emissions of 5 t", "5", "t"), row("c", 1, "emissions of 5 t", "6", "t"), row("d", 1, "emissions of 5 t", "5", "GJ"), row("e", 1, None, "5", "t")], S.CANDIDATE)
    got = {r["candidate_id"]: r["risk_flags"] for r in guard.guard(found, pages, cat, reports).collect()}
    assert got == {"a": [], "b": ["no_fragment"], "c": ["no_value"], "d": ["no_unit"], "e": ["no_fragment", "no_value", "other_year"]}


def test_grading(spark):
    df = spark.createDataFrame([(Dec("0.9"), []), (Dec("0.85"), []), (Dec("0.7"), []), (Dec("0.59"), []), (Dec("0.99"), ["x"])], "c decimal(5,4), f array<string>")
    assert [r[0] for r in df.select(guard.review_status(F.col("c"), F.col("f"))).collect()] == ["auto_verified_high", "auto_verified_high", "auto_verified_medium", "candidate_found", "candidate_found"]


def test_later_layers_see_only_open_slots(spark):
    slots = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "report_id string, indicator_id string")
    seen = []

    def layer(name, found):
        def run(open_):
            seen.append((name, values(open_, "indicator_id")))
            return open_.where(F.col("indicator_id").isin(found)).withColumn("value", F.lit(1)).withColumn("source_type", F.lit(name))

        return run

    own = extract.layered(slots, [layer("rule", ["a"]), layer("ocr", ["b"]), layer("model", ["c"])])
    assert values(own, "indicator_id", "source_type") == [("a", "rule"), ("b", "ocr"), ("c", "model")]
    assert seen == [("rule", [("a",), ("b",), ("c",)]), ("ocr", [("b",), ("c",)]), ("model", [("c",)])]


def test_best_candidate_ties(spark):
    df = spark.createDataFrame([("s", "ocr", 0.9, 1), ("s", "rule", 0.5, 3), ("s", "rule", 0.5, 2), ("t", "odd", 0.1, 1)], "slot string, src string, conf double, id int")
    assert values(extract.best(df, ["slot"], {"rule": 0, "ocr": 1}, "src", "conf", ["id"]), "slot", "id") == [("s", 2), ("t", 1)]


def test_disclosure_grid(spark):
    results = spark.createDataFrame([("r1", "a", "disclosed"), ("r1", "a", "disclosed")], "report_id string, indicator_id string, disclosure_status string")
    reports = spark.createDataFrame([("r1",), ("r2",)], "report_id string")
    cat = spark.createDataFrame([("a",), ("b",)], "indicator_id string")
    assert values(guard.disclosure(results, reports, cat)) == [("r1", "a", "disclosed"), ("r1", "b", "not_disclosed"), ("r2", "a", "not_disclosed"), ("r2", "b", "not_disclosed")]


# --- Analytics ---------------------------------------------------------------------------------


def test_trend_of_one_year_gap_and_units(spark):
    df = spark.createDataFrame([("a", "t", 2020, 1.0), ("a", "t", 2022, 4.0), ("a", "GJ", 2021, 9.0), ("b", "t", 2020, 1.0), ("b", "t", 2021, 0.0)], "c string, unit string, year int, value double")
    got = values(A.trend(df, ["c", "unit"]), "c", "unit", "year", "change", "step")
    assert got == [("a", "t", 2020, None, None), ("a", "t", 2022, 3.0, 2), ("b", "t", 2020, None, None), ("b", "t", 2021, -1.0, 1)]


def test_relative_change_of_zero_is_null(spark):
    a, r = C.change(F.col("v"), F.col("w"))
    assert tuple(spark.createDataFrame([(1.0, 0.0)], "v double, w double").select(a, r).first()) == (1.0, None)


def test_compare_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0)], "c string, value double").withColumn("year", F.lit(2020))
    assert values(A.compare(df, ["year"]), "c", "rank", "n_compared") == [("a", 1, 3), ("b", 1, 3), ("c", 3, 3)]


def test_three_years_need_all(spark):
    df = spark.createDataFrame([("a", 2020, 2), ("a", 2020, 1), ("a", 2021, 3), ("b", 2020, 4)], "c string, y int, id int")
    assert values(A.complete_years(df, "c", "y", [2020, 2021], [F.col("id")])) == [("a", 2020, 1), ("a", 2021, 3)]


def test_result_without_evidence_stays(spark):
    results = spark.createDataFrame([(1,), (2,)], "result_id int")
    evidence = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "result_id int, n int, t string")
    got = {r["result_id"]: (r["n_evidence"], [e["t"] for e in r["chain"] or []]) for r in A.evidence_chain(results, evidence, "result_id", F.col("n"), ["t"]).collect()}
    assert got == {1: (2, ["x", "y"]), 2: (0, [])}


def test_page_parameters(spark):
    df = spark.range(10)
    assert [r[0] for r in A.page_of(df, [F.col("id")], 3, 2).collect()] == [3, 4]
    for offset, limit in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            A.page_of(df, [F.col("id")], offset, limit)
    with pytest.raises(ValueError):
        A.search(df, "")


def test_search_fragments(spark):
    df = spark.createDataFrame([(1, "äb needle yz"), (2, "none"), (3, None)], "doc_id int, text string")
    assert values(A.search(df, "needle", before=2, after=2)) == [(1, 4, "b needle y")]


# --- Jobs --------------------------------------------------------------------------------------


def event_rows(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", 1, "queued", t(0), None), ("a", 2, "running", t(1), None), ("a", 3, "succeeded", t(5), None), ("b", 1, "queued", t(0), None), ("b", 2, "running", t(2), None), ("c", 1, "queued", t(0), None), ("c", 2, "failed", t(3), "no text"), ("d", 1, "running", t(0), None), ("e", 1, "queued", t(1), None), ("e", 2, "odd", t(1), None)]
    return spark.createDataFrame(rows, S.JOB_EVENT)


def test_current_state_timeout_and_failures(spark):
    e = event_rows(spark)
    assert values(jobs.current(e), "job_id", "state") == [("a", "succeeded"), ("b", "running"), ("c", "failed"), ("d", "running"), ("e", "odd")]
    assert values(jobs.over_time(e, "2024-01-01 02:01:30"), "job_id") == [("d",)]
    assert values(jobs.over_time(e, "2024-01-01 02:00:00"), "job_id") == []
    appended = e.unionByName(jobs.time_out(e, "2024-01-01 03:00:00"))
    assert values(jobs.current(appended), "job_id", "state")[1] == ("b", "timed_out")
    assert values(jobs.failures(e), "job_id", "reason") == [("c", "no text")]
    assert values(jobs.invalid(e), "job_id", "state") == [("d", "running"), ("e", "odd")]
    with pytest.raises(ValueError):
        jobs.event(spark, "a", 1, "done", dt.datetime(2024, 1, 1))


# --- Documents ---------------------------------------------------------------------------------


def test_lines_and_pages(spark):
    df = spark.createDataFrame([(1, "one\n\n two\fthree"), (2, ""), (3, None)], "doc_id int, text string")
    assert values(D.text_lines(df)) == [(1, 1, 1, "one"), (1, 1, 3, " two"), (1, 2, 1, "three")]


def test_reader_failures_are_rows(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("\f")

    files_ = spark.createDataFrame([("a", b"x\ny\fz"), ("b", b"bad")], "report_id string, content binary")
    assert values(D.read_pages(files_, reader)) == [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 1, "z"), ("b", None, None, "ValueError: broken")]


def test_cells(spark):
    files_ = spark.createDataFrame([("a", b"head\nx\ty\n1\t2\ntext\n| p | q |")], "report_id string, content binary")
    got = values(D.read_cells(files_, D.delimited_cells), "table_no", "row", "col", "cell")
    assert got == [(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 2, 1, "1"), (1, 2, 2, "2"), (2, 1, 1, "p"), (2, 1, 2, "q")]


def test_a_broken_table_file_is_a_row(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError("no table")
        return D.delimited_cells(content)

    docs = spark.createDataFrame([("a", b"x\ty"), ("b", b"bad")], "report_id string, content binary")
    assert values(D.read_cells(docs, reader), "report_id", "page", "cell") == [("a", 1, "x"), ("a", 1, "y"), ("b", None, "ValueError: no table")]


def test_ocr_reads_only_what_the_cache_lacks(spark):
    pages = spark.createDataFrame([(1, b"A"), (2, b"B"), (3, b"A")], "page int, image binary")
    cache = spark.createDataFrame([(b"B",)], "i binary").select(F.sha2("i", 256).alias("page_sha256"), F.lit("cached").alias("text"))
    texts, new = D.ocr(pages, cache, lambda image: "read " + image.decode())
    assert values(texts, "page", "text") == [(1, "read A"), (2, "cached"), (3, "read A")]
    assert values(new, "text") == [("read A",)]


def test_html(spark):
    html = "<title>A</title><script>var x='</p>';</script><p>one &amp;lt; <b>two</b><!-- no --></p>"
    got = spark.createDataFrame([(html,)], "h string").select(D.html_title(F.col("h")), D.html_text(F.col("h"))).first()
    assert tuple(got) == ("A", "A one &lt; two")


def test_scanned_pages(spark):
    df = spark.createDataFrame([("x" * 50,), (" x ",), (None,)], "text string")
    assert [r["route"] for r in D.scanned(df).collect()] == ["text", "ocr", "ocr"]


# --- Export, stores, repeated runs -------------------------------------------------------------


def test_csv_export_order_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi", you'), (1, "plain"), (3, None)], "id int, text string")
    export.results_csv(df, str(tmp_path / "out"), ["id", "text"], [F.col("id")], one_file=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().splitlines()[0] == "id,text" and [x.split(",")[0] for x in part.read_text().splitlines()[1:]] == ["1", "2", "3"]
    back = spark.read.schema("id int, text string").csv(str(tmp_path / "out"), header=True, escape='"')
    assert values(back) == values(df)
    assert [r[0] for r in df.orderBy("id").select(export.csv_line(["id", "text"])).collect()] == ["1,plain", '2,"say ""hi"", you"', "3,"]


def test_store(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, year int").schema
    spark.createDataFrame([(1, 2020)], schema).write.parquet(str(tmp_path / "seed/results"))
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    assert values(store.read("results", schema)) == [(1, 2020)] and store.read("none", schema).count() == 0
    batch = spark.createDataFrame([(2, 2021), (3, 2022)], schema)
    for _ in range(2):  # a batch that runs twice changes nothing
        store.replace_partitions(batch, "results", "year")
    assert values(store.read("results", schema), "id") == [(1,), (2,), (3,)]
    store.append(spark.createDataFrame([(4, 2023)], schema), "more", "year")
    assert store.read("more", schema).count() == 1
    spark.createDataFrame([(1, 2020), (5, 2020)], schema).write.parquet(str(tmp_path / "seed/results2"))
    store.initialise("results2", schema)
    assert values(store.read("results2", schema)) == [(1, 2020), (5, 2020)]
    assert store.of_seed("results2", schema).count() == 0
    spark.createDataFrame([(1, 2020), (5, 2020)], schema).write.parquet(str(tmp_path / "seed/results3"))
    store.append(spark.createDataFrame([(5, 2021)], schema), "results3")
    assert values(store.read("results3", schema, "id")) == [(1, 2020), (5, 2021)]
    with pytest.raises(Exception):
        store.initialise("results", schema)
    store.restore("results", schema)
    assert values(spark.read.parquet(str(tmp_path / "run/results")), "id") == [(1,)]


def test_two_runs(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    assert idempotency.difference(a, a).first().asDict() == {"only_first": 0, "only_second": 0}
    assert idempotency.difference(a, a.distinct()).first().asDict() == {"only_first": 1, "only_second": 0}
    b = spark.createDataFrame([(1, "z"), (3, "y")], "id int, v string")
    assert values(idempotency.by_key(a.distinct(), b, ["id"])) == [(1, "changed"), (2, "removed"), (3, "added")]


def test_integrity(spark):
    bad = spark.range(2)
    assert values(A.integrity({"a": bad, "b": bad.where("id > 5")})) == [("a", 2, False), ("b", 0, True)]


def test_grid_with_undisclosed(spark):
    """As over all slots laid out, also where keys are null or repeated; only reports meet results."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RESULT.fields)
    row = lambda r, i: tuple({"report_id": r, "indicator_id": i, "result_id": f"{r}|{i}"}.get(f.name) for f in S.RESULT.fields)
    results = spark.createDataFrame([row("r1", "a"), row("r1", "a"), row("r3", "b"), row(None, "a"), row("r2", None)], fields)
    reports = spark.createDataFrame([("r1",), ("r2",), ("r2",), (None,), ("r4",)], "report_id string")
    cat = spark.createDataFrame([("a",), ("b",), (None,)], "indicator_id string")
    found = guard.grid_with_undisclosed(results, reports, cat)
    assert values(found, *found.columns) == values(guard.with_undisclosed(results, reports.crossJoin(cat)), *found.columns)
