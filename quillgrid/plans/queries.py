"""The registered queries: report-indicator operators over the stand-in tables.

A customer stands in for a company, an order for a report (its year, a report type by its priority, its status), a
part type for an indicator, a line item for an extraction candidate (quantity: value, line status: unit, return flag: source,
discount: confidence), a document for a report's text, a page for a collected address and an event for a job event.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid import schemas as S
from quillgrid.catalogue import catalogue as built_in
from quillgrid.functions import columns as C
from quillgrid.functions import units as U
from quillgrid.operators import analytics as A
from quillgrid.operators import anchors, collect, extract, files, guard, idempotency, jobs, postings
from quillgrid.operators.export import csv_line
from quillgrid.operators.increments import Increments
from quillgrid.plans.oracle import SEARCH_TERMS
from quillgrid.platform import Platform
from quillgrid.sources import documents as D
from quillgrid.sources import layout
from quillgrid.sources.tables import Store, scratch, table
from quillgrid.streaming.ingest import ingest_new
from quillgrid.streaming.live_jobs import follow_jobs, read_live_jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: Fixed stand-in: a report type for each priority.
TYPE_OF_PRIORITY = {"1": "ESG", "2": "SD", "3": "CSR", "4": "ENV", "5": "OTHER"}
DOMAINS = ("example.com", "example.org")
SEARCH_TERM = "that"


def _report_type(priority: Column) -> Column:
    first = F.substring(priority, 1, 1)
    out = F.lit(None).cast("string")
    for digit, kind in TYPE_OF_PRIORITY.items():
        out = F.when(first == digit, kind).otherwise(out)
    return out


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_custkey").alias("company_id"),
        F.year("o_orderdate").cast("long").alias("report_year"),
        _report_type(F.col("o_orderpriority")).alias("report_type"),
        F.col("o_orderstatus").alias("status"),
        A.dec(F.col("o_totalprice")).alias("value"),
        "o_orderdate",
    )


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with report, company, year, indicator, unit and value."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_linestatus")
    own = reports(spark, sf_dir).select("report_id", "company_id", "report_year")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("indicator"))
    return (
        items.join(own, items.l_orderkey == own.report_id)
        .join(parts, items.l_partkey == parts.p_partkey)
        .select("report_id", "company_id", F.col("report_year").alias("year"), "indicator", F.col("l_linestatus").alias("unit"), A.dec(F.col("l_quantity")).alias("value"))
    )


def _double(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


@query
def q01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, reporting companies, companies, years and results (A1, A2)."""
    r = reports(spark, sf_dir).agg(F.count("*").alias("reports"), F.countDistinct("company_id").alias("reporting_companies"), F.countDistinct("report_year").alias("years"))
    c = table(spark, sf_dir, "customer").agg(F.count("*").alias("companies"))
    n = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("results"))
    row = r.crossJoin(c).crossJoin(n)
    return row.unpivot([], ["reports", "reporting_companies", "years", "companies", "results"], "entity", "n")


def _admission_rules() -> dict[str, Column]:
    return {
        "value": F.col("value").between(1000, 400000),
        "year": F.col("report_year").between(1996, 2001),
        "status": F.col("status").isin("F", "O", "P"),
        "type": F.col("report_type").isNotNull(),
    }


@query
def q02_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reports pass and how many need review."""
    return files.tally(files.admit(reports(spark, sf_dir), _admission_rules()), "decision")


@query
def q02b_admission_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each set of rules fails."""
    own = files.admit(reports(spark, sf_dir), _admission_rules())
    return own.groupBy(F.array_join("failed", "+").alias("failed_rules")).agg(F.count("*").alias("n"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("file_sha256"))


@query
def q03_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content hash."""
    return files.keep_first(_hashed(spark, sf_dir).select("doc_id", "file_sha256"), "file_sha256", "doc_id")


@query
def q04_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes that occur more than once."""
    return files.repeated(_hashed(spark, sf_dir), "file_sha256", "doc_id")


@query
def q05_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all other sources' documents those that the first source doesn't hold yet."""
    own = _hashed(spark, sf_dir)
    return files.not_stored(own.where("source <> 'src0'"), own.where("source = 'src0'"), "file_sha256", "doc_id").select("doc_id", "source", "file_sha256")


def _named_results(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Results of a year with company, area and indicator; the year is a range that reaches the scan."""
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    o = o.select("o_orderkey", "o_custkey", _report_type(F.col("o_orderpriority")).alias("report_type"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = i.join(o, i.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(p, i.l_partkey == p.p_partkey)
    return joined.select(
        F.col("o_orderkey").alias("report_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        "report_type",
        F.col("p_type").alias("indicator"),
        F.col("l_linestatus").alias("unit"),
        F.col("l_quantity").alias("value"),
    )


@query
def q06_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one year, type, indicator and unit, with names."""
    own = _named_results(spark, sf_dir, 1997)
    return own.where((F.col("report_type") == "ESG") & (F.col("indicator") == "ECONOMY") & (F.col("unit") == "O"))


@query
def q07_result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of results under a total order."""
    order = [F.col(c) for c in ("value", "report_id", "line", "part", "supplier", "company")]
    return A.page_of(_named_results(spark, sf_dir, 1998), [order[0].desc(), *order[1:]], 50, 25)


@query
def q08_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result with its evidence, also without one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    e = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(e, "doc_id", "left").select("doc_id", "source", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), F.col("quality").isNotNull().alias("has_evidence"))


@query
def q09_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a term, with the fragment around it."""
    return A.search(table(spark, sf_dir, "documents"), SEARCH_TERM)


@query
def q10_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each slot: source priority, confidence, ties."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity", "l_partkey", "l_suppkey")
    best = extract.best(items, ["l_orderkey", "l_linenumber"], {"N": 0, "R": 1, "A": 2}, "l_returnflag", "l_discount", ["l_partkey", "l_suppkey", "l_quantity"])
    return best.select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("source_type"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("value"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).groupBy("company_id", "indicator", "unit", "year").agg(F.sum("value").alias("value"), F.count("*").alias("n_results"))


@query
def q11_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable series: company, indicator and unit with two years or more, and changes."""
    own = A.trend(_yearly(spark, sf_dir), ["company_id", "indicator", "unit"])
    return own.select("company_id", "indicator", "unit", "year", *_double("value", "previous", "change"), "n_results", "n_years", "step")


@query
def q12_trend_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly values of a company with the year before only where there is no gap."""
    own = reports(spark, sf_dir).groupBy("company_id", "report_year").agg(F.sum("value").alias("value"))
    t = A.trend(own.withColumnRenamed("report_year", "year"), ["company_id"])
    followed = F.col("step") == 1
    relative = F.when(followed, F.try_divide(F.col("change").cast("double"), F.col("previous").cast("double")))
    return t.select("company_id", "year", *_double("value"), F.when(followed, F.col("change").cast("double")).alias("change"), F.when(F.col("step") > 1, True).otherwise(False).alias("after_gap"), (F.floor(relative * 10000).cast("double") / 10000).alias("relative_change"))


@query
def q13_three_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report for each year of companies that have all three."""
    r = reports(spark, sf_dir).select("company_id", "report_year", "report_id", "o_orderdate")
    own = A.complete_years(r, "company_id", "report_year", [1998, 1999, 2000], [F.col("o_orderdate"), F.col("report_id")])
    return own.select("company_id", "report_year", "report_id")


@query
def q14_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies ranked within a year and unit."""
    own = reports(spark, sf_dir).groupBy("report_year", F.col("status").alias("unit"), "company_id").agg(F.sum("value").alias("value"))
    return A.compare(own, ["report_year", "unit"]).select("report_year", "unit", "company_id", *_double("value"), "rank", "n_compared")


@query
def q15_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by year and status side by side (pivot)."""
    own = reports(spark, sf_dir).groupBy("report_year").pivot("status", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return own.select("report_year", *[F.coalesce(F.col(s), F.lit(0)).alias(f"n_{s.lower()}") for s in ("F", "O", "P")])


@query
def q16_mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company and indicator pairs whose values come in several units (A4's complement)."""
    return A.mixed_units(values(spark, sf_dir), ["company_id", "indicator"], "unit")


@query
def q17_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each year and type, zero where there is none."""
    r = reports(spark, sf_dir).select("report_year", "report_type")
    years = r.select("report_year").distinct()
    kinds = spark.createDataFrame([(k,) for k in (*TYPE_OF_PRIORITY.values(), "NEW")], "report_type string")
    return A.coverage(years.crossJoin(F.broadcast(kinds)), r, ["report_year", "report_type"])


@query
def q18_indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by source and unit with all totals."""
    own = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(A.dec(F.col("l_quantity"))).cast("double").alias("value"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("long").alias("level"))
    return own.select(F.coalesce("l_returnflag", F.lit("all")).alias("source_type"), F.coalesce("l_linestatus", F.lit("all")).alias("unit"), "n", "value", "level")


@query
def q19_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each text in order."""
    return extract.numbers(table(spark, sf_dir, "documents"))


@query
def q20_value_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of a text that a word follows, split."""
    found = extract.valued(table(spark, sf_dir, "documents"), ["of", "de", "the", "en", "in", "and"])
    return found.select("doc_id", "raw_unit", C.parse_number(F.col("raw_value")).cast("double").alias("value"))


@query
def q21_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by the layer that serves them: rule, table, OCR or model."""
    d = D.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("report_id"), F.lit("x").alias("indicator_id"), "text", "route")

    def layer(name: str, serves: Column) -> Callable[[DataFrame], DataFrame]:
        return lambda open_: d.where(serves).join(open_, ["report_id", "indicator_id"], "left_semi").select("report_id", "indicator_id", F.lit(name).alias("layer"), F.lit(1).alias("value"))

    layers = [layer("ocr", F.col("route") == "ocr"), layer("rule", F.col("text").rlike("[0-9]")), layer("table", F.contains("text", F.lit(" | "))), layer("model", F.lit(True))]
    return extract.layered(d.select("report_id", "indicator_id"), layers).groupBy("layer").agg(F.count("*").alias("n"))


@query
def q22_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text."""
    own = D.text_lines(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("line_md5"))


@query
def q23_collection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with the checks of the collector."""
    p = table(spark, sf_dir, "pages")
    manifest = p.select("page_id", "url", F.lit("c1").alias("company_id"), F.lit(2024).alias("report_year"), F.lit("ESG").alias("report_type"))
    own = collect.plan(manifest, DOMAINS)
    return own.select("page_id", C.host(F.col("url")).alias("host"), F.array_join("failed", "+").alias("failed"), "planned")


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table for every host: all but the paths of one letter, and of these one part again."""
    hosts = table(spark, sf_dir, "pages").select(C.host(F.col("url")).alias("host")).distinct()
    rules = F.array(F.struct(F.lit("/").alias("prefix"), F.lit(True).alias("allow")), F.struct(F.lit("/e").alias("prefix"), F.lit(False).alias("allow")), F.struct(F.lit("/en/6").alias("prefix"), F.lit(True).alias("allow")))
    return hosts.select("host", F.inline(rules))


@query
def q23b_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses the longest matching robots rule allows."""
    own = collect.robots_verdict(table(spark, sf_dir, "pages").select("page_id", "url"), _robots(spark, sf_dir))
    return own.select("page_id", "robots_allowed")


@query
def q23c_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest second of each request at one request a host and 2.5 seconds."""
    own = collect.paced(table(spark, sf_dir, "pages").select("url").distinct(), 2.5)
    return own.select("url", "host", "slot", "not_before_seconds")


@query
def q24_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two runs of the same batch."""
    r = reports(spark, sf_dir)
    once, twice = (Store(spark, scratch(spark, "seed"), scratch(spark, x)) for x in ("once", "twice"))
    run = lambda store, rows: store.replace_partitions(files.admit(rows, _admission_rules()).select("report_id", "company_id", "report_year", "decision"), "admitted", "report_year")
    run(once, r)
    run(twice, r)
    run(twice, r.repartition(7, "company_id"))  # the same batch in another order
    return idempotency.difference(*[spark.read.parquet(f"{store.runtime}/admitted") for store in (once, twice)])


@query
def q24b_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural keys of two different batches: same, changed, added, removed."""
    r = reports(spark, sf_dir)
    one = r.where("report_year <= 1999").groupBy("company_id").agg(F.count("*").alias("n"))
    two = r.where("report_year >= 1999").groupBy("company_id").agg(F.count("*").alias("n"))
    return idempotency.by_key(one, two, ["company_id"]).groupBy("state").agg(F.count("*").alias("n"))


STATE_OF_EVENT = {"signup": "queued", "view": "running", "purchase": "succeeded", "error": "failed", "click": "running"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.lit(None).cast("string")
    for kind, s in STATE_OF_EVENT.items():
        state = F.when(F.col("event_type") == kind, s).otherwise(state)
    return e.select(F.col("user_id").alias("job_id"), "event_id", state.alias("state"), "ts", "props", "value")


@query
def q25_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of each job."""
    return jobs.current(job_events(spark, sf_dir)).select("job_id", "state", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "n_events")


@query
def q26_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose job was silent for over 7,200 seconds afterwards."""
    return jobs.gaps(job_events(spark, sf_dir), "job_id", "ts", "event_id").select("job_id", "event_id", "gap_seconds", "late")


@query
def q26b_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure trail with reasons."""
    own = jobs.failures(job_events(spark, sf_dir))
    return own.select("job_id", "event_id", "state", F.get_json_object("props", "$.k").alias("reason"))


@query
def q27_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and repeated keys."""
    o, c, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    return A.integrity(
        {
            "report_without_company": o.join(c, o.o_custkey == c.c_custkey, "left_anti"),
            "result_without_report": i.join(o, i.l_orderkey == o.o_orderkey, "left_anti"),
            "repeated_report": o.groupBy("o_orderkey").count().where("count > 1"),
            "repeated_slot": i.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        }
    )


@query
def q28_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of each page (S2 for HTML)."""
    p = table(spark, sf_dir, "pages")
    text = D.html_text(F.col("html"))
    return p.select("page_id", D.html_title(F.col("html")).alias("title"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


@query
def q29_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property out of each event's JSON (X11)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query
def q30_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with its evidence chain in order."""
    r = reports(spark, sf_dir).select("report_id")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("source_type"))
    own = A.evidence_chain(r, e, "report_id", F.col("n"), ["part", "source_type"])
    chain = F.array_join(F.transform("chain", lambda x: F.concat_ws(":", x["rank"], x["part"], x["source_type"])), ",")
    return own.select("report_id", F.coalesce(chain, F.lit("")).alias("chain"), F.col("n_evidence").cast("long").alias("n_evidence"))


@query
def q31_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the grade of automatic acceptance."""
    i = table(spark, sf_dir, "lineitem")
    confidence = (1 - F.col("l_discount").cast("decimal(5,4)") * 5).cast("decimal(5,4)")
    flags = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_quantity") > 45, "large")))
    return files.tally(i.select(guard.review_status(confidence, flags).alias("review_status")), "review_status")


@query
def q32_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each indicator by disclosure: companies against the catalogue."""
    own = values(spark, sf_dir).select(F.col("company_id").alias("report_id"), F.col("indicator").alias("indicator_id"), F.lit("disclosed").alias("disclosure_status"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"))
    catalogue = table(spark, sf_dir, "part").select(F.col("p_type").alias("indicator_id")).distinct()
    return guard.disclosure(own, companies, catalogue).groupBy("indicator_id", "disclosure_status").agg(F.count("*").alias("n"))


@query
def q33_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each raw unit in canonical units, by an exact factor."""
    unit = F.when(F.col("l_returnflag") == "A", "kg").when(F.col("l_returnflag") == "N", "kt").otherwise("crate")
    i = table(spark, sf_dir, "lineitem").select(unit.alias("raw_unit"), F.col("l_quantity").cast("decimal(28,6)").alias("value"))
    own = U.normalise(i, U.unit_table(spark))
    return own.groupBy("raw_unit", "unit").agg(F.sum("value").cast("double").alias("value"), F.count("*").alias("n"))


@query
def q34_catalogue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantitative against qualitative results, by the catalogue."""
    kind = F.when(F.length("p_type") % 2 == 0, "quantitative").otherwise("qualitative")
    catalogue = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("indicator"), kind.alias("kind"))
    i = table(spark, sf_dir, "lineitem").select("l_partkey")
    return i.join(catalogue, i.l_partkey == catalogue.p_partkey).groupBy("kind", "indicator").agg(F.count("*").alias("n"))


@query
def q35_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by header and size checks."""
    d = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))
    own = files.admit(d, {"header": C.has_pdf_header(F.col("content")), "size": F.col("length") <= 65536})
    return own.groupBy(F.array_join("failed", "+").alias("failed"), "decision").agg(F.count("*").alias("n"), F.max("length").alias("largest"))


@query
def q36_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as CSV lines with their number in the export's order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    line = csv_line(["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    return c.select(F.col("c_custkey").alias("result_id"), line.alias("line")).orderBy("result_id")


@query
def q37_seed_and_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed and increments read as one."""
    r = reports(spark, sf_dir)
    own = r.select("report_id", "company_id", "report_year", "report_type")
    store = Store(spark, scratch(spark, "seed"), scratch(spark, "runtime"))
    own.where("report_year < 1999").write.parquet(f"{store.seed}/reports")
    store.append(own.where("report_year >= 1999"), "reports")
    at_seed = store.of_seed("reports", own.schema).select("report_id", F.lit("seed").alias("origin"))
    both = store.read("reports", own.schema, "report_id").join(at_seed, "report_id", "left").withColumn("origin", F.coalesce("origin", F.lit("runtime")))
    return both.groupBy("origin", "report_type").agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("companies"))


@query
def q38_candidates_of_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several extractors in one set, by layer and unit."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("indicator_id"), "l_returnflag", F.col("l_quantity").alias("value"))

    def layer(flag: str, name: str) -> Callable[[DataFrame], DataFrame]:
        return lambda open_: i.where(F.col("l_returnflag") == flag).join(open_, ["report_id", "indicator_id"], "left_semi").select("report_id", "indicator_id", F.lit(name).alias("source_type"), "value")

    found = extract.layered(i.select("report_id", "indicator_id").distinct(), [layer("N", "rule"), layer("R", "table"), layer("A", "model")])
    return files.tally(found, "source_type")


@query
def q39_best_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest values of each indicator and unit (top-k of a group)."""
    own = values(spark, sf_dir).groupBy("indicator", "unit", "company_id").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("indicator", "unit").orderBy(F.col("value").desc(), "company_id"))
    return own.withColumn("place", place.cast("long")).where("place <= 3").select("indicator", "unit", "place", "company_id", *_double("value"))


@query
def q40_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports read through the store: the runtime's stand for the seed's, and a copied seed counts once."""
    r = reports(spark, sf_dir).select("report_id", "company_id", "report_year", "status")
    store = Store(spark, scratch(spark, "seed"), scratch(spark, "runtime"))
    for name in ("reports", "copied"):
        r.where("report_year <= 1998").write.parquet(f"{store.seed}/{name}")
    store.append(r.where("report_year >= 1998").withColumn("status", F.lit("R")), "reports")
    store.initialise("copied", r.schema)
    store.append(r.where("report_year > 2000"), "copied")
    count = lambda name, df: df.groupBy(F.lit(name).alias("name"), "report_year", "status").agg(F.count("*").alias("n"))
    return count("reports", store.read("reports", r.schema, "report_id")).unionByName(count("copied", store.read("copied", r.schema, "report_id")))


@query
def q41_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each report's latest run: a second run of odd reports keeps large values alone, so some reports have none."""
    store = Store(spark, scratch(spark, "seed"), scratch(spark, "runtime"))
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"))
    runs = own.select("report_id").distinct()
    again = F.col("report_id") % 2 == 1
    for name, rows, listed, hour in (("a", own, runs, "00"), ("b", own.where(again & (F.col("value") > 40)), runs.where(again), "01")):
        store.append(rows.withColumn("run_id", F.lit(name)), "results")
        store.append(listed.select(F.lit(name).alias("run_id"), "report_id", F.lit(f"2024-01-01 {hour}:00:00").cast("timestamp_ntz").alias("ts")), "runs")
    store.append(own.withColumn("run_id", F.lit("c")), "results")  # a run that was never published
    found = idempotency.latest_runs(spark.read.parquet(f"{store.runtime}/results"), spark.read.parquet(f"{store.runtime}/runs"), "report_id")
    return found.groupBy("report_id", "run_id").agg(F.count("*").alias("n"), F.sum(A.dec(F.col("value"))).cast("double").alias("value"))


@query
def q42_time_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that end jobs which started over 7,200 seconds ago and aren't finished."""
    own = job_events(spark, sf_dir).select("job_id", "event_id", "state", "ts")
    return jobs.time_out(own, "2024-01-30 23:58:00").select("job_id", "event_id", "state", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "reason")


@query
def q43_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three layers, each asked for the slots that those before have left open, stored once each."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("indicator_id"), "l_returnflag", A.dec(F.col("l_quantity")).alias("value"))
    store = Store(spark, scratch(spark, "seed"), scratch(spark, "runtime"))

    def layer(flag: str, name: str) -> Callable[[DataFrame], DataFrame]:
        # a layer finds a value only where it is 10 or more
        return lambda open_: i.where(F.col("l_returnflag") == flag).join(open_, ["report_id", "indicator_id"], "left_semi").select("report_id", "indicator_id", F.lit(name).alias("source_type"), F.when(F.col("value") >= 10, F.col("value")).alias("value"))

    def keep(found: DataFrame, k: int) -> DataFrame:
        store.append(found, f"layer{k}")
        return store.of_runtime(f"layer{k}", found.schema)

    found = extract.layered(i.select("report_id", "indicator_id").distinct(), [layer("N", "rule"), layer("R", "table"), layer("A", "model")], keep)
    return found.groupBy("source_type").agg(F.count("*").alias("n"), F.count("value").alias("n_usable"), F.sum("value").cast("double").alias("value"))


#: A stand-in catalogue for invented prose: id, group 1 the value, group 2 the unit.
STAND_IN = (("W1", "(?:^| )the ([a-z]+) (of|and)(?: |$)"), ("W2", "(?:^| )(?:in|en) ([a-z]+) (to|de|the)(?: |$)"), ("W3", "([0-9][0-9,]*) ?([a-z]+)"), ("W4", "(?:^| )(is|was)()(?: |$)"))


@query
def q44_catalogue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each text line by a catalogue's patterns."""
    lines = D.text_lines(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "report_id")
    known = spark.createDataFrame([(i, "E", "quantitative", None, p) for i, p in STAND_IN], S.INDICATOR)
    found = extract.by_catalogue(lines, known)
    return found.groupBy("report_id", "indicator_id").agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("n_candidates"), F.min("raw_value").alias("least_value"), F.max("raw_unit").alias("largest_unit"), F.count("value").alias("n_numbers"))


@query
def q45_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the guard's flags and grade: fragment, value, unit and year."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), "text")
    k = F.pmod("report_id", F.lit(4))
    own = d.select(
        "report_id",
        F.lit(1).alias("page"),
        F.when(k == 0, "w1").otherwise("w2").alias("indicator_id"),
        F.when(k == 1, F.lit("no such words")).otherwise(F.substring("text", 1, 30)).alias("fragment"),
        F.when(k == 2, "#").otherwise(F.substring("text", 3, 2)).alias("raw_value"),
        F.when(k == 3, "kg").otherwise("t").alias("unit"),
        F.when(F.col("report_id") % 3 == 0, "0.9000").otherwise("0.7000").cast("decimal(5,4)").alias("confidence"),
    )
    pages = d.select("report_id", F.lit(1).alias("page"), "text")
    known = spark.createDataFrame([("w1", "quantitative", "t"), ("w2", "quantitative", "t")], "indicator_id string, kind string, canonical_unit string")
    found = guard.guard(own, pages, known, d.select("report_id", F.lit(2024).alias("report_year")))
    return found.select("report_id", F.array_join("risk_flags", "+").alias("risk_flags"), guard.review_status(F.col("confidence"), F.col("risk_flags")).alias("review_status"))


@query
def q46_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of each order's company against the built-in catalogue, by pillar and kind: what is disclosed and what isn't."""
    known = built_in(spark)
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("report_id"))
    mine = F.concat(F.lit("E"), F.lpad((F.col("o_custkey") % 37 + 1).cast("string"), 2, "0"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("report_id"), mine.alias("indicator_id")).distinct()
    fixed = {"disclosure_status": F.lit("disclosed"), "review_status": F.lit("candidate_found"), "report_id": F.col("report_id"), "indicator_id": F.col("indicator_id"), "result_id": F.concat_ws("|", "report_id", "indicator_id")}
    found = o.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.RESULT.fields])
    every = guard.grid_with_undisclosed(found, companies, known).join(known.select("indicator_id", "pillar", "kind"), "indicator_id")
    return every.groupBy("pillar", "kind", "disclosure_status").agg(F.count("*").alias("n"))


@query
def q47_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by their status after reviews were appended: the latest review counts."""
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"), F.lit("candidate_found").alias("review_status"))
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "auto_verified_high").otherwise("candidate_found")
    reviews = e.select((F.col("event_id") % 500).alias("result_id"), status.alias("review_status"), F.col("user_id").cast("string").alias("reviewer"), "ts")
    return files.tally(guard.reviewed(results, reviews), "review_status")


@query
def q48_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies, indicators, addresses and texts that hold a term."""
    own = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    t = lambda name: table(spark, sf_dir, name)
    found = A.search_all([own(t("customer"), "company", "c_custkey", "c_name"), own(t("part"), "indicator", "p_partkey", "p_name"), own(t("pages"), "address", "page_id", "url"), own(t("documents"), "text", "doc_id", "text")], "re")
    return found.select("kind", "id")


@query
def q49_robots_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots rules with wild cards, end anchors and agents (F2)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = p.select(C.host(F.col("url")).alias("host")).distinct()
    rule = lambda agent, prefix, allow: F.struct(F.lit(agent).alias("agent"), F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"))
    rules = hosts.select("host", F.inline(F.array(rule("*", "/", False), rule("Reader", "/*5", False), rule("reader", "/en*", True), rule("reader", "/de/*7$", False))))
    rules = rules.where((F.col("agent") == "*") | F.col("host").endswith(".com"))
    return collect.robots_verdict(p, rules, agent="reader").select("page_id", "robots_allowed")


@query
def q50_live_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's state as a stream of event files keeps it: files out of order, and a third of the events twice."""
    own = job_events(spark, sf_dir).select(F.col("job_id").cast("string").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), "state", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("reason"))
    source, target, checkpoint = (scratch(spark, x) for x in ("job-events", "live-jobs", "live-jobs-checkpoint"))
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for rows in (own.where(part == 0), own.where(part == 1), own.where(part != 1)):
        rows.write.mode("append").parquet(source)
        follow_jobs(spark, source, S.JOB_EVENT, checkpoint, target)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return read_live_jobs(spark, target).select(F.col("job_id").cast("long").alias("job_id"), "state", shown("ts"), "n_events", shown("started"), "overdue")


@query
def q51_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold each of some terms, how often and where first, from an inverted index built in two batches, one of them twice."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "postings")
    for batch, rest in (("first", 0), ("second", 1), ("first", 0)):
        postings.index(d.where(F.pmod("doc_id", F.lit(2)) == rest), path, batch, buckets=16)
    found = [postings.search(spark, path, term, 16).withColumn("term", F.lit(term)) for term in SEARCH_TERMS]
    return reduce(DataFrame.unionByName, found).select("term", "doc_id", "n_hits", "first_at")


@query
def q52_anchor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each text line by the patterns whose required words it holds."""
    lines = D.text_lines(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "report_id")
    known = spark.createDataFrame([(i, "E", "quantitative", None, p) for i, p in STAND_IN], S.INDICATOR)
    found = anchors.by_anchors(lines, known)
    return found.groupBy("report_id", "indicator_id").agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("n_candidates"), F.min("raw_value").alias("least_value"), F.max("raw_unit").alias("largest_unit"), F.count("value").alias("n_numbers"))


@query
def q53_layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tables in plain text with their label, header and unit: each order is a page with a table of its items (S3)."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("quantity"), A.dec(F.col("l_extendedprice")).cast("string").alias("price"))
    row = F.concat(F.rpad(F.concat(F.lit("item "), F.col("l_linenumber")), 14, " "), F.rpad("quantity", 12, " "), F.col("price"))
    head = F.array(F.lit("Order of items"), F.concat(F.rpad(F.lit("Item"), 14, " "), F.rpad(F.lit("Amount"), 12, " "), F.lit("Price")), F.concat(F.lit(" " * 14), F.rpad(F.lit("kg"), 12, " "), F.lit("CNY")))
    texts = i.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.concat(head, F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("t")))), lambda x: x["t"])), "\n").alias("text"))
    found = layout.table_facts(layout.tables(layout.rows_of_texts(texts)), U.unit_table(spark))
    return found.select("report_id", "row", "col", "label", "header", "unit", F.col("raw_value").cast("double").alias("value"))


@query
def q54_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a stream of files takes once each, in two runs; the second brings copies of what the first stored (T4, T5)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    source, target, checkpoint = (scratch(spark, x) for x in ("inbox", "ingested", "ingest-checkpoint"))
    middle = d.agg(F.percentile("doc_id", 0.5)).first()[0]
    for own in (d.where(F.col("doc_id") <= middle), d.where(F.col("doc_id") > middle)):
        own.write.mode("append").parquet(source)
        ingest_new(spark, source, d.schema, target, checkpoint)
    return spark.read.parquet(target).select("doc_id", "file_sha256")


@query
def q55_platform_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as the platform reads them: of the seed, after its copy, after runs of some reports, and after it was restored."""
    seed, runtime = scratch(spark, "seed"), scratch(spark, "runtime")
    text = lambda c: F.col(c).cast("string")
    items = table(spark, sf_dir, "lineitem").select(text("l_orderkey").alias("report_id"), text("l_linenumber").alias("indicator_id"), A.dec(F.col("l_quantity")).cast("decimal(28,6)").alias("value")).groupBy("report_id", "indicator_id").agg(F.max("value").alias("value"))
    # grouped once: all that follows reads it seven times
    grouped = scratch(spark, "items")
    items.write.parquet(grouped)
    items = spark.read.schema(items.schema).parquet(grouped)
    orders = reports(spark, sf_dir)
    shaped = lambda df, schema: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    key = F.concat_ws("-", "report_id", "indicator_id")
    results = items.withColumn("result_id", key).withColumn("disclosure_status", F.lit("disclosed"))
    evidence = items.select(key.alias("evidence_id"), key.alias("result_id"))
    shaped(orders.withColumn("report_id", text("report_id")).withColumn("company_id", text("company_id")), S.REPORT).write.parquet(f"{seed}/reports")
    shaped(results, S.RESULT).write.parquet(f"{seed}/results")
    shaped(evidence, S.EVIDENCE).write.parquet(f"{seed}/evidence")
    shaped(items.withColumn("candidate_id", key), S.CANDIDATE).write.parquet(f"{seed}/candidates")
    own = Platform(spark, seed, runtime)
    shown = []

    def show(step: str) -> None:
        for name, df in (("results", own._plain_results()), ("evidence", own._evidence()), ("candidates", own.candidates())):
            shown.append((step, name, df.count()))

    show("seed")
    own.initialise()
    show("copied")
    # a run of every seventh report keeps its first two slots
    again = (F.col("report_id").cast("long") % 7 == 0) & (F.col("indicator_id").cast("int") <= 2)
    run = F.concat(F.lit("run-"), F.col("report_id"))
    for name, df, schema in (("results", results, S.RESULT), ("evidence", evidence.withColumn("report_id", F.substring_index("result_id", "-", 1)).withColumn("indicator_id", F.substring_index("result_id", "-", -1)), S.EVIDENCE), ("candidates", items.withColumn("candidate_id", key), S.CANDIDATE)):
        full = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in ("report_id", "run_id") if c not in schema.fieldNames()]])
        own.store.append(shaped(df.where(again).withColumn("run_id", run), full), name)
    listed = orders.select(text("report_id").alias("report_id")).where(F.col("report_id").cast("long") % 7 == 0)
    own.store.append(listed.select(run.alias("run_id"), "report_id", F.localtimestamp().alias("ts")), "runs")
    show("run")
    own.restore()
    show("restored")
    return spark.createDataFrame(shown, "step string, name string, n long")


@query
def q56_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each report's latest run: appended, compacted, appended to again, and compacted with the old files removed."""
    store = Store(spark, scratch(spark, "seed"), scratch(spark, "runtime"))
    schema = T.StructType([T.StructField("report_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("run_id", T.StringType())])
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("report_id"), F.col("l_quantity").alias("value"))
    shown = []

    def run(name: str, own: DataFrame, hour: int) -> None:
        store.append(own.withColumn("run_id", F.lit(name)), "facts")
        listed = own.select(F.lit(name).alias("run_id"), F.col("report_id").cast("string").alias("report_id")).distinct()
        store.append(listed.withColumn("ts", F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp_ntz")).select(*S.RUN.fieldNames()), "runs")

    def latest() -> DataFrame:
        runs = store.of_runtime("runs", S.RUN).withColumn("report_id", F.col("report_id").cast("long"))
        return idempotency.latest_runs(store.of_runtime("facts", schema), runs, "report_id")

    def show(step: str) -> None:
        total = latest().groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("report_id").alias("n_reports"), F.sum(A.dec(F.col("value"))).cast("double").alias("value"))
        shown.extend((step, *r) for r in total.collect())

    run("a", items, 1)
    run("b", items.where(F.col("report_id") % 3 == 0), 2)
    show("appended")
    store.compact("facts", schema, "report_id", lambda rows: rows.join(latest().select("report_id", "run_id").distinct(), ["report_id", "run_id"], "left_semi"))
    show("compacted")
    run("c", items.where(F.col("report_id") % 5 == 0), 3)
    show("appended again")
    store.compact("facts", schema, "report_id")
    store.drop_superseded("facts", 0)
    show("files removed")
    return spark.createDataFrame(shown, "step string, run_id string, n long, n_reports long, value double")


def _in_batches(spark: SparkSession, sf_dir: str) -> Increments:
    """Reports and results in three batches, rows of two of them shared, one batch repeated; merged in between."""
    own = Increments(spark, scratch(spark, "increments"))
    third = F.pmod(F.xxhash64("report_id"), F.lit(3)).cast("int")
    r = reports(spark, sf_dir).withColumn("third", third)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("result_id"), F.col("l_partkey").alias("p"), F.col("l_linestatus").alias("unit"), A.dec(F.col("l_quantity")).alias("value"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("indicator"))
    # joined once; a batch reads its thirds
    joined = scratch(spark, "increment-results")
    v = items.join(r.select("report_id", "company_id", F.col("report_year").alias("year")), "report_id").join(parts, "p").drop("p").withColumn("third", third)
    v.write.partitionBy("third").parquet(joined)
    v, third = spark.read.schema(v.schema).parquet(joined), F.col("third")
    for batch, inside in (("first", third == 0), ("second", third < 2), ("third", third == 2), ("first", third == 0)):
        own.add(batch, r.where(inside).select("report_id", "company_id", F.col("report_year").alias("year"), F.struct("o_orderdate").alias("order")), v.where(inside))
        if batch == "second":
            own.fold()
    return own


@query
def q57_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, companies and results, in all and by year, and reports of companies with three years, from states that batches left."""
    own = _in_batches(spark, sf_dir)
    complete = own.complete_years([1998, 1999, 2000]).groupBy("year").agg(F.count("*").alias("n"))
    return own.summary().unionByName(own.by_year()).unionByName(complete.select(F.lit("complete").alias("entity"), "year", "n"))


@query
def q58_increment_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of each company's first result a year, from states that batches left (A4)."""
    return _in_batches(spark, sf_dir).trends().select("company_id", "indicator", "unit", "year", *_double("value", "previous", "change"), "n_years", "step")
