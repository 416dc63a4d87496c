"""The platform: one method for each operation of the public interface, over a seed and a runtime root.

Methods that read return DataFrames and check their arguments before a plan is built; methods that write append to the
runtime root. Text extraction takes a reader (bytes to page texts); further layers (OCR, a model)
are callables that get the slots that the layers before have left open. With ``images`` (bytes to page pictures) and ``engine``
(picture to text), pages of too little text are read from their pictures where slots are still open, each picture once.

An extraction is a run: its lines, each layer's candidates, results and evidence are written once under the run's id, and count
when the run is published, which is its last step. A report's facts are those of its latest run, also where that found nothing;
a run that failed or took too long is never published. Without a run the seed's facts hold.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid import schemas as S
from quillgrid.catalogue import catalogue as built_in
from quillgrid.functions import units as U
from quillgrid.operators import analytics as A
from quillgrid.operators import anchors, export, extract, files, guard, idempotency, jobs
from quillgrid.sources import documents as D
from quillgrid.sources import layout
from quillgrid.sources import reports as R
from quillgrid.sources.tables import Store

Layer = Callable[[DataFrame], DataFrame]
#: Tables whose rows belong to runs: to restore one of them takes back all runs so far.
FACTS = ("results", "evidence", "candidates")
#: Lines read from a page's picture are numbered from here.
OCR_LINES_FROM = 1_000_001
#: Hexadecimal digits of a hash that name an upload's partition.
UPLOAD_PREFIX = 2
#: Tables that a seed may bring.
SEED_TABLES = {"reports": S.REPORT, "results": S.RESULT, "evidence": S.EVIDENCE, "candidates": S.CANDIDATE, "reviews": S.REVIEW, "job_events": S.JOB_EVENT}


def _plain_text(content: bytes) -> Iterable[str]:
    """The built-in reader: the text after a PDF header line, or all of it; form feeds part pages."""
    body = content.decode("utf-8", "replace")
    return (body.split("\n", 1)[1] if body.startswith("%PDF-") and "\n" in body else body).split("\f")


class Platform:
    def __init__(self, spark: SparkSession, seed: str, runtime: str, catalogue: DataFrame | None = None, timeout: int = S.JOB_TIMEOUT_SECONDS, upload_limit: int = S.UPLOAD_LIMIT, images: Callable[[bytes], Iterable[bytes | None]] | None = None, engine: Callable[[bytes], str] | None = None):
        self.spark, self.store, self.catalogue = spark, Store(spark, seed, runtime), built_in(spark) if catalogue is None else catalogue
        if (images is None) != (engine is None):
            raise ValueError("images and engine go together")
        self.timeout, self.upload_limit, self.images, self.engine = timeout, upload_limit, images, engine

    # --- tables ---

    def reports(self) -> DataFrame:
        return self.store.read("reports", S.REPORT, "report_id")

    def _runs(self) -> DataFrame:
        """Published runs: the seed's, and those of the runtime since its facts were last restored."""
        since = self.store.restored(*FACTS)
        own = self.store.of_runtime("runs", S.RUN)
        return self.store.original("runs", S.RUN).unionByName(own if since is None else own.where(F.col("ts") > F.lit(since))).dropDuplicates(["run_id"])

    def _facts(self, name: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
        """Rows of a table with ``report_id``: those of no run, as the seed has them (copied or not), and those of each report's latest run."""
        extra = [T.StructField(c, T.StringType()) for c in ("report_id", "run_id") if c not in schema.fieldNames()]
        rows = self.store.read(name, T.StructType([*schema.fields, *extra]))
        # a layer's rows carry its number behind the run's id
        of_runs = rows.where(F.col("run_id").isNotNull()).withColumn("run_id", F.substring_index("run_id", "#", 1))
        return rows.where(F.col("run_id").isNull()).drop("run_id"), idempotency.latest_runs(of_runs, self._runs(), "report_id").drop("run_id")

    def _in_force(self, name: str, schema: T.StructType) -> DataFrame:
        """A table's facts: a report's latest run stands for the rows of no run."""
        plain, current = self._facts(name, schema)
        return plain.join(self._runs().select("report_id").distinct(), "report_id", "left_anti").select(*schema.fieldNames()).unionByName(current.select(*schema.fieldNames()))

    def _plain_results(self) -> DataFrame:
        return guard.reviewed(self._in_force("results", S.RESULT), self.store.read("reviews", S.REVIEW))

    def _results(self) -> DataFrame:
        """Results, reviewed, with their report's company, year and type."""
        own = self.reports().select("report_id", "company_id", "report_year", "report_type")
        return self._plain_results().join(own, "report_id", "left")

    def _evidence(self) -> DataFrame:
        """Evidence with ``report_id`` (null for what a seed brings without one)."""
        plain, current = self._facts("evidence", S.EVIDENCE)
        results, _ = self._facts("results", S.RESULT)
        replaced = results.join(self._runs().select("report_id").distinct(), "report_id", "left_semi").select("result_id")
        return plain.join(replaced, "result_id", "left_anti").select(*current.columns).unionByName(current)

    def candidates(self) -> DataFrame:
        """The candidates of all layers, of the seed and of each report's latest run."""
        return self._in_force("candidates", S.CANDIDATE)

    def initialise(self) -> None:
        """First start: copy the seed's tables to the runtime root. Reads give the same before and after."""
        for name, schema in self._of_seed():
            self.store.initialise(name, schema)

    def restore(self) -> None:
        """The seed's tables again, in place of what was written since; jobs must have ended."""
        for name, schema in self._of_seed():
            self.store.restore(name, schema)

    def compact(self, file_bytes: int = 128 << 20) -> dict[str, int]:
        """Rewrite what jobs have appended as few files; returns the new version of each table.

        Rows of runs that a later run of their report superseded go, and those of runs that failed over a timeout ago. Reads
        give the same before, during and after.
        """
        latest = self._runs().groupBy("report_id").agg(F.max(F.struct("ts", "run_id"))["run_id"].alias("run_id"))
        before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(seconds=self.timeout)
        ended = jobs.current(self._events()).where(F.col("state").isin("failed", "timed_out") & (F.col("ts") < F.lit(before))).select(F.col("job_id").alias("run_id"))
        superseded = self._runs().select("run_id").join(latest, "run_id", "left_anti")
        # what is listed now: a run that is published meanwhile isn't in it, and none is taken off
        gone = superseded.unionByName(ended.join(latest, "run_id", "left_anti")).distinct()
        of_runs = lambda rows: rows.join(gone.select(F.col("run_id").alias("gone_id")), F.substring_index("run_id", "#", 1) == F.col("gone_id"), "left_anti")
        done: dict[str, int] = {}
        for name, schema in ({"lines": S.PAGE_LINE} | {n: SEED_TABLES[n] for n in FACTS}).items():
            extra = [T.StructField(c, T.StringType()) for c in ("report_id", "run_id") if c not in schema.fieldNames()]
            done[name] = self.store.compact(name, T.StructType([*schema.fields, *extra]), "report_id", of_runs, file_bytes)
        upload = T.StructType([*S.REPORT.fields, T.StructField("upload_id", T.StringType())])
        for name, schema, key in (("reports", upload, "report_id"), ("reviews", S.REVIEW, "result_id"), ("jobs", S.JOB, "job_id"), ("job_events", S.JOB_EVENT, "job_id")):
            done[name] = self.store.compact(name, schema, key, file_bytes=file_bytes)
        # last: until then, rows of a superseded run that are still there are told by it
        done["runs"] = self.store.compact("runs", S.RUN, "report_id", lambda rows: rows.join(gone, "run_id", "left_anti"), file_bytes)
        return done

    def drop_superseded(self, older_than: float | None = None) -> int:
        """Remove files that versions stand for, once these are older than the timeout of jobs; returns how many went."""
        named = ("lines", *FACTS, "reports", "reviews", "jobs", "job_events", "runs")
        return sum(self.store.drop_superseded(name, self.timeout if older_than is None else older_than) for name in named)

    def _of_seed(self) -> list[tuple[str, T.StructType]]:
        return [(name, schema) for name, schema in SEED_TABLES.items() if self.store.has_seed(name)]

    def _events(self) -> DataFrame:
        return self.store.read("job_events", S.JOB_EVENT)

    # --- health and summary ---

    def health(self) -> DataFrame:
        """``check_name, n_bad, ok``."""
        reports, results, evidence = self.reports(), self._plain_results(), self._evidence()
        return A.integrity(
            {
                "repeated_report": reports.groupBy("report_id").count().where("count > 1"),
                "repeated_file": files.repeated(reports, "file_sha256", "report_id"),
                "unknown_report_type": reports.where(~F.coalesce(F.col("report_type").isin(*S.REPORT_TYPES), F.lit(False))),
                "result_without_report": results.join(reports, "report_id", "left_anti"),
                "repeated_result": results.groupBy("result_id").count().where("count > 1"),
                "evidence_without_result": evidence.join(results, "result_id", "left_anti"),
                "invalid_job_event": jobs.invalid(self._events()),
            }
        )

    def summary(self) -> DataFrame:
        """``entity, n``: reports, companies, indicators, results, evidence, jobs."""
        r = self.reports().agg(F.count("*").alias("reports"), F.countDistinct("company_id").alias("companies"))
        row = r.crossJoin(self.catalogue.agg(F.count("*").alias("indicators")))
        row = row.crossJoin(self._plain_results().agg(F.count("*").alias("results"))).crossJoin(self._evidence().agg(F.count("*").alias("evidence")))
        row = row.crossJoin(self._events().agg(F.countDistinct("job_id").alias("jobs")))
        return row.unpivot([], row.columns, "entity", "n")

    # --- reports and jobs ---

    def register(self, path: str, company_id: str, report_year: int, report_type: str) -> DataFrame:
        """Register the files of a path and keep their content; those whose content is known are left out. Returns the new reports."""
        R.check_metadata(company_id, report_year, report_type)
        source = R.read_files(self.spark, path)
        found = R.register(source, company_id, report_year, report_type, self.upload_limit)
        own = found.select(*S.REPORT.fieldNames())
        upload = uuid.uuid4().hex
        new = files.not_stored(own, self.reports(), "file_sha256", "source_url").select(*S.REPORT.fieldNames())
        self.store.append(new.withColumn("upload_id", F.lit(upload)), "reports")
        written = self.store.of_runtime("reports", T.StructType([*S.REPORT.fields, T.StructField("upload_id", T.StringType())]))
        mine = written.where(F.col("upload_id") == upload).drop("upload_id")
        content = source.select(F.sha2("content", 256).alias("file_sha256"), "content", F.col("path").alias("source_url"))
        kept = content.join(mine.select("file_sha256", "source_url"), ["file_sha256", "source_url"], "left_semi").select(*S.UPLOAD.fieldNames())
        self.store.append(kept.withColumn("prefix", F.substring("file_sha256", 1, UPLOAD_PREFIX)), "uploads_by_hash", "prefix")
        return mine

    def _content(self, file_sha256: str) -> DataFrame:
        """``file_sha256, content`` of an upload: of those that are kept by hash, only the hash's own partition is read."""
        by_hash = self.store.of_runtime("uploads_by_hash", T.StructType([*S.UPLOAD.fields, T.StructField("prefix", T.StringType())])).where(F.col("prefix") == (file_sha256 or "")[:UPLOAD_PREFIX]).drop("prefix")
        return self.store.read("uploads", S.UPLOAD).unionByName(by_hash).where(F.col("file_sha256") == file_sha256).dropDuplicates(["file_sha256"])

    def submit(self, report_id: str) -> str:
        """Queue an extraction; returns the job's id at once."""
        if not self.reports().where(F.col("report_id") == report_id).head(1):
            raise ValueError(f"no report {report_id}")
        job = uuid.uuid4().hex
        self.store.append(self.spark.createDataFrame([(job, report_id)], S.JOB), "jobs")
        self._tell(job, "queued")
        return job

    def create_job(self, report_id: str, reader: Callable[[bytes], Iterable[str]] = _plain_text, layers: Iterable[Layer] = ()) -> str:
        """Queue an extraction and run it here; returns the job's id."""
        job = self.submit(report_id)
        self.run(job, reader, layers)
        return job

    def run_queued(self, reader: Callable[[bytes], Iterable[str]] = _plain_text, layers: Iterable[Layer] = (), most: int = 10) -> list[str]:
        """Run up to ``most`` queued jobs, the oldest first; returns their ids. Jobs that other runners take meanwhile are theirs."""
        waiting = jobs.current(self._events()).where("state = 'queued'").orderBy("ts", "job_id").limit(most).collect()
        taken = []
        for r in waiting:
            if self.store.claim(f"job-{r['job_id']}"):
                self._run_claimed(r["job_id"], reader, layers)
                taken.append(r["job_id"])
        return taken

    def time_out(self, now: dt.datetime | None = None) -> None:
        """End the jobs that have run for over the timeout, such as those whose runner is gone."""
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.store.append(jobs.time_out(self._events(), now.isoformat(sep=" "), self.timeout), "job_events")

    def _tell(self, job: str, state: str, reason: str | None = None) -> None:
        number = (self._events().where(F.col("job_id") == job).agg(F.max("event_id")).first()[0] or 0) + 1
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.store.append(jobs.event(self.spark, job, number, state, now, reason), "job_events")

    def run(self, job_id: str, reader: Callable[[bytes], Iterable[str]] = _plain_text, layers: Iterable[Layer] = ()) -> None:
        """Extract the report of a queued job. A failure is an event, not an exception; over the timeout Spark's jobs are cancelled."""
        state = self.job(job_id).first()
        if state is None or state["state"] != "queued" or not self.store.claim(f"job-{job_id}"):
            raise ValueError(f"job {job_id} isn't queued")
        self._run_claimed(job_id, reader, layers)

    def _run_claimed(self, job_id: str, reader: Callable[[bytes], Iterable[str]], layers: Iterable[Layer]) -> None:
        report = self.store.of_runtime("jobs", S.JOB).where(F.col("job_id") == job_id).first()["report_id"]
        self._tell(job_id, "running")
        context, begun = self.spark.sparkContext, time.monotonic()
        context.setJobGroup(job_id, f"extraction of {report}", interruptOnCancel=True)
        alarm = threading.Timer(self.timeout, context.cancelJobGroup, [job_id])
        alarm.daemon = True
        alarm.start()
        late = lambda: time.monotonic() - begun > self.timeout
        try:
            self._extract(job_id, report, reader, list(layers))
            problem = None
        except Exception as e:  # noqa: BLE001  the trail keeps the reason
            problem = f"{type(e).__name__}: {str(e).splitlines()[0][:500]}"
        finally:
            alarm.cancel()
            context.setJobGroup("", "")
        if late():
            self._tell(job_id, "timed_out", f"over {self.timeout} s")
        elif problem:
            self._tell(job_id, "failed", problem)
        else:
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            self.store.append(self.spark.createDataFrame([(job_id, report, now)], S.RUN), "runs")
            self._tell(job_id, "succeeded")

    def _keep(self, rows: DataFrame, name: str, schema: T.StructType, run_id: str) -> DataFrame:
        """Append rows of a run and read them back: what made them runs once."""
        extra = [T.StructField(c, T.StringType()) for c in ("report_id", "run_id") if c not in schema.fieldNames()]
        full = T.StructType([*schema.fields, *extra])
        self.store.append(rows.withColumn("run_id", F.lit(run_id)).select(*full.fieldNames()), name)
        return self.store.of_runtime(name, full).where(F.col("run_id") == run_id).drop("run_id")

    def _extract(self, run_id: str, report_id: str, reader: Callable[[bytes], Iterable[str]], layers: list[Layer]) -> None:
        report = self.reports().where(F.col("report_id") == report_id)
        source = report.select("file_sha256", "admission").first()
        if source["admission"] != "pass":
            raise ValueError("the file needs review")
        content = self._content(source["file_sha256"])
        lines = self._keep(D.read_pages(content.select(F.lit(report_id).alias("report_id"), "content"), reader), "lines", S.PAGE_LINE, run_id)
        broken = lines.where("page is null").head(1)
        if broken:
            raise ValueError(broken[0]["text"])
        slots = report.select("report_id").crossJoin(self.catalogue.select("indicator_id"))
        units = U.unit_table(self.spark)
        rules: Layer = lambda open_: anchors.by_anchors(lines, self.catalogue).join(open_, ["report_id", "indicator_id"], "left_semi")
        tables: Layer = lambda open_: layout.table_candidates(layout.table_facts(layout.tables(layout.rows_of_lines(lines)), units), self.catalogue, self.reports().select("report_id", "report_year")).join(open_, ["report_id", "indicator_id"], "left_semi")
        known = S.CANDIDATE.fieldNames()
        # each layer has a table of the run's of its own name to read back from
        keep = lambda found, k: self._keep(U.normalise(found, units).select(*known), "candidates", S.CANDIDATE, run_id if k == 0 else f"{run_id}#{k}")
        read: list[DataFrame] = [lines]

        def pictures(open_: DataFrame) -> DataFrame:
            read.append(self._read_pictures(content.select(F.lit(report_id).alias("report_id"), "content"), lines, run_id))
            return anchors.by_anchors(read[-1], self.catalogue).withColumn("source_type", F.lit("ocr")).withColumn("candidate_id", F.concat(F.lit("ocr-"), "candidate_id")).join(open_, ["report_id", "indicator_id"], "left_semi")

        found = extract.layered(slots, [rules, tables, *([pictures] if self.engine else []), *layers], keep)
        every_line = reduce(DataFrame.unionByName, read)
        pages = every_line.groupBy("report_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
        results, evidence = guard.accept(guard.guard(found, pages, self.catalogue, self.reports().select("report_id", "report_year")))
        every = guard.with_undisclosed(results.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.RESULT.fields]), slots)
        self._keep(every, "results", S.RESULT, run_id)
        self._keep(evidence.withColumn("report_id", F.lit(report_id)), "evidence", S.EVIDENCE, run_id)

    def _read_pictures(self, content: DataFrame, lines: DataFrame, run_id: str) -> DataFrame:
        """Lines of the pages of too little text, from their pictures; a picture whose text is kept doesn't reach the engine."""
        length = F.sum(F.length(F.trim("text"))).alias("own_length")
        own = D.page_images(content, self.images).join(lines.groupBy("report_id", "page").agg(length), ["report_id", "page"], "left")
        wanted = D.scanned(own.where("image IS NOT NULL").withColumn("text", F.repeat(F.lit("x"), F.coalesce("own_length", F.lit(0)).cast("int")))).where("route = 'ocr'").select("report_id", "page", "image")
        cache = lambda: self.store.of_runtime("ocr_cache", S.OCR_CACHE).dropDuplicates(["page_sha256"])
        _, new = D.ocr(wanted, cache(), self.engine)
        self.store.append(new, "ocr_cache")
        # every picture is known now: the engine isn't called again
        texts = wanted.select("report_id", "page", F.sha2("image", 256).alias("page_sha256")).join(cache(), "page_sha256")
        split = texts.select("report_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.trim("text") != "")
        # numbered behind the lines that the page's own text has
        shown = split.withColumn("line_no", F.col("line_no") + OCR_LINES_FROM)
        return self._keep(shown, "lines", S.PAGE_LINE, f"{run_id}#ocr")

    def inventory(self) -> DataFrame:
        """``report_year, n_reports, n_companies``: what is registered of each year."""
        return self.reports().groupBy("report_year").agg(F.count("*").alias("n_reports"), F.countDistinct("company_id").alias("n_companies"))

    def job(self, job_id: str) -> DataFrame:
        """The current state of a job; no row for an unknown one."""
        return jobs.current(self._events().where(F.col("job_id") == job_id))

    # --- results ---

    def results(self, company_id: str | None = None, report_id: str | None = None, indicator_id: str | None = None, year: int | None = None, unit: str | None = None, review_status: str | None = None, term: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        """One page of results under a total order."""
        if year is not None and (not isinstance(year, int) or isinstance(year, bool)):
            raise ValueError("year must be a number")
        if review_status is not None and review_status not in S.REVIEW_STATUSES:
            raise ValueError(f"review_status must be one of {', '.join(S.REVIEW_STATUSES)}")
        if not isinstance(offset, int) or not isinstance(limit, int):
            raise ValueError("offset and limit must be numbers")
        own = self._results()
        for name, wanted in (("company_id", company_id), ("report_id", report_id), ("indicator_id", indicator_id), ("report_year", year), ("unit", unit), ("review_status", review_status)):
            if wanted is not None:
                own = own.where(F.col(name) == wanted)
        if term is not None:
            if not term:
                raise ValueError("an empty search term")
            own = own.where(F.contains("text_value", F.lit(term)))
        return A.page_of(own, [F.col("company_id"), F.col("report_year"), F.col("indicator_id"), F.col("result_id")], offset, limit)

    def evidence(self, result_id: str) -> DataFrame:
        """A result with its evidence chain, the best first; the chain is empty where there is none."""
        if not result_id:
            raise ValueError("result_id is empty")
        own = self._results().where(F.col("result_id") == result_id)
        chain = self._evidence().where(F.col("result_id") == result_id)
        return A.evidence_chain(own, chain, "result_id", F.struct(F.size("risk_flags").alias("n_flags"), (-F.col("confidence")).alias("c"), F.col("evidence_id").alias("id")), ["page", "fragment", "source_type", "confidence", "risk_flags", F.col("review_status").alias("status")])

    def review(self, result_id: str, review_status: str, reviewer: str, note: str | None = None) -> None:
        """Append a review; a result's status is that of its latest one."""
        if review_status not in S.REVIEW_STATUSES or not reviewer:
            raise ValueError(f"a reviewer is needed, and review_status must be one of {', '.join(S.REVIEW_STATUSES)}")
        if not self._plain_results().where(F.col("result_id") == result_id).head(1):
            raise ValueError(f"no result {result_id}")
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.store.append(self.spark.createDataFrame([(result_id, review_status, reviewer, now, note)], S.REVIEW), "reviews")

    def search_evidence(self, term: str) -> DataFrame:
        """Evidence whose fragment holds the term."""
        if not term:
            raise ValueError("an empty search term")
        return self._evidence().where(F.contains("fragment", F.lit(term)))

    def search(self, term: str) -> DataFrame:
        """``kind, id, report_id, page, text``: companies, reports, indicators, results and evidence that hold the term."""
        own = lambda df, kind, key, text, report=F.lit(None), page=F.lit(None): df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), report.cast("string").alias("report_id"), page.cast("int").alias("page"), text.alias("text"))
        reports, report = self.reports(), F.col("report_id")
        return A.search_all(
            [
                own(reports.select("company_id").distinct(), "company", "company_id", F.col("company_id")),
                own(reports, "report", "report_id", F.concat_ws(" ", "report_type", F.col("report_year").cast("string"), "source_url"), report),
                own(self.catalogue, "indicator", "indicator_id", F.concat_ws(" ", "indicator_id", "pillar", "kind", "canonical_unit", "pattern")),
                own(self._plain_results(), "result", "result_id", F.col("text_value"), report),
                own(self._evidence(), "evidence", "evidence_id", F.col("fragment"), report, F.col("page")),
            ],
            term,
        )

    def trends(self, company_id: str, indicator_id: str | None = None) -> DataFrame:
        """Yearly series of a company: one canonical unit each, two years or more."""
        if not company_id:
            raise ValueError("company_id is empty")
        own = self._results().where((F.col("company_id") == company_id) & F.col("value").isNotNull() & F.col("unit").isNotNull())
        if indicator_id is not None:
            own = own.where(F.col("indicator_id") == indicator_id)
        one = own.withColumn("_n", F.row_number().over(Window.partitionBy("company_id", "indicator_id", "unit", "report_year").orderBy("result_id"))).where("_n = 1")
        series = one.select("company_id", "indicator_id", "unit", F.col("report_year").alias("year"), "value")
        return A.trend(series, ["company_id", "indicator_id", "unit"])

    def compare(self, indicator_id: str, year: int, unit: str) -> DataFrame:
        """Companies ranked in one year and unit."""
        if not indicator_id or not unit or not isinstance(year, int) or isinstance(year, bool):
            raise ValueError("indicator_id, year and unit are needed")
        own = self._results().where((F.col("indicator_id") == indicator_id) & (F.col("report_year") == year) & (F.col("unit") == unit) & F.col("value").isNotNull())
        return A.compare(own.select("company_id", "report_id", "indicator_id", F.col("report_year").alias("year"), "unit", "value"), ["indicator_id", "year", "unit"])

    def export_csv(self, path: str, one_file: bool = True) -> None:
        """All results as CSV, ordered."""
        columns = ["result_id", "company_id", "report_id", "report_year", "report_type", "indicator_id", "value", "text_value", "unit", "disclosure_status", "review_status"]
        export.results_csv(self._results(), path, columns, [F.col("company_id"), F.col("report_year"), F.col("indicator_id"), F.col("result_id")], one_file)
