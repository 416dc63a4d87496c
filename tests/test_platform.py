"""The whole chain: register, extract, read; and abnormal input."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from quillgrid import schemas as S
from quillgrid.platform import Platform

CATALOGUE = [("E01", "E", "quantitative", "t", r"emissions of ([0-9][0-9,.]*) ?(kt|t)\b"), ("E02", "E", "quantitative", "kWh", r"power of ([0-9][0-9,.]*) ?(MWh|kWh)\b"), ("S01", "S", "qualitative", None, r"(training) (programme)")]


@pytest.fixture(scope="module")
def platform(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("platform")
    p = Platform(spark, str(root / "seed"), str(root / "run"), spark.createDataFrame(CATALOGUE, S.INDICATOR))
    inbox = root / "in"
    inbox.mkdir()
    for name, company, year, text in (
        ("a23.pdf", "c1", 2023, "In 2023 emissions of 1,200 kt were counted.\nPower of nothing.\fa training programme runs"),
        ("a24.pdf", "c1", 2024, "In 2024 emissions of 900,000 t\npower of 5 MWh"),
        ("b24.pdf", "c2", 2024, "emissions of 7 kt in 2019"),
    ):
        (inbox / name).write_text(f"%PDF-1.4\n{text}\n", "utf-8")
        p.register(str(inbox / name), company, year, "ESG")
    p.inbox = inbox
    p.jobs = [p.create_job(r["report_id"]) for r in p.reports().orderBy("company_id", "report_year").collect()]
    return p


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_chain(platform):
    assert [rows(platform.job(j), "state") for j in platform.jobs] == [[("succeeded",)]] * 3
    assert all(r["ok"] for r in platform.health().collect())
    assert dict(rows(platform.summary(), "entity", "n")) == {"reports": 3, "companies": 2, "indicators": 3, "results": 9, "evidence": 5, "jobs": 3}
    assert platform.results().where("disclosure_status = 'not_disclosed'").count() == 4 and platform.candidates().count() == 5
    got = rows(platform.results().where("disclosure_status = 'disclosed'"), "company_id", "report_year", "indicator_id", "value", "unit", "review_status")
    assert got == [
        ("c1", 2023, "E01", Dec("1200000.000000"), "t", "auto_verified_high"),
        ("c1", 2023, "S01", None, None, "auto_verified_high"),
        ("c1", 2024, "E01", Dec("900000.000000"), "t", "auto_verified_high"),
        ("c1", 2024, "E02", Dec("5000.000000"), "kWh", "auto_verified_high"),
        ("c2", 2024, "E01", Dec("7000.000000"), "t", "candidate_found"),
    ]


def test_read_paths(platform, tmp_path):
    assert rows(platform.trends("c1"), "indicator_id", "year", "change") == [("E01", 2023, None), ("E01", 2024, Dec("-300000.000000"))]
    assert rows(platform.trends("c2"), "year") == []
    assert sorted(rows(platform.compare("E01", 2024, "t"), "company_id", "rank")) == [("c1", 1), ("c2", 2)]
    one = platform.results(company_id="c2", indicator_id="E01").first()
    chain = platform.evidence(one["result_id"]).first()["chain"]
    assert [(e["page"], e["fragment"], e["risk_flags"]) for e in chain] == [(1, "emissions of 7 kt in 2019", ["other_year"])]
    assert rows(platform.evidence("unknown"), "result_id") == []
    assert rows(platform.search_evidence("training"), "page") == [(2,)]
    assert sorted(rows(platform.search("training"), "kind")) == [("evidence",), ("indicator",), ("result",)]
    assert rows(platform.search("c2"), "kind", "id") == [("company", "c2")]
    assert rows(platform.results(year=2024, offset=1, limit=1), "indicator_id") == [("E02",)]
    assert platform.results(review_status="candidate_found").count() == 1 and platform.job("unknown").count() == 0
    platform.export_csv(str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert len(part.read_text("utf-8").splitlines()) == 10


def test_repeats_change_nothing(platform):
    before = sorted(rows(platform.results(), *S.RESULT.fieldNames()), key=str)
    assert platform.register(str(platform.inbox / "a23.pdf"), "c1", 2023, "ESG").count() == 0
    (platform.inbox / "copy.pdf").write_bytes((platform.inbox / "a23.pdf").read_bytes())
    assert platform.register(str(platform.inbox / "copy.pdf"), "c9", 2025, "SD").count() == 0
    for r in platform.reports().collect():
        platform.create_job(r["report_id"])
    assert sorted(rows(platform.results(), *S.RESULT.fieldNames()), key=str) == before
    assert all(r["ok"] for r in platform.health().collect())


def test_failures_leave_a_trail(platform):
    (platform.inbox / "odd.pdf").write_bytes(b"no header")
    (platform.inbox / "good.pdf").write_bytes(b"%PDF-1.4\nx")
    bad = platform.register(str(platform.inbox / "odd.pdf"), "c3", 2024, "OTHER").first()
    good = platform.register(str(platform.inbox / "good.pdf"), "c3", 2023, "OTHER").first()
    assert bad["admission"] == "review"

    def broken(content):
        raise RuntimeError("cannot read")

    jobs = [platform.create_job(bad["report_id"]), platform.create_job(good["report_id"], broken)]
    assert [rows(platform.job(j), "state") for j in jobs] == [[("failed",)], [("failed",)]]
    reasons = platform._events().where(F.col("state") == "failed").select("reason").collect()
    assert sorted(r[0] for r in reasons) == ["ValueError: RuntimeError: cannot read", "ValueError: the file needs review"]
    slow = Platform(platform.spark, platform.store.seed, platform.store.runtime, platform.catalogue, timeout=0)
    late = slow.create_job(platform.reports().where("company_id = 'c2'").first()["report_id"])
    assert rows(platform.job(late), "state") == [("timed_out",)]


def test_a_model_sees_only_open_slots_and_all_run_once(platform, tmp_path):
    seen = []
    (tmp_path / "calls").touch()
    calls = str(tmp_path / "calls")

    def counted(df, name):
        def touch(batches):
            for b in batches:
                with open(calls, "a") as f:
                    f.write(f"{name}\n" * b.num_rows)
                yield b

        return df.mapInArrow(touch, df.schema)

    def reader(content):
        with open(calls, "a") as f:
            f.write("reader\n")
        return content.decode().split("\n", 1)[1].split("\f")

    def model(open_):
        seen.extend(r["indicator_id"] for r in open_.collect())
        return counted(open_, "model").join(platform.spark.createDataFrame([], S.CANDIDATE).drop("report_id", "indicator_id"), F.lit(False), "left").select(*S.CANDIDATE.fieldNames())

    report = platform.reports().where("company_id = 'c1' and report_year = 2024").first()["report_id"]
    job = platform.create_job(report, reader, layers=[model])
    assert sorted(seen) == ["S01"] and rows(platform.job(job), "state") == [("succeeded",)]
    assert sorted((tmp_path / "calls").read_text().split()) == ["model", "reader"]


def test_queue_reviews_and_uploads(platform):
    report = platform.reports().where("company_id = 'c1' and report_year = 2023").first()["report_id"]
    (platform.inbox / "a23.pdf").unlink()  # the upload was kept
    first, second = platform.submit(report), platform.submit(report)
    assert rows(platform.job(first), "state") == [("queued",)]
    assert platform.run_queued(most=1) == [first] and platform.run_queued() == [second] and platform.run_queued() == []
    assert rows(platform.job(second), "state") == [("succeeded",)] and platform.results(report_id=report).count() == 3
    with pytest.raises(ValueError):
        platform.run(first)
    one = platform.results(report_id=report, indicator_id="E01").first()["result_id"]
    platform.review(one, "rejected", "r1")
    assert rows(platform.results(report_id=report, review_status="rejected"), "result_id") == [(one,)]
    for call in (lambda: platform.review(one, "good", "r1"), lambda: platform.review("none", "rejected", "r1"), lambda: platform.review(one, "rejected", "")):
        with pytest.raises(ValueError):
            call()


def test_a_run_that_finds_nothing_empties_its_slots(platform):
    report = platform.reports().where("company_id = 'c2'").first()["report_id"]
    before = rows(platform.results(report_id=report).where("value is not null"), "indicator_id")
    job = platform.create_job(report, lambda content: ["nothing here"])
    after = platform.results(report_id=report)
    assert before == [("E01",)] and rows(platform.job(job), "state") == [("succeeded",)]
    assert after.count() == 3 and after.where("disclosure_status = 'disclosed'").count() == 0
    assert platform._evidence().where(F.col("report_id") == report).count() == 0
    assert all(r["ok"] for r in platform.health().collect())


def test_runtime_facts_stand_for_the_seed(spark, tmp_path):
    root = tmp_path
    report = ("r1", "c1", 2024, "ESG", "x", 1, "u", "pass")
    result = lambda r, i, v: (f"{r}{i}", r, i, Dec(v), None, "t", "disclosed", "auto_verified_high")
    spark.createDataFrame([report, ("r2", "c1", 2023, "ESG", "y", 1, "u", "pass")], S.REPORT).write.parquet(str(root / "seed/reports"))
    spark.createDataFrame([result("r1", "E01", 1), result("r2", "E01", 2)], S.RESULT).write.parquet(str(root / "seed/results"))
    spark.createDataFrame([("e1", "r1E01", 1, "f", "rule", Dec("0.9"), [], "auto_verified_high"), ("e2", "r2E01", 1, "f", "rule", Dec("0.9"), [], "auto_verified_high")], S.EVIDENCE).write.parquet(str(root / "seed/evidence"))
    p = Platform(spark, str(root / "seed"), str(root / "run"), spark.createDataFrame(CATALOGUE, S.INDICATOR))
    assert p.results().count() == 2 and p._evidence().count() == 2
    p.store.append(spark.createDataFrame([("x", b"%PDF-1\nemissions of 5 t")], S.UPLOAD), "uploads")
    job = p.create_job("r1")
    assert rows(p.job(job), "state") == [("succeeded",)]
    assert sorted(rows(p.results().where("value is not null"), "report_id", "value")) == [("r1", Dec("5.000000")), ("r2", Dec("2.000000"))]
    assert p._evidence().count() == 2 and all(r["ok"] for r in p.health().collect())
    p.store.initialise("reports", S.REPORT)
    assert p.reports().count() == 2
    slow = Platform(spark, p.store.seed, p.store.runtime, p.catalogue, timeout=0)
    late = slow.create_job("r2")
    assert rows(p.job(late), "state") == [("timed_out",)] and rows(p.results(report_id="r2"), "value") == [(Dec("2.000000"),)]


@pytest.mark.parametrize(
    "call",
    [
        lambda p: p.register("x", "c", 2024, "ANNUAL"),
        lambda p: p.register("x", "", 2024, "ESG"),
        lambda p: p.register("x", "c", "2024", "ESG"),
        lambda p: p.register("x", "c", 24, "ESG"),
        lambda p: p.create_job("unknown"),
        lambda p: p.results(year="2024"),
        lambda p: p.results(review_status="correct"),
        lambda p: p.results(offset=-1),
        lambda p: p.results(limit=0),
        lambda p: p.results(limit="all"),
        lambda p: p.results(term=""),
        lambda p: p.evidence(""),
        lambda p: p.search(""),
        lambda p: p.trends(""),
        lambda p: p.compare("E01", "2024", "t"),
        lambda p: p.compare("E01", 2024, ""),
    ],
)
def test_abnormal_input(platform, call):
    with pytest.raises(ValueError):
        call(platform)


def test_initialise_and_restore_keep_the_seed(spark, tmp_path):
    report = lambda r: (r, "c1", 2024, "ESG", r, 1, "u", "pass")
    result = lambda r, i: (f"{r}{i}", r, i, Dec(1), None, "t", "disclosed", "auto_verified_high")
    evidence = lambda r, i: (f"e{r}{i}", f"{r}{i}", 1, "f", "rule", Dec("0.9"), [], "auto_verified_high")
    candidate = lambda r, i: (f"k{r}{i}", r, i, "1", "t", Dec(1), "t", "rule", 1, "f", Dec("0.9"))
    pairs = [(r, i) for r in ("r1", "r2") for i in ("E01", "E02")]
    for name, rows_, schema in (
        ("reports", [report("r1"), report("r2")], S.REPORT),
        ("results", [result(*x) for x in pairs], S.RESULT),
        ("evidence", [evidence(*x) for x in pairs], S.EVIDENCE),
        ("candidates", [candidate(*x) for x in pairs], S.CANDIDATE),
        ("reviews", [("r2E01", "rejected", "x", dt.datetime(2024, 1, 1), None)], S.REVIEW),
    ):
        spark.createDataFrame(rows_, schema).write.parquet(str(tmp_path / "seed" / name))
    p = Platform(spark, str(tmp_path / "seed"), str(tmp_path / "run"), spark.createDataFrame(CATALOGUE, S.INDICATOR))

    def state():
        shown = sorted(rows(p.results(), "result_id", "review_status")), p._evidence().count(), p.candidates().count(), p.reports().count()
        assert all(r["ok"] for r in p.health().collect())
        return shown

    before = state()
    assert before[1:] == (4, 4, 2) and ("r2E01", "rejected") in before[0]
    p.initialise()
    assert state() == before
    with pytest.raises(Exception):
        p.initialise()
    assert state() == before
    p.store.append(spark.createDataFrame([("r1", b"%PDF-1\nemissions of 5 t")], S.UPLOAD), "uploads")
    job = p.create_job("r1")
    assert rows(p.job(job), "state") == [("succeeded",)]
    after = state()
    assert after != before and after[1:] == (3, 3, 2)  # one of r1 now, two of r2
    p.restore()
    assert state() == before
    again = p.create_job("r1")
    assert rows(p.job(again), "state") == [("succeeded",)] and state()[1:] == (3, 3, 2)
    p.store.restore("results", S.RESULT)
    assert state() == before


def test_of_several_runners_one_takes_a_job(platform):
    report = platform.reports().where("company_id = 'c1' and report_year = 2023").first()["report_id"]
    job = platform.submit(report)
    own = [Platform(platform.spark, platform.store.seed, platform.store.runtime, platform.catalogue) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda p: p.store.claim("contested"), own * 5))
        assert won.count(True) == 1
        taken = list(pool.map(lambda p: p.run_queued(), own))
    assert sorted(taken) == [[], [], [], [job]]
    events = platform._events().where(F.col("job_id") == job).orderBy("event_id")
    assert rows(events, "event_id", "state") == [(1, "queued"), (2, "running"), (3, "succeeded")]
    with pytest.raises(ValueError):
        platform.run(job)


def test_seed_query_groups_its_items_once(spark, sf_dir, monkeypatch):
    from quillgrid.plans import queries
    from quillgrid.sources.tables import Store

    seen = []
    append = Store.append
    monkeypatch.setattr(Store, "append", lambda self, rows, name, *more: (seen.extend(rows.inputFiles()), append(self, rows, name, *more))[1])
    queries.QUERIES["q55_platform_seed"](spark, sf_dir)
    assert seen and not any("lineitem" in x for x in seen)
