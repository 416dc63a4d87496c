"""Pages read from their pictures inside a job, uploads by hash, and the inventory by year."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgrid import schemas as S
from quillgrid.platform import Platform

CATALOGUE = [("E01", "E", "quantitative", "t", r"emissions of ([0-9][0-9,.]*) ?(kt|t)\b"), ("E02", "E", "quantitative", "kWh", r"power of ([0-9][0-9,.]*) ?(MWh|kWh)\b")]


def test_pictures_in_a_job(spark, tmp_path):
    seen, picture = str(tmp_path / "seen"), b"In 2024 a scan of\npower of 5 MWh\nemissions of 2 kt"

    def images(content: bytes):
        # the second page is a picture of text; the first has a picture too, but enough text
        return [b"power of 9 MWh", picture, None]

    def engine(image: bytes) -> str:
        with open(seen, "a") as f:
            f.write(f"{len(image)}\n")
        return image.decode()

    p = Platform(spark, str(tmp_path / "seed"), str(tmp_path / "run"), spark.createDataFrame(CATALOGUE, S.INDICATOR), images=images, engine=engine)
    text = "In 2024 emissions of 7 kt were counted by all of the plants of the company."
    for name, body in (("a.pdf", f"{text}\f \f"), ("b.pdf", f"{text} Again.\f")):
        (tmp_path / name).write_text(f"%PDF-1.4\n{body}\n", "utf-8")
        report = p.register(str(tmp_path / name), name, 2024, "ESG").first()["report_id"]
        assert p.job(p.create_job(report)).first()["state"] == "succeeded"
        got = {r["indicator_id"]: (r["value"], r["disclosure_status"]) for r in p._plain_results().where(F.col("report_id") == report).collect()}
        # the slot that the text fills stays the text's; the open one comes from the picture
        assert got == {"E01": (7000, "disclosed"), "E02": (5000, "disclosed")}
        kinds = {r["indicator_id"]: (r["source_type"], r["page"]) for r in p.candidates().where(F.col("report_id") == report).collect()}
        assert kinds == {"E01": ("rule", 1), "E02": ("ocr", 2)}
    # one picture in both reports, read once
    assert open(seen).read().split() == [str(len(picture))]
    assert [tuple(r) for r in p.inventory().collect()] == [(2024, 2, 2)]
    assert all(r["ok"] for r in p.health().collect())
    plan = p._content("ab" + "0" * 62)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan
    p.compact()
    assert p._plain_results().where("value IS NOT NULL").count() == 4


def test_engine_without_images(spark, tmp_path):
    with pytest.raises(ValueError, match="go together"):
        Platform(spark, str(tmp_path), str(tmp_path / "run"), engine=lambda image: "")
