"""Candidates by literal anchors: the same rows as trying every pattern on every line."""

from __future__ import annotations

import random
import re

import pytest

from quillgrid import schemas as S
from quillgrid.catalogue import CHINESE, NAMES, catalogue, rows
from quillgrid.operators import anchors, extract

OTHERS = [
    ("X1", r"(?:^| )the ([a-z]+) (of|and)(?: |$)"),
    ("X2", r"([0-9][0-9,]*) ?([a-z]+)"),
    ("X3", r"(?:^| )(is|was)()(?: |$)"),
    ("X4", r"scope([0-9]*)()"),  # no boundary: no anchor
    ("X5", r"\bscope\b([0-9]?)(.*)"),
    ("X6", r"(排放)(量?)"),
    ("X7", r"\b(?:co2|CH4)\b ?([0-9]+)()"),
]


def lines_of(spark, texts):
    return spark.createDataFrame([("r", 1, n, t) for n, t in enumerate(texts, 1)], "report_id string, page int, line_no int, text string").repartition(3)


def every(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_same_rows_as_every_pattern_on_every_line(spark):
    rng = random.Random(6)
    names = [n for own in NAMES.values() for n in own]
    units = ["t", "kWh", "CNY", "person", "h", "%", "吨", "万千瓦时", "亿元", "人", "小时", "tCO2e", "万吨二氧化碳当量"]
    pick = [lambda: rng.choice(names), lambda: rng.choice(names).upper().replace(" ", "  "), lambda: rng.choice(list(CHINESE.values())).split("|")[0], lambda: f"{rng.randrange(10**6):,}" + rng.choice(["", " "]) + rng.choice(units), lambda: rng.choice(["the", "was", "telescope", "scope", "éscope", "scope1", "排放量", "of", "。", ".", "Co2 5", "CH4"])]
    texts = [" ".join(rng.choice(pick)() for _ in range(rng.randrange(1, 9))) for _ in range(900)] + ["", "用电量为1,200万千瓦时", "员工总数 35 人，女性员工12人", "温室气体排放总量：3.5万吨二氧化碳当量"]
    known = catalogue(spark).unionByName(spark.createDataFrame([(i, "E", "quantitative", None, p) for i, p in OTHERS], S.INDICATOR))
    lines = lines_of(spark, texts)
    found = every(anchors.by_anchors(lines, known))
    assert found == every(extract.by_catalogue(lines, known)) and len(found) > 500
    got = {(r[9], r[2]): (r[3], r[4]) for r in found}
    assert got["用电量为1,200万千瓦时", "E17"] == ("1,200", "万千瓦时") and got["温室气体排放总量：3.5万吨二氧化碳当量", "E04"] == ("3.5", "万吨二氧化碳当量")
    assert every(anchors.by_anchors(lines, known.where("false"))) == []


@pytest.mark.parametrize("pattern, words", [(OTHERS[0][1], ["the"]), (OTHERS[1][1], []), (OTHERS[2][1], ["is", "was"]), (OTHERS[3][1], []), (OTHERS[4][1], ["scope"]), (OTHERS[5][1], ["排放"]), (OTHERS[6][1], ["ch4", "co2"]), (r"\p{IsHan}+", []), (r"(?:a|b|[c-z]) x", []), (r"\ba*b\b", [])])
def test_required_words(pattern, words):
    assert anchors.required_words(pattern) == words


def test_each_indicator_has_anchors():
    for i, _, _, _, pattern in rows():
        assert anchors.required_words(pattern), i
        re.compile(pattern)


def test_one_join_whatever_the_catalogue(spark):
    """The plan of 1,600 indicators has as many nodes as that of 80, and no shuffle."""
    own = catalogue(spark)
    many = own
    for k in range(1, 20):
        many = many.unionByName(own.selectExpr(f"concat(indicator_id, '-{k}') AS indicator_id", "pillar", "kind", "canonical_unit", "pattern"))
    many = spark.createDataFrame(many.collect(), S.INDICATOR)
    lines = lines_of(spark, ["total emissions of 5 tCO2e"])
    plans = [anchors.by_anchors(lines, k)._jdf.queryExecution().optimizedPlan().toString() for k in (own, many)]
    assert plans[0].count("Join") == plans[1].count("Join") == 1 and len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert anchors.by_anchors(lines, many).count() == 20
