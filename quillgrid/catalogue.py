"""The indicator catalogue: eighty indicators of our own, environmental, social and governance, with their text patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.functions.units import UNITS
from quillgrid.schemas import INDICATOR

# What each indicator is called, by pillar and canonical unit (none: qualitative).
NAMES = {
    ("E", "tCO2e"): ["scope 1 emissions", "scope 2 emissions", "scope 3 emissions", "total emissions", "emission reduction", "carbon offsets"],
    ("E", "t"): ["nitrogen oxide emissions", "sulphur dioxide emissions", "particulate emissions", "hazardous waste", "non-hazardous waste", "recycled waste", "packaging material", "plastic use", "paper use", "wastewater pollutants"],
    ("E", "kWh"): ["electricity consumption", "renewable electricity", "purchased electricity", "solar generation"],
    ("E", "GJ"): ["total energy consumption", "natural gas consumption", "heat consumption"],
    ("E", "m3"): ["water consumption", "water withdrawal", "recycled water", "wastewater discharge"],
    ("E", "CNY"): ["environmental investment", "environmental fines"],
    ("E", "%"): ["renewable energy share", "waste recycling rate"],
    ("E", None): ["climate risk assessment", "environmental policy", "biodiversity protection", "net zero target", "environmental management system", "green product design"],
    ("S", "person"): ["total employees", "female employees", "new employees", "employees with disabilities", "volunteers", "work injuries", "work fatalities", "trained employees"],
    ("S", "h"): ["training hours", "volunteer hours", "lost working hours", "safety training hours"],
    ("S", "%"): ["employee turnover rate", "female share", "training coverage", "contract signing rate", "customer satisfaction", "social insurance coverage"],
    ("S", "CNY"): ["charitable donations", "safety investment", "research expenditure", "rural revitalisation investment"],
    ("S", None): ["human rights policy", "supplier code of conduct", "occupational health policy", "data privacy policy", "product recall procedure", "complaint procedure"],
    ("G", "person"): ["board members", "independent directors", "female directors"],
    ("G", "%"): ["board attendance rate", "anti-corruption training coverage", "independent director share"],
    ("G", "CNY"): ["total tax paid", "compliance fines"],
    ("G", None): ["board diversity policy", "anti-corruption policy", "whistleblower protection", "risk management system", "internal audit", "remuneration policy", "sustainability committee"],
}


# What reports in Chinese call some of them.
CHINESE = {
    "scope 1 emissions": "范围一排放量|范围1排放量|直接温室气体排放",
    "scope 2 emissions": "范围二排放量|范围2排放量|间接温室气体排放",
    "total emissions": "温室气体排放总量",
    "nitrogen oxide emissions": "氮氧化物排放量",
    "sulphur dioxide emissions": "二氧化硫排放量",
    "hazardous waste": "危险废物",
    "electricity consumption": "用电量|耗电量|电力消耗",
    "total energy consumption": "综合能耗|能源消耗总量",
    "water consumption": "用水量|耗水量",
    "environmental investment": "环保投入|环境保护投入",
    "total employees": "员工总数|在职员工",
    "female employees": "女性员工",
    "training hours": "培训时长|培训总时长",
    "charitable donations": "公益捐赠|对外捐赠",
    "research expenditure": "研发投入",
    "board members": "董事会成员",
    "independent directors": "独立董事",
    "climate risk assessment": "气候风险评估",
    "whistleblower protection": "举报人保护",
}


def pattern(name: str, unit: str | None) -> str:
    """A name, English or Chinese, and, for quantities, the number and unit that follow in the same sentence; group 1 the value, group 2 the unit."""
    words = name.replace("-", "[- ]").replace(" ", " +")
    chinese = f"|{CHINESE[name]}" if name in CHINESE else ""
    if unit is None:
        return rf"(?i)(\b{words}\b{chinese})()"
    raw = "|".join(sorted((x for x, canonical, _ in UNITS if canonical == unit), key=lambda x: (-len(x), x)))
    return rf"(?i:\b{words}\b{chinese})[^0-9.。\n]{{0,60}}([0-9][0-9,]*(?:\.[0-9]+)?) ?({raw})(?![A-Za-z0-9])"


def rows() -> list[tuple[str, str, str, str | None, str]]:
    """``indicator_id, pillar, kind, canonical_unit, pattern``."""
    out, counts = [], {"E": 0, "S": 0, "G": 0}
    for (pillar, unit), names in NAMES.items():
        for name in names:
            counts[pillar] += 1
            out.append((f"{pillar}{counts[pillar]:02d}", pillar, "qualitative" if unit is None else "quantitative", unit, pattern(name, unit)))
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), INDICATOR)
