"""Candidates out of text, in layers: rules first, dearer extractors only for slots that are still open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import columns as C


def numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "[0-9]+") -> DataFrame:
    """``id, pos, raw_value``: numbers of each text in order, from 1."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    return docs.select(id_col, F.posexplode(found).alias("pos", "raw_value")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def valued(docs: DataFrame, units: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, raw_value, raw_unit``: the first number that one of the units follows."""
    alternatives = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    pattern = rf"{C.NUMBER} ?({alternatives})([^A-Za-z0-9]|$)"
    hits = docs.where(F.col(text_col).rlike(pattern))
    return hits.select(id_col, F.regexp_extract(text_col, pattern, 1).alias("raw_value"), F.regexp_extract(text_col, pattern, 2).alias("raw_unit"))


#: A catalogue is written by hand; more rows than this are a mistake.
MOST_INDICATORS = 2000


def patterns_of(catalogue: DataFrame) -> list[tuple[str, str]]:
    """(indicator, pattern) in order."""
    known = [(r["indicator_id"], r["pattern"]) for r in catalogue.select("indicator_id", "pattern").where("pattern is not null").orderBy("indicator_id").limit(MOST_INDICATORS + 1).collect()]
    if len(known) > MOST_INDICATORS:
        raise ValueError(f"a catalogue of over {MOST_INDICATORS} indicators")
    return known


def line_hits(lines: DataFrame, known: list[tuple[str, str]], fragment: str = "text") -> DataFrame:
    """``report_id, page, line_no, fragment, indicator_id, hit_no, raw, raw_of``: all hits of each pattern (group 1 the value, group 2 the unit).

    The patterns become constants of one projection; a pattern of all of them leaves out lines that none can hit.
    """
    kind = "array<struct<indicator_id:string,hit_no:int,raw:string,raw_of:string>>"

    def hits(indicator: str, pattern: str) -> Column:
        cut = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "raw"), (2, "unit"))])
        found = F.transform(cut, lambda x, i: F.struct(F.lit(indicator).alias("indicator_id"), i.alias("hit_no"), x["raw"].alias("raw"), x["unit"].alias("raw_of")))
        return F.when(F.col("text").rlike(pattern), found).otherwise(F.array().cast(kind))

    some = F.col("text").rlike("|".join(f"(?:{p})" for _, p in known)) if known else F.lit(False)
    every = F.flatten(F.array(*[hits(*x) for x in known])) if known else F.array().cast(kind)
    return lines.where(some).select("report_id", "page", "line_no", F.col(fragment).alias("fragment"), F.inline(every))


def candidates_of(hits: DataFrame, source_type: str, confidence: str) -> DataFrame:
    raw, unit = F.col("raw"), F.col("raw_of")
    return hits.select(
        F.sha2(F.concat_ws("|", "report_id", "indicator_id", "page", "line_no", "hit_no", F.lit(source_type)), 256).alias("candidate_id"),
        "report_id",
        "indicator_id",
        raw.alias("raw_value"),
        unit.alias("raw_unit"),
        C.parse_number(raw).alias("value"),
        F.lit(None).cast("string").alias("unit"),
        F.lit(source_type).alias("source_type"),
        F.col("page").cast("int").alias("page"),
        "fragment",
        F.lit(confidence).cast("decimal(5,4)").alias("confidence"),
    )


def by_catalogue(lines: DataFrame, catalogue: DataFrame, source_type: str = "rule", confidence: str = "0.9000") -> DataFrame:
    """Candidates of each page line by each indicator's pattern, all hits of a line; ``anchors.by_anchors`` gives the same with less work for large catalogues."""
    return candidates_of(line_hits(lines, patterns_of(catalogue)), source_type, confidence)


def open_slots(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """Slots (``report_id, indicator_id``) without a usable candidate."""
    return slots.join(candidates.where("value is not null").select("report_id", "indicator_id").distinct(), ["report_id", "indicator_id"], "left_anti")


def layered(slots: DataFrame, layers: list[Callable[[DataFrame], DataFrame]], keep: Callable[[DataFrame, int], DataFrame] = lambda found, k: found) -> DataFrame:
    """Candidates of all layers; each layer is called with the slots that those before have left open.

    The open slots are filtered before a layer's extractor: an expression around a Python function would run it on every row.
    ``keep`` stores a layer's candidates and reads them back, so that a dear layer runs once.
    """
    found: DataFrame | None = None
    left = slots
    for k, layer in enumerate(layers):
        own = keep(layer(left), k)
        found = own if found is None else found.unionByName(own)
        left = open_slots(left, own)
    return found


def best(candidates: DataFrame, slot: list[str], priority: dict[str, int], source_col: str, confidence_col: str, ties: list[str]) -> DataFrame:
    """The best candidate of each slot: source priority, then confidence, then the tie columns.

    An aggregation, so that a slot with very many candidates is combined on the map side.
    """
    rank = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    order = F.struct(F.coalesce(rank[F.col(source_col)], F.lit(len(priority))).alias("_p"), (-F.col(confidence_col)).alias("_c"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(ties)])
    others = [c for c in candidates.columns if c not in slot]
    first = F.min_by(F.struct(*others), order).alias("_best")
    return candidates.groupBy(*slot).agg(first).select(*slot, *[F.col(f"_best.{c}") for c in others])
