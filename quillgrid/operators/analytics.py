"""Results, evidence, search, trends, comparison and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import columns as C


def dec(value: Column, places: int = 2) -> Column:
    """Doubles as decimals before they are summed: the sum doesn't depend on the order of rows."""
    return value.cast(f"decimal(18,{places})")


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page under a total order."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    return rows.orderBy(*order).offset(offset).limit(limit)


def search(docs: DataFrame, term: str, id_col: str = "doc_id", text_col: str = "text", before: int = 30, after: int = 30) -> DataFrame:
    """``id, pos, fragment`` of texts that contain the term."""
    if not term:
        raise ValueError("an empty search term")
    hits = docs.where(F.contains(F.col(text_col), F.lit(term)))
    return hits.select(id_col, F.instr(F.col(text_col), term).cast("long").alias("pos"), C.fragment(F.col(text_col), term, before, after).alias("fragment"))


def search_all(parts: list[DataFrame], term: str) -> DataFrame:
    """Rows of all parts (equal columns, one of them ``text``) whose text holds the term."""
    if not term:
        raise ValueError("an empty search term")
    out: DataFrame | None = None
    for part in parts:
        hits = part.where(F.contains("text", F.lit(term)))
        out = hits if out is None else out.unionByName(hits)
    return out


def evidence_chain(results: DataFrame, evidence: DataFrame, key: str, rank: Column, fields: list[str]) -> DataFrame:
    """``results`` with ``chain``: an ordered array of evidence, empty where a result has none."""
    chains = evidence.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), *fields))).alias("chain"))
    return results.join(chains, key, "left").withColumn("n_evidence", F.coalesce(F.size("chain"), F.lit(0)))


def trend(series: DataFrame, keys: list[str], year: str = "year", value: str = "value", least_years: int = 2) -> DataFrame:
    """Comparable series: ``series`` (one row a key and year) of keys with enough years, with changes.

    ``keys`` has the canonical unit, so units never mix. The change is of consecutive rows; ``step`` tells a gap in years. One
    exchange on the keys serves the count and the lags.
    """
    own = Window.partitionBy(*keys)
    ordered = own.orderBy(year)
    before = F.lag(value).over(ordered)
    counted = series.withColumn("n_years", F.count(year).over(own)).withColumn("previous", before).withColumn("step", F.col(year) - F.lag(year).over(ordered))
    kept = counted.where(F.col("n_years") >= least_years)
    return kept.withColumn("change", F.col(value) - F.col("previous"))


def complete_years(reports: DataFrame, company: str, year: str, wanted: list[int], order: list[Column]) -> DataFrame:
    """One report for each company and year, of companies that have all wanted years."""
    inside = reports.where(F.col(year).isin(*wanted))
    others = [c for c in inside.columns if c not in (company, year)]
    one = inside.groupBy(company, year).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_one"))
    counted = one.withColumn("_n", F.count("*").over(Window.partitionBy(company)))
    return counted.where(F.col("_n") == len(wanted)).select(company, year, *[F.col(f"_one.{c}") for c in others])


def compare(values: DataFrame, within: list[str], value: str = "value") -> DataFrame:
    """``values`` with ``rank`` and the set's size: companies in one year and unit.

    A set is ranked in steps of its values (sixteen to each doubling), so that a large one isn't one task: a row's rank is the
    number of rows in higher steps, a small table, and its rank in its own step.
    """
    size = F.log2(F.abs(F.col(value).cast("double")) + 1) * 16
    stepped = values.withColumn("compare_step", F.floor(F.when(F.col(value) < 0, -size).otherwise(size)).cast("long"))
    counts = stepped.groupBy(*within, "compare_step").agg(F.count("*").alias("compare_n"))
    own = Window.partitionBy(*within)
    higher = F.sum("compare_n").over(own.orderBy(F.col("compare_step").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("compare_higher", F.coalesce(higher, F.lit(0))).withColumn("n_compared", F.sum("compare_n").over(own))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*within, "compare_step")]
    joined = stepped.alias("v").join(placed.alias("p"), same).select("v.*", "p.compare_higher", "p.n_compared")
    rank = F.rank().over(Window.partitionBy(*within, "compare_step").orderBy(F.col(value).desc()))
    ranked = joined.withColumn("rank", (rank + F.col("compare_higher")).cast("long"))
    return ranked.select(*[f"`{c}`" for c in values.columns], "rank", "n_compared")


def mixed_units(series: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Keys whose values come in several units."""
    return series.groupBy(*keys).agg(F.countDistinct(unit).alias("n_units")).where("n_units > 1")


def coverage(grid: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over a full grid, zero where nothing was found."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("_n"))
    return grid.join(counts, keys, "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def integrity(checks: dict[str, DataFrame]) -> DataFrame:
    """``check, n_bad, ok``: a row for each check; a check is a DataFrame of bad rows."""
    out: DataFrame | None = None
    for name, bad in checks.items():
        own = bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad", (F.col("n_bad") == 0).alias("ok"))
        out = own if out is None else out.unionByName(own)
    return out
