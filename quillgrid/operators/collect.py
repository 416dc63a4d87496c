"""The collector's plan: manifest checks, allow-list, robots rules and the pace of requests.

``plan`` only returns a DataFrame; ``execute`` copies what it allows from a local mirror of the addresses, as
fetching is another program's task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import columns as C
from quillgrid.operators.files import failed_rules
from quillgrid.schemas import REPORT_TYPES
from quillgrid.sources.tables import scratch


def robots_verdict(urls: DataFrame, rules: DataFrame, url_col: str = "url", agent: str = "*") -> DataFrame:
    """``urls`` with ``robots_allowed``: the longest rule that matches the path decides, allow before disallow.

    ``rules``: ``host, prefix, allow`` and, if there are any, ``agent``: a host's rules for ``agent`` stand for its rules for all (``*``).
    In a prefix ``*`` stands for any characters and a ``$`` at its end for the end of the path. A path is cut at the lengths that its host's
    rules have (of a rule with wild cards the literal head counts), and each cut meets its rules by host and text, so an address
    costs the number of lengths and not that of the host's rules.
    """
    keyed = urls.select(F.col(url_col).alias("robots_url")).distinct().select("robots_url", C.host(F.col("robots_url")).alias("robots_host"), C.url_path(F.col("robots_url")).alias("robots_path"))
    whose = F.lower(F.coalesce("agent", F.lit("*"))) if "agent" in rules.columns else F.lit("*")
    own = rules.select(F.lower("host").alias("robots_host"), "prefix", "allow", whose.alias("of_agent")).where(F.col("of_agent").isin("*", agent.lower()) & (F.length("prefix") > 0))
    ends = F.col("prefix").endswith("$")
    body = F.when(ends, F.regexp_replace("prefix", r"\$$", "")).otherwise(F.col("prefix"))
    quoted = F.regexp_replace(F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*", ".*")
    own = own.withColumn("rule", F.concat(F.lit("(?s)^"), quoted, F.when(ends, "$").otherwise("")))
    named = own.where(F.col("of_agent") != "*").select("robots_host").distinct()
    own = own.where(F.col("of_agent") != "*").unionByName(own.where(F.col("of_agent") == "*").join(named, "robots_host", "left_anti").select(own.columns))
    own = own.withColumn("head", F.regexp_extract(body, r"(?s)^([^*]*)", 1))
    # one row a host; lengths are those of paths
    lengths = own.groupBy("robots_host").agg(F.collect_set(F.length("head")).alias("lengths"))
    fits = F.filter("lengths", lambda n: n <= F.length("robots_path"))
    cut = keyed.join(lengths, "robots_host").select("robots_url", "robots_host", "robots_path", F.explode(fits).alias("n"))
    cut = cut.select("robots_url", "robots_host", "robots_path", F.substring("robots_path", F.lit(1), F.col("n")).alias("head"))
    plain = ~F.col("prefix").rlike(r"[*]|\$$")
    met = cut.join(own, ["robots_host", "head"]).where(plain | F.rlike("robots_path", F.col("rule")))
    verdict = met.groupBy("robots_url").agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("allow").alias("allow"))).alias("robots_best"))
    joined = urls.join(verdict, F.col(url_col) == F.col("robots_url"), "left").withColumn("robots_allowed", F.coalesce(F.col("robots_best.allow"), F.lit(True)))
    return joined.drop("robots_best", "robots_url")


def paced(urls: DataFrame, delay_seconds: float, url_col: str = "url") -> DataFrame:
    """``slot`` (0, 1, ... for each host) and ``not_before_seconds``: requests to a host keep their distance."""
    spark, order = urls.sparkSession, ["host", url_col, "tie"]
    own = urls.withColumn("host", C.host(F.col(url_col))).withColumn("tie", F.monotonically_increasing_id())
    # a host of very many addresses lies in several ranges; a table keeps the ranges as they were cut
    path = scratch(spark, "paced")
    own.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    # counts of the ranges before, a row for each host in each range
    counts = dealt.groupBy("part", "host").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("part").alias("of_part"), F.col("host").alias("of_host"), "before")
    within = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part", "host").orderBy(*order)))
    met = within.join(before, (F.col("part") == F.col("of_part")) & F.col("host").eqNullSafe(F.col("of_host")))
    slot = (F.col("before") + F.col("nth") - 1).cast("long")
    columns = [F.col(f"`{c}`") for c in urls.columns if c != "host"]
    return met.select(*columns, "host", slot.alias("slot"), (slot * F.lit(float(delay_seconds))).alias("not_before_seconds"))


def plan(manifest: DataFrame, domains: Iterable[str]) -> DataFrame:
    """``manifest`` with ``failed`` (names of broken rules) and ``planned``."""
    url = F.col("url")
    rules = {
        "url": url.isNotNull() & C.host(url).isNotNull(),
        "https": C.is_https(url),
        "domain": C.host_allowed(url, list(domains)),
        "company_id": F.col("company_id").isNotNull() & (F.trim("company_id") != ""),
        "report_year": F.col("report_year").between(1900, 2200),
        "report_type": F.col("report_type").isin(*REPORT_TYPES),
    }
    if "_bad" in manifest.columns:
        rules["row"] = F.col("_bad").isNull()
    return manifest.withColumn("failed", failed_rules(rules)).withColumn("planned", F.size("failed") == 0)


def execute(planned: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """Report files of planned rows that pass the checks and aren't known yet; ``files``: ``url, length, content``."""
    from quillgrid.schemas import UPLOAD_LIMIT

    got = planned.where("planned").join(files, "url").withColumn("file_sha256", C.sha256(F.col("content")))
    good = got.where(C.has_pdf_header(F.col("content")) & (F.col("length") <= UPLOAD_LIMIT))
    return good.dropDuplicates(["file_sha256"]).join(known.select("file_sha256"), "file_sha256", "left_anti")
