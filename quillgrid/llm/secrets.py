"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates of a text are the matches of the base kinds (``assign``, ``access``, ``hex``) and, as
further candidates, ``opaque`` strings: runs of 20 or more letters, digits, ``_`` and ``-`` with a digit, an
upper-case and a lower-case letter, that touch no base match. The value of each candidate is
hashed; over the whole corpus the hash is counted by distinct repositories and distinct owners. A value of
``COPIED_OWNERS`` or more owners, or of ``COPIED_REPOSITORIES`` or more repositories, is a widely copied example; one of fewer that looks live
(eight different characters or more and no word such as "example") is an owner-specific
credential. Base matches always stay; an opaque string is added only if it is such a credential.

Positions: a pattern cuts the text into the pieces between its matches, so running sums of the lengths
of pieces and matches give the start of each match in code points. Texts over ``PART`` characters are first
cut where no match can go on: behind a character that no pattern has, or behind a space after one that nothing goes on
from. So the work grows with the text and not with the square of its matches, but where a text has no such place.

Scale: texts are read once and leave only spans and hashes behind; hashes are counted in two
aggregations that combine on the map side (by hash and owner, then by hash), so a value that a
third of the corpus holds costs each task one row; the verdicts go back by joins on the hash, those of
values in ``HOT_REPOSITORIES`` or more by a broadcast (by their least size such values are few).

Defined results: a null text is empty and has no spans; a null owner counts as one owner; repeated
doc_ids and null doc_ids are rows of their own; an empty table gives no rows; columns other than
the named ones are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import table, written

# The patterns of the base kinds, letters of the words in either case.
WORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = f"({WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9_-]{20,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "opaque")

#: From so many distinct owners on a value is a copied example.
COPIED_OWNERS = 3
#: So is one of so many distinct repositories.
COPIED_REPOSITORIES = 50
#: Values of so many repositories have their verdicts broadcast, up to BROADCAST_VALUES of them.
HOT_REPOSITORIES, BROADCAST_VALUES = 10_000, 500_000
#: Up to so many texts with spans are told by broadcast keys.
BROADCAST_KEYS = 1_000_000
#: Characters of a part of a long text at least.
PART = 2000
#: A part ends behind one of these. No match has the first; a match that goes on behind a space has a keyword's end, a quote or a sign before it.
CUT = "(?:[^A-Za-z0-9+/_.=\"':\\x20-]|[^dDtTnNyY\"':=\\x20]\\x20)"
#: A live-looking value has so many different characters.
LEAST_CHARACTERS = 8
EXAMPLE_WORDS = "example|sample|dummy|changeme|placeholder|your|test|xxxx"

SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
GAPS = "array<struct<at:int,start:int>>"
#: Characters of the chunks that a text is cut in to mark its spans.
CHUNK = 1024


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of all matches, in order; ``group`` is the value's."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.split(text, pattern, -1).alias("piece"), matches.alias("match")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    cut = F.arrays_zip(*parts)
    none = F.lit(None).cast(SPANS)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value" if group else "match"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    found = F.aggregate(cut, begin, step, lambda s: s["out"])
    return F.coalesce(F.when(text.rlike(pattern), found).otherwise(none), F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, group=2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    # the longest run of a class is the match, so a least length is the same as a filter after it
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def opaque_spans(text: Column, base: Column) -> Column:
    """Opaque strings that touch no base span."""
    # the look-behind only saves tries inside a run
    runs = _spans(text, "(?<![A-Za-z0-9_-])" + OPAQUE, 3)
    mixed = F.filter(runs, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    return F.filter(mixed, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def parts(text: Column) -> Column:
    """``at, part`` of a text cut where no match goes on; a short text is one part."""
    cut = F.when(F.length(text) <= PART, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{{PART}}}.*?{CUT}|.+"), F.lit(0)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,part:string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        return F.struct((state["at"] + F.length(part)).alias("at"), F.concat(state["out"], F.array(F.struct(state["at"].alias("at"), part.alias("part")))).alias("out"))

    return F.aggregate(cut, begin, step, lambda s: s["out"])


def _moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """``row, doc_id, owner, repository, base, opaque``: a row for each row of ``docs``, without its text."""
    row = F.monotonically_increasing_id()
    source = docs.select(
        row.alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
        (F.col(f"`{repository_col}`").cast("string") if repository_col else F.lit(None).cast("string")).alias("repository"),
        parts(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("parts"),
    )
    based = source.withColumn("parts", F.transform("parts", lambda p: F.struct(p["at"].alias("at"), p["part"].alias("part"), base_spans(p["part"]).alias("base"))))
    return based.select(
        "row",
        "doc_id",
        "owner",
        F.coalesce("repository", F.concat_ws(":", F.lit("row"), "row")).alias("repository"),
        F.flatten(F.transform("parts", lambda p: _moved(p["base"], p["at"]))).alias("base"),
        F.flatten(F.transform("parts", lambda p: _moved(opaque_spans(p["part"], p["base"]), p["at"]))).alias("opaque"),
    )


def looks_live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS) & ~F.lower(value).rlike(EXAMPLE_WORDS)


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """``hash, n_repositories, n_owners, verdict`` of each candidate value: copied, live or weak."""
    values = found.select("owner", "repository", F.explode(F.array_distinct(F.transform(F.concat("base", "opaque"), lambda s: s["value"]))).alias("value"))
    hashed = values.select("owner", "repository", F.sha2("value", 256).alias("hash"), looks_live(F.col("value")).alias("live"))
    by_repository = hashed.groupBy("hash", "owner", "repository").agg(F.first("live").alias("live"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.first("live").alias("live"))
    counted = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.first("live").alias("live"))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    verdict = F.when(copied, "copied").when(F.col("live"), "live").otherwise("weak")
    return counted.select("hash", "n_repositories", "n_owners", verdict.alias("verdict"))


def _hot(verdicts: DataFrame, hot_repositories: int) -> DataFrame:
    """Verdicts of the values that most repositories hold, marked for broadcast while they are few."""
    hot = verdicts.where(F.col("n_repositories") >= hot_repositories)
    return F.broadcast(hot) if hot.count() <= BROADCAST_VALUES else hot


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, hot_repositories: int = HOT_REPOSITORIES) -> DataFrame:
    """``doc_id, base, added, n_live, n_copied, max_repositories, max_owners``: spans (with values) of each row of ``docs``.

    The last two are the largest counts of a row's values, zero where it has none.
    Without a repository column each row is a repository of its own.
    """
    found = written(candidates(docs, id_col, text_col, owner_col, repository_col), "secrets")
    verdicts = written(ownership(found, copied_owners, copied_repositories), "verdicts")
    spans = found.select("row", F.explode(F.concat("base", "opaque")).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    hot = _hot(verdicts, hot_repositories)
    cold = verdicts.where(F.col("n_repositories") < hot_repositories)
    judged = spans.join(hot, "hash").unionByName(spans.join(hot.select("hash"), "hash", "left_anti").join(cold, "hash"))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("span.kind") == 3) & (F.col("verdict") == "live"), F.col("span"))).alias("added"),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "copied", 1)).alias("n_copied"),
        F.max("n_repositories").alias("max_repositories"),
        F.max("n_owners").alias("max_owners"),
    )
    none = F.array().cast(SPANS)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "max_repositories", "max_owners")]
    return found.join(by_row, "row", "left").select("row", "doc_id", "base", F.array_sort(F.coalesce("added", none)).alias("added"), *counts)


def named(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def gaps(spans: DataFrame, key: str) -> DataFrame:
    """``key, gaps``: what stays of each text, in order: from the end of all spans before (``at``) to the next one (``start``, null: the text's end).

    A span that starts within an earlier one adds no gap of its own.
    """
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    inner = F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("at"), F.struct("at", "start"))))
    tail = F.array(F.struct(F.max("end").alias("at"), F.lit(None).cast("int").alias("start")))
    return placed.groupBy(key).agg(F.concat(inner, tail).cast(GAPS).alias("gaps"))


def marked(text: Column, left: Column, mark: str) -> Column:
    """The gaps of a text with ``mark`` between them.

    The text is cut once in chunks of equal length, so a gap costs its own length and not its distance from the text's start.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def piece(own: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        chunk = lambda i: F.coalesce(F.get(own, i), F.lit(""))
        between = F.array_join(F.slice(own, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        whole = F.concat(chunk(first).substr(a % CHUNK + 1, F.lit(CHUNK)), between, chunk(last).substr(F.lit(1), b % CHUNK))
        return F.when(first == last, chunk(first).substr(a % CHUNK + 1, b - a)).otherwise(whole)

    # bound once: a lambda's body would cut the text anew for each gap
    both = F.array(F.struct(chunks.alias("chunks"), left.alias("gaps"), F.length(text).alias("n")))
    return F.transform(both, lambda x: F.array_join(F.transform(x["gaps"], lambda g: piece(x["chunks"], g["at"], F.coalesce(g["start"], x["n"]))), mark))[0]


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, base and added, replaced by ``mark``; texts without one stay as they are.

    Spans are found once for each row and go back to the texts by a hash of the text, as equal
    texts have equal spans.
    """
    text, spare = F.col(f"`{text_col}`"), "quillgrid_" + "_".join(sorted(docs.columns))
    key = F.xxhash64(text)
    found = written(candidates(docs.select(key.alias("i"), text.alias("t"), F.col(f"`{owner_col}`").alias("o")), "i", "t", "o"), "secrets")
    verdicts = written(ownership(found), "verdicts")
    # values that very many hold are copied, never live
    opaque = found.select("doc_id", F.explode("opaque").alias("span")).distinct().withColumn("hash", F.sha2("span.value", 256))
    opaque = opaque.join(_hot(verdicts, HOT_REPOSITORIES).select("hash"), "hash", "left_anti")
    added = opaque.join(verdicts.where("verdict = 'live'").select("hash"), "hash", "left_semi").groupBy("doc_id").agg(F.collect_list("span").alias("added"))
    based = found.where(F.size("base") > 0).groupBy("doc_id").agg(F.first("base").alias("base"))
    each = based.select("doc_id", F.explode("base").alias("span")).unionByName(added.select("doc_id", F.explode("added").alias("span")))
    spans = written(gaps(each.select("doc_id", "span.start", "span.end"), "doc_id").toDF(spare, spare + "s"), "spans")
    if spans.count() <= BROADCAST_KEYS:
        # texts without a span stay where they are
        keys = F.broadcast(spans.select(F.col(f"`{spare}`")))
        met = docs.join(keys, key == F.col(f"`{spare}`"), "left_semi").join(spans, key == F.col(f"`{spare}`"))
        rest = docs.join(keys, key == F.col(f"`{spare}`"), "left_anti").withColumns({spare: F.lit(None).cast("long"), spare + "s": F.lit(None).cast(GAPS)})
        joined = met.unionByName(rest)
    else:
        joined = docs.join(spans, key == F.col(f"`{spare}`"), "left")
    new = F.when(F.col(f"`{spare}s`").isNull(), text).otherwise(marked(text, F.col(f"`{spare}s`"), mark))
    return joined.select(*[(new if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``; a document's source is its owner."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
        "max_repositories",
        "max_owners",
    )


def _sql_spans(pattern: str, kind: int, value: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""(SELECT list({{'start': s, 'kind': {kind}, 'end': s + length(m), 'value': v}} ORDER BY s)
      FROM (SELECT m[i] AS m, v[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
        FROM (SELECT regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {value}) AS v, string_split_regex(t, '{quoted}') AS p), unnest(range(1, len(m) + 1)) AS u(i)))"""


def oracle_sql() -> str:
    """The same in DuckDB's SQL; its patterns have no look-behind, which only saved time."""
    kinds = "['assign', 'access', 'hex', 'opaque']"
    name = f"lambda x: {kinds}[x.kind + 1] || ':' || x.start::BIGINT || ':' || x.\"end\"::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
b AS (SELECT r, doc_id, owner, t, coalesce(list_filter({_sql_spans(ASSIGN, 0, '2')}, lambda x: length(x.value) >= {LEAST_VALUE}), []) AS a,
      coalesce({_sql_spans(ACCESS, 1, '0')}, []) AS k, coalesce({_sql_spans(HEX, 2, '0')}, []) AS h FROM d),
s AS (SELECT r, doc_id, owner, t, list_sort(a || k || h) AS base, len(a) AS n_assign, len(k) AS n_access, len(h) AS n_hex FROM b),
o AS (SELECT r, doc_id, owner, base, n_assign, n_access, n_hex,
      list_filter(coalesce({_sql_spans(OPAQUE, 3, '0')}, []), lambda x: regexp_matches(x.value, '[0-9]') AND regexp_matches(x.value, '[A-Z]') AND regexp_matches(x.value, '[a-z]')
        AND len(list_filter(base, lambda y: y.start < x."end" AND x.start < y."end")) = 0) AS opaque FROM s),
v AS (SELECT r, owner, unnest(base || opaque) AS x FROM o),
c AS (SELECT x.value AS value, count(DISTINCT r) AS n_repositories, count(DISTINCT owner) AS n_owners, CASE WHEN count(DISTINCT owner) >= {COPIED_OWNERS} OR count(DISTINCT r) >= {COPIED_REPOSITORIES} THEN 'copied'
      WHEN len(list_distinct(string_split(x.value, ''))) >= {LEAST_CHARACTERS} AND NOT regexp_matches(lower(x.value), '{EXAMPLE_WORDS}') THEN 'live' ELSE 'weak' END AS verdict
      FROM v GROUP BY x.value),
j AS (SELECT r, list(x) FILTER (x.kind = 3 AND verdict = 'live') AS added, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied, max(n_repositories) AS max_repositories, max(n_owners) AS max_owners
      FROM v JOIN c ON c.value = v.x.value GROUP BY r)
SELECT doc_id, n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex,
  sha256(array_to_string(list_transform(base, {name}), ',')) AS base_sha256,
  array_to_string(list_transform(list_sort(base || coalesce(added, [])), {name}), ',') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied,
  coalesce(max_repositories, 0)::BIGINT AS max_repositories, coalesce(max_owners, 0)::BIGINT AS max_owners
FROM o LEFT JOIN j USING (r)"""
