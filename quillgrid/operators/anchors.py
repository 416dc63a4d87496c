"""Candidates by literal anchors: a pattern is tried only on lines that hold one of its required words.

A pattern's anchors are words of which each of its matches holds one: whole words between word boundaries, or pairs of Han characters. Lines are cut
into words (and Han pairs) once and meet the anchors in a hash join; only the (line, indicator) pairs that meet are searched by the
indicator's pattern. The work follows the lines and their hits and not the size of the catalogue. Patterns without a required word go the
way of ``by_catalogue``, so the rows are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import extract

#: Stands for a place where a word can't go on: a boundary, a line's start or end.
EDGE = "\x00"
#: Alternatives that a pattern may have before it counts as one without anchors.
MOST_FORMS = 64
_HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_WORD = re.compile(rf"(?<![a-z0-9_])[a-z0-9_]+(?![a-z0-9_])|[{_HAN}]{{2}}")


def _forms(items: Iterable) -> list[set[str] | None]:
    """For each element of a parsed pattern its possible strings, None where they are not few and known."""
    from re import _constants as C

    out: list[set[str] | None] = []
    for op, value in items:
        if op is C.LITERAL:
            out.append({chr(value)})
        elif op is C.AT:
            out.append({EDGE})
        elif op is C.SUBPATTERN:
            out += _forms(value[3])
        elif op is C.IN and all(o is C.LITERAL for o, _ in value):
            out.append({chr(v) for _, v in value})
        elif op is C.BRANCH:
            each = [_joined(_forms(x)) for x in value[1]]
            out.append(None if None in each else set().union(*each))
        elif op is C.MAX_REPEAT or op is C.MIN_REPEAT:
            low, high, inner = value
            forms = _joined(_forms(inner))
            if forms and (high == 1 or low > 0 and not any(re.search(rf"[A-Za-z0-9_{_HAN}]", f) for f in forms)):
                out.append(forms if low else forms | {""})  # many spaces part words as one does
            else:
                out.append(None)
        elif op in (C.ASSERT, C.ASSERT_NOT):
            out.append({""})  # says nothing about the words before it
        else:
            out.append(None)
    return out


def _joined(forms: list[set[str] | None]) -> set[str] | None:
    strings = {""}
    for f in forms:
        if f is None or len(strings) * len(f) > MOST_FORMS:
            return None
        strings = {a + b for a in strings for b in f}
    return strings


def required_words(pattern: str) -> list[str]:
    """Words, lower-cased, of which every match of the pattern holds one as a whole word (or pair of Han characters); none if that can't be told."""
    from re import _parser

    try:
        forms = _forms(_parser.parse(pattern))
    except (re.error, OverflowError):
        return []
    # maximal runs of elements whose strings are known; outside of them a word may go on
    best: set[str] = set()
    run: list[set[str]] = []
    for f in [*forms, None]:
        if f is not None:
            run.append(f)
            continue
        strings = _joined(run) if run else None
        words = set()
        for s in strings or ():
            # what stands at the run's ends may be part of a longer word
            inner = [w[0] for w in _WORD.finditer(s.lower()) if w[0][0] > "\u3000" or w.start() > 0 and w.end() < len(s)]
            if not inner:
                words = set()
                break
            words.add(max(inner, key=lambda w: (not w.isdigit(), len(w), w)))
        if words and (not best or (len(words), -min(map(len, words))) < (len(best), -min(map(len, best)))):
            best = words
        run = []
    return sorted(best)


def tokens(text: Column) -> Column:
    """Distinct words, lower-cased, and pairs of Han characters of a line."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit("(?=([\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}]{2}))"), F.lit(1))
    return F.array_distinct(F.concat(words, pairs))


def by_anchors(lines: DataFrame, catalogue: DataFrame, source_type: str = "rule", confidence: str = "0.9000", fragment: str = "text") -> DataFrame:
    """The candidates of ``extract.by_catalogue``, for catalogues of any size up to ``extract.MOST_INDICATORS``.

    ``fragment``: the column that is shown as evidence, if it isn't the text that is searched.
    """
    known = extract.patterns_of(catalogue)
    anchored = [(i, p, words) for i, p in known if (words := required_words(p))]
    loose = [(i, p) for i, p in known if not required_words(p)]
    out = extract.candidates_of(extract.line_hits(lines, loose, fragment), source_type, confidence)
    if not anchored:
        return out
    spark = lines.sparkSession
    table = spark.createDataFrame([(w, i, p, words) for i, p, words in anchored for w in words], "word string, indicator_id string, pattern string, words array<string>")
    cut = lines.select("report_id", "page", "line_no", "text", F.col(fragment).alias("fragment"), tokens(F.col("text")).alias("tokens"))
    worded = cut.select("*", F.explode("tokens").alias("word"))
    # at most MOST_INDICATORS patterns; of several anchors in a line one brings the pair
    first = (F.size("words") == 1) | (F.col("word") == F.array_min(F.array_intersect("tokens", "words")))
    met = worded.join(F.broadcast(table), "word").where(first)
    own = F.arrays_zip(*[F.regexp_extract_all("text", F.col("pattern"), F.lit(k)).alias(n) for k, n in ((1, "raw"), (2, "raw_of"))])
    hits = met.select("report_id", "page", "line_no", "fragment", "indicator_id", F.posexplode(own).alias("hit_no", "hit"))
    return out.unionByName(extract.candidates_of(hits.select("report_id", "page", "line_no", "fragment", "indicator_id", "hit_no", "hit.raw", "hit.raw_of"), source_type, confidence))
