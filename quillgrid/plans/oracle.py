"""DuckDB SQL for every registered report query."""

from __future__ import annotations

from quillgrid.catalogue import rows as catalogue_rows

#: Terms that can't overlap themselves, so that counting by replacement gives the same.
SEARCH_TERMS = ("the ", "er", "ción", "é", "n de ", "#")

YEAR = "year(o_orderdate)::BIGINT"
TYPE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ESG' WHEN '2' THEN 'SD' WHEN '3' THEN 'CSR' WHEN '4' THEN 'ENV' WHEN '5' THEN 'OTHER' END"
REPORTS = f"""reports AS (SELECT o_orderkey AS report_id, o_custkey AS company_id, {YEAR} AS report_year, {TYPE} AS report_type,
  o_orderstatus AS status, o_totalprice::DECIMAL(18,2) AS value, o_orderdate FROM orders)"""
VALUES = f"""{REPORTS}, vals AS (SELECT report_id, company_id, report_year AS year, p_type AS indicator, l_linestatus AS unit, l_quantity::DECIMAL(18,2) AS value
  FROM lineitem JOIN reports ON l_orderkey = report_id JOIN part ON l_partkey = p_partkey)"""
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
FAILED = """list_filter([CASE WHEN value BETWEEN 1000 AND 400000 THEN NULL ELSE 'value' END, CASE WHEN report_year BETWEEN 1996 AND 2001 THEN NULL ELSE 'year' END,
  CASE WHEN status IN ('F', 'O', 'P') THEN NULL ELSE 'status' END, CASE WHEN report_type IS NOT NULL THEN NULL ELSE 'type' END], lambda x: x IS NOT NULL)"""
NAMED = f"""named AS (SELECT o_orderkey AS report_id, l_linenumber::BIGINT AS line, l_partkey AS part, l_suppkey AS supplier, c_name AS company, n_name AS nation, r_name AS region,
  {TYPE} AS report_type, p_type AS indicator, l_linestatus AS unit, l_quantity AS value, {YEAR} AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
NAMED_COLUMNS = "report_id, line, part, supplier, company, nation, region, report_type, indicator, unit, value"
STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' END"
JOBS = f"jobs AS (SELECT user_id AS job_id, event_id, {STATE} AS state, ts, props FROM events)"

HTML = "html"
for _pattern in ("(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", "(?s)<!--.*?-->", "<[^>]*>"):
    HTML = f"regexp_replace({HTML}, '{_pattern}', ' ', 'g')"
for _entity, _mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_entity}', '{_mark}')"
HTML = f"trim(regexp_replace({HTML}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"

ORACLE_SQL: dict[str, str] = {
    "q01_summary": """
SELECT entity, n FROM (SELECT count(*) AS reports, count(DISTINCT o_custkey) AS reporting_companies, count(DISTINCT year(o_orderdate)) AS years,
  (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM lineitem) AS results FROM orders)
UNPIVOT (n FOR entity IN (reports, reporting_companies, years, companies, results))""",
    "q02_admission": f"WITH {REPORTS} SELECT CASE WHEN len({FAILED}) = 0 THEN 'pass' ELSE 'review' END AS decision, count(*) AS n FROM reports GROUP BY 1",
    "q02b_admission_rules": f"WITH {REPORTS} SELECT array_to_string({FAILED}, '+') AS failed_rules, count(*) AS n FROM reports GROUP BY 1",
    "q03_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS file_sha256 FROM documents GROUP BY 2",
    "q04_repeated": "SELECT sha256(text) AS file_sha256, count(*) AS n_files, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q05_incremental": """
WITH d AS (SELECT doc_id, source, sha256(text) AS file_sha256 FROM documents)
SELECT doc_id, source, file_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY file_sha256 ORDER BY doc_id) AS r FROM d WHERE source <> 'src0')
WHERE r = 1 AND file_sha256 NOT IN (SELECT file_sha256 FROM d WHERE source = 'src0')""",
    "q06_results": f"WITH {NAMED} SELECT {NAMED_COLUMNS} FROM named WHERE y = 1997 AND report_type = 'ESG' AND indicator = 'ECONOMY' AND unit = 'O'",
    "q07_result_page": f"WITH {NAMED} SELECT {NAMED_COLUMNS} FROM named WHERE y = 1998 ORDER BY value DESC, report_id, line, part, supplier, company LIMIT 25 OFFSET 50",
    "q08_evidence": "SELECT doc_id, source, quality::BIGINT AS quality, toxic::BIGINT AS toxic, quality IS NOT NULL AS has_evidence FROM documents LEFT JOIN labels USING (doc_id)",
    "q09_search": """
SELECT doc_id, p AS pos, substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1) + 4 + 30) AS fragment
FROM (SELECT doc_id, text, strpos(text, 'that')::BIGINT AS p FROM documents) WHERE p > 0""",
    "q10_best_candidate": """
SELECT l_orderkey AS report_id, l_linenumber::BIGINT AS line, l_returnflag AS source_type, l_discount AS confidence, l_quantity AS value
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_discount DESC, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem)
WHERE r = 1""",
    "q11_trend": f"""
WITH {VALUES}, y AS (SELECT company_id, indicator, unit, year, sum(value) AS value, count(*) AS n_results FROM vals GROUP BY ALL),
t AS (SELECT *, count(*) OVER k AS n_years, lag(value) OVER (k ORDER BY year) AS previous, year - lag(year) OVER (k ORDER BY year) AS step FROM y WINDOW k AS (PARTITION BY company_id, indicator, unit))
SELECT company_id, indicator, unit, year, value::DOUBLE AS value, previous::DOUBLE AS previous, (value - previous)::DOUBLE AS change, n_results, n_years, step FROM t WHERE n_years >= 2""",
    "q12_trend_gaps": f"""
WITH {REPORTS}, y AS (SELECT company_id, report_year AS year, sum(value) AS value FROM reports GROUP BY ALL),
t AS (SELECT *, count(*) OVER k AS n_years, lag(value) OVER (k ORDER BY year) AS previous, year - lag(year) OVER (k ORDER BY year) AS step FROM y WINDOW k AS (PARTITION BY company_id))
SELECT company_id, year, value::DOUBLE AS value, CASE WHEN step = 1 THEN (value - previous)::DOUBLE END AS change, coalesce(step > 1, false) AS after_gap,
  CASE WHEN step = 1 THEN floor((value - previous)::DOUBLE / previous::DOUBLE * 10000) / 10000 END AS relative_change FROM t WHERE n_years >= 2""",
    "q13_three_years": f"""
WITH {REPORTS}, one AS (SELECT *, row_number() OVER (PARTITION BY company_id, report_year ORDER BY o_orderdate, report_id) AS r FROM reports WHERE report_year IN (1998, 1999, 2000)),
k AS (SELECT *, count(*) OVER (PARTITION BY company_id) AS n FROM one WHERE r = 1)
SELECT company_id, report_year, report_id FROM k WHERE n = 3""",
    "q14_compare": f"""
WITH {REPORTS}, y AS (SELECT report_year, status AS unit, company_id, sum(value) AS value FROM reports GROUP BY ALL)
SELECT report_year, unit, company_id, value::DOUBLE AS value, rank() OVER (PARTITION BY report_year, unit ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY report_year, unit) AS n_compared FROM y""",
    "q15_matrix": f"WITH {REPORTS} SELECT report_year, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'P') AS n_p FROM reports GROUP BY 1",
    "q16_mixed_units": f"WITH {VALUES} SELECT company_id, indicator, count(DISTINCT unit) AS n_units FROM vals GROUP BY ALL HAVING count(DISTINCT unit) > 1",
    "q17_coverage": f"""
WITH {REPORTS}, g AS (SELECT * FROM (SELECT DISTINCT report_year FROM reports), (SELECT unnest(['ESG', 'SD', 'CSR', 'ENV', 'OTHER', 'NEW']) AS report_type))
SELECT g.report_year, g.report_type, count(report_id) AS n FROM g LEFT JOIN reports USING (report_year, report_type) GROUP BY ALL""",
    "q18_indicator_counts": """
SELECT coalesce(l_returnflag, 'all') AS source_type, coalesce(l_linestatus, 'all') AS unit, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value,
  (grouping(l_returnflag) + grouping(l_linestatus))::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "q19_candidates": "SELECT doc_id, unnest(range(1, len(f) + 1)) AS pos, unnest(f) AS raw_value FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS f FROM documents)",
    "q20_value_unit": """
SELECT doc_id, regexp_extract(text, p, 2) AS raw_unit, try_cast(replace(regexp_extract(text, p, 1), ',', '') AS DECIMAL(28,6))::DOUBLE AS value
FROM (SELECT doc_id, text, '([0-9][0-9,]*(?:\\.[0-9]+)?) ?(and|the|de|en|in|of)([^A-Za-z0-9]|$)' AS p FROM documents) WHERE regexp_matches(text, p)""",
    "q21_routing": """
SELECT CASE WHEN length(trim(text, ' ')) < 50 THEN 'ocr' WHEN regexp_matches(text, '[0-9]') THEN 'rule' WHEN contains(text, ' | ') THEN 'table' ELSE 'model' END AS layer, count(*) AS n FROM documents GROUP BY 1""",
    "q22_lines": """
SELECT doc_id, i AS line_no, length(t) AS n_chars, md5(t) AS line_md5 FROM (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE trim(t, ' ') <> ''""",
    "q23_collection_plan": f"""
WITH p AS (SELECT page_id, url, {HOST} AS host FROM pages),
f AS (SELECT page_id, host, list_filter([CASE WHEN starts_with(lower(url), 'https://') THEN NULL ELSE 'https' END,
  CASE WHEN host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org') THEN NULL ELSE 'domain' END], lambda x: x IS NOT NULL) AS bad FROM p)
SELECT page_id, host, array_to_string(bad, '+') AS failed, len(bad) = 0 AS planned FROM f""",
    "q23b_robots": """
WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/en/6') THEN true WHEN starts_with(path, '/e') THEN false ELSE true END AS robots_allowed FROM p""",
    "q23c_paced": f"""
SELECT url, host, slot, slot * 2.5::DOUBLE AS not_before_seconds FROM (SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS slot FROM (SELECT DISTINCT url, {HOST} AS host FROM pages))""",
    "q24_idempotent": "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second",
    "q24b_two_runs": f"""
WITH {REPORTS}, a AS (SELECT company_id, count(*) AS n FROM reports WHERE report_year <= 1999 GROUP BY 1), b AS (SELECT company_id, count(*) AS n FROM reports WHERE report_year >= 1999 GROUP BY 1)
SELECT CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b USING (company_id) GROUP BY 1""",
    "q25_job_state": f"""
WITH {JOBS} SELECT job_id, state, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, n_events
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY job_id) AS n_events FROM jobs) WHERE r = 1""",
    "q26_over_time": f"""
WITH {JOBS}, g AS (SELECT job_id, event_id, trunc(epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) / 1000000 - epoch_us(ts) / 1000000)::BIGINT AS gap_seconds FROM jobs)
SELECT job_id, event_id, gap_seconds, coalesce(gap_seconds > 7200, false) AS late FROM g""",
    "q26b_failures": f"WITH {JOBS} SELECT job_id, event_id, state, json_extract_string(props, '$.k') AS reason FROM jobs WHERE state = 'failed'",
    "q27_integrity": """
WITH c AS (SELECT 'report_without_company' AS check_name, count(*) AS n_bad FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'result_without_report', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'repeated_report', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated_slot', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))
SELECT check_name, n_bad, n_bad = 0 AS ok FROM c""",
    "q28_pages": f"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, length({HTML}) AS n_chars, md5({HTML}) AS text_md5 FROM pages",
    "q29_properties": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "q30_chains": """
SELECT o_orderkey AS report_id, coalesce(string_agg(concat_ws(':', l_linenumber, l_partkey, l_returnflag), ',' ORDER BY l_linenumber, l_partkey, l_returnflag), '') AS chain, count(l_orderkey) AS n_evidence
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "q31_grading": """
SELECT CASE WHEN n = 0 AND c >= 0.85 THEN 'auto_verified_high' WHEN n = 0 AND c >= 0.6 THEN 'auto_verified_medium' ELSE 'candidate_found' END AS review_status, count(*) AS n
FROM (SELECT (1 - l_discount::DECIMAL(5,4) * 5)::DECIMAL(5,4) AS c, (l_returnflag = 'R')::INT + (l_quantity > 45)::INT AS n FROM lineitem) GROUP BY 1""",
    "q32_disclosure": f"""
WITH {VALUES}, v AS (SELECT DISTINCT company_id, indicator FROM vals),
g AS (SELECT c_custkey AS company_id, indicator FROM customer, (SELECT DISTINCT p_type AS indicator FROM part))
SELECT g.indicator AS indicator_id, CASE WHEN v.company_id IS NULL THEN 'not_disclosed' ELSE 'disclosed' END AS disclosure_status, count(*) AS n
FROM g LEFT JOIN v ON g.company_id = v.company_id AND g.indicator = v.indicator GROUP BY 1, 2""",
    "q33_normalised": """
SELECT raw_unit, unit, sum(value)::DOUBLE AS value, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'kg' WHEN 'N' THEN 'kt' ELSE 'crate' END AS raw_unit,
  CASE WHEN l_returnflag IN ('A', 'N') THEN 't' END AS unit, l_quantity::DECIMAL(18,6) * CASE l_returnflag WHEN 'A' THEN 0.001 WHEN 'N' THEN 1000 ELSE 1 END AS value FROM lineitem) GROUP BY 1, 2""",
    "q34_catalogue_split": "SELECT CASE WHEN length(p_type) % 2 = 0 THEN 'quantitative' ELSE 'qualitative' END AS kind, p_type AS indicator, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "q35_headers": """
SELECT array_to_string(bad, '+') AS failed, CASE WHEN len(bad) = 0 THEN 'pass' ELSE 'review' END AS decision, count(*) AS n, max(b) AS largest
FROM (SELECT strlen(text) AS b, list_filter([CASE WHEN starts_with(text, '%PDF-') THEN NULL ELSE 'header' END, CASE WHEN strlen(text) <= 65536 THEN NULL ELSE 'size' END], lambda x: x IS NOT NULL) AS bad FROM documents) GROUP BY 1, 2""",
    "q36_export": "SELECT c_custkey AS result_id, concat_ws(',', c_custkey, c_name, c_mktsegment, c_nationkey) AS line FROM customer",
    "q37_seed_and_runtime": f"WITH {REPORTS} SELECT CASE WHEN report_year < 1999 THEN 'seed' ELSE 'runtime' END AS origin, report_type, count(*) AS n, count(DISTINCT company_id) AS companies FROM reports GROUP BY ALL",
    "q38_candidates_of_layers": """
WITH k AS (SELECT *, min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey, l_linenumber) AS best, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS own FROM lineitem)
SELECT ['rule', 'table', 'model'][own + 1] AS source_type, count(*) AS n FROM k WHERE own = best GROUP BY 1""",
    "q39_best_per_company": f"""
WITH {VALUES}, y AS (SELECT indicator, unit, company_id, sum(value) AS value FROM vals GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY indicator, unit ORDER BY value DESC, company_id) AS place FROM y)
SELECT indicator, unit, place, company_id, value::DOUBLE AS value FROM r WHERE place <= 3""",
    "q40_store": f"""
WITH {REPORTS}
SELECT 'reports' AS name, report_year, CASE WHEN report_year >= 1998 THEN 'R' ELSE status END AS status, count(*) AS n FROM reports GROUP BY ALL
UNION ALL SELECT 'copied', report_year, status, count(*) FROM reports WHERE report_year <= 1998 OR report_year > 2000 GROUP BY ALL""",
    "q41_second_run": """
SELECT l_orderkey AS report_id, CASE WHEN l_orderkey % 2 = 1 THEN 'b' ELSE 'a' END AS run_id, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value
FROM lineitem WHERE l_orderkey % 2 = 0 OR l_quantity > 40 GROUP BY ALL""",
    "q42_time_out": f"""
WITH {JOBS}, l AS (SELECT job_id, arg_max(state, (ts, event_id)) AS state, min(ts) FILTER (state = 'running') AS started, max(event_id) AS last FROM jobs GROUP BY 1)
SELECT job_id, last + 1 AS event_id, 'timed_out' AS state, '2024-01-30 23:58:00' AS ts, 'over 7200 s' AS reason FROM l
WHERE state NOT IN ('succeeded', 'failed', 'timed_out') AND floor(epoch(TIMESTAMP '2024-01-30 23:58:00')) - floor(epoch(started)) > 7200""",
    "q43_layers": """
WITH i AS (SELECT l_orderkey AS r, l_linenumber AS n, l_returnflag AS f, CASE WHEN l_quantity >= 10 THEN l_quantity::DECIMAL(18,2) END AS v FROM lineitem),
rules AS (SELECT * FROM i WHERE f = 'N'), a AS (SELECT DISTINCT r, n FROM rules WHERE v IS NOT NULL),
tables AS (SELECT * FROM i WHERE f = 'R' AND (r, n) NOT IN (SELECT (r, n) FROM a)), b AS (SELECT r, n FROM a UNION SELECT r, n FROM tables WHERE v IS NOT NULL),
models AS (SELECT * FROM i WHERE f = 'A' AND (r, n) NOT IN (SELECT (r, n) FROM b))
SELECT s AS source_type, count(*) AS n, count(v) AS n_usable, sum(v)::DOUBLE AS value FROM (SELECT 'rule' AS s, v FROM rules UNION ALL SELECT 'table', v FROM tables UNION ALL SELECT 'model', v FROM models) GROUP BY 1""",
    "q44_catalogue_hits": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
c AS (SELECT * FROM (VALUES ('W1', '(?:^| )the ([a-z]+) (of|and)(?: |$)'), ('W2', '(?:^| )(?:in|en) ([a-z]+) (to|de|the)(?: |$)'), ('W3', '([0-9][0-9,]*) ?([a-z]+)'), ('W4', '(?:^| )(is|was)()(?: |$)')) AS x(id, p)),
h AS (SELECT doc_id, id, unnest(regexp_extract_all(t, p, 1)) AS v, unnest(regexp_extract_all(t, p, 2)) AS u FROM l, c WHERE regexp_matches(t, p))
SELECT doc_id AS report_id, id AS indicator_id, count(*) AS n, count(*) AS n_candidates, min(v) AS least_value, max(u) AS largest_unit, count(try_cast(replace(v, ',', '') AS DECIMAL(28,6))) AS n_numbers FROM h GROUP BY ALL""",
    "q45_guard": """
WITH c AS (SELECT doc_id, text, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 1 THEN 'no such words' ELSE substr(text, 1, 30) END AS f, CASE WHEN doc_id % 4 = 2 THEN '#' ELSE substr(text, 3, 2) END AS v FROM documents),
r AS (SELECT doc_id, list_filter([CASE WHEN NOT contains(text, f) THEN 'no_fragment' END, CASE WHEN NOT contains(f, v) THEN 'no_value' END, CASE WHEN k = 3 THEN 'no_unit' END,
  CASE WHEN regexp_extract(f, '(19|20)[0-9]{2}') NOT IN ('', '2024') THEN 'other_year' END], lambda x: x IS NOT NULL) AS flags FROM c)
SELECT doc_id AS report_id, array_to_string(flags, '+') AS risk_flags, CASE WHEN len(flags) > 0 THEN 'candidate_found' WHEN doc_id % 3 = 0 THEN 'auto_verified_high' ELSE 'auto_verified_medium' END AS review_status FROM r""",
    "q46_catalogue": f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{p}', '{kind}')" for i, p, kind, *_ in catalogue_rows())}) AS x(i, pillar, kind)),
o AS (SELECT DISTINCT o_custkey AS c, 'E' || lpad((o_custkey % 37 + 1)::VARCHAR, 2, '0') AS i FROM orders)
SELECT pillar, kind, CASE WHEN o.c IS NULL THEN 'not_disclosed' ELSE 'disclosed' END AS disclosure_status, count(*) AS n FROM customer CROSS JOIN k LEFT JOIN o ON o.c = c_custkey AND o.i = k.i GROUP BY ALL""",
    "q47_reviews": """
WITH v AS (SELECT event_id % 500 AS id, arg_max(CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'auto_verified_high' ELSE 'candidate_found' END, (ts, user_id::VARCHAR)) AS s FROM events GROUP BY 1)
SELECT coalesce(s, 'candidate_found') AS review_status, count(*) AS n FROM orders LEFT JOIN v ON id = o_orderkey GROUP BY 1""",
    "q48_search_all": """
SELECT 'company' AS kind, c_custkey AS id FROM customer WHERE contains(c_name, 're') UNION ALL SELECT 'indicator', p_partkey FROM part WHERE contains(p_name, 're')
UNION ALL SELECT 'address', page_id FROM pages WHERE contains(url, 're') UNION ALL SELECT 'text', doc_id FROM documents WHERE contains(text, 're')""",
    "q49_robots_patterns": f"""
WITH p AS (SELECT page_id, {HOST} AS host, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)),
m AS (SELECT page_id, CASE WHEN regexp_matches(path, '^/de/.*7$') THEN [7, 0] END AS a, CASE WHEN starts_with(path, '/en') THEN [4, 1] END AS b, CASE WHEN regexp_matches(path, '^/.*5') THEN [3, 0] END AS c, host FROM p)
SELECT page_id, CASE WHEN host IS NULL THEN true WHEN NOT ends_with(host, '.com') THEN false ELSE coalesce(list_sort(list_filter([a, b, c], lambda x: x IS NOT NULL), 'DESC')[1][2] = 1, true) END AS robots_allowed FROM m""",
    "q50_live_jobs": f"""
WITH {JOBS}, l AS (SELECT job_id, arg_max(state, (ts, event_id)) AS state, max(ts) AS ts, count(*) AS n_events, min(ts) FILTER (state = 'running') AS started FROM jobs GROUP BY 1)
SELECT job_id, state, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, n_events, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, started IS NOT NULL AND state NOT IN ('succeeded', 'failed', 'timed_out') AS overdue FROM l""",
    "q51_search_index": f"""
SELECT term, doc_id, (length(text) - length(replace(text, term, ''))) // length(term) AS n_hits, instr(text, term) AS first_at
FROM documents, (SELECT unnest([{", ".join(f"'{t}'" for t in SEARCH_TERMS)}]) AS term) WHERE contains(text, term)""",
    "q53_layout_tables": """
WITH i AS (SELECT l_orderkey AS report_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, rpad(l_quantity::INT::VARCHAR, 12, ' ') || l_extendedprice::DECIMAL(18,2)) + 2)::INT AS row, 'item ' || l_linenumber AS label, l_quantity, l_extendedprice FROM lineitem)
SELECT report_id, row, 2 AS col, label, 'Amount' AS header, 'kg' AS unit, l_quantity::INT::DOUBLE AS value FROM i UNION ALL SELECT report_id, row, 3, label, 'Price', 'CNY', l_extendedprice::DECIMAL(18,2)::DOUBLE FROM i""",
    "q54_ingest": "SELECT min(doc_id) AS doc_id, sha256(text) AS file_sha256 FROM documents WHERE text IS NOT NULL GROUP BY text",
    "q55_platform_seed": """
WITH i AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS n FROM lineitem), o AS (SELECT o_orderkey AS r FROM orders WHERE o_orderkey % 7 = 0),
s AS (SELECT count(*) AS n FROM i), k AS (SELECT count(*) AS n FROM i WHERE NOT (r IN (SELECT r FROM o)) OR (r % 7 = 0 AND n <= 2))
SELECT step, name, (CASE WHEN step = 'run' THEN k.n ELSE s.n END) AS n FROM s, k, (SELECT unnest(['seed', 'copied', 'run', 'restored']) AS step), (SELECT unnest(['results', 'evidence', 'candidates']) AS name)""",
    "q56_compaction": """
WITH i AS (SELECT l_orderkey AS r, l_quantity::DECIMAL(18,2) AS v FROM lineitem),
s AS (SELECT step, CASE WHEN step IN ('appended again', 'files removed') AND r % 5 = 0 THEN 'c' WHEN r % 3 = 0 THEN 'b' ELSE 'a' END AS run_id, r, v
  FROM i, (SELECT unnest(['appended', 'compacted', 'appended again', 'files removed']) AS step))
SELECT step, run_id, count(*) AS n, count(DISTINCT r) AS n_reports, sum(v)::DOUBLE AS value FROM s GROUP BY ALL""",
    "q57_increments": f"""
WITH {REPORTS}, f AS (SELECT 'reports' AS entity, report_year AS year, report_id AS id FROM reports UNION ALL SELECT 'companies', report_year, company_id FROM reports
  UNION ALL SELECT 'results', report_year, l_orderkey * 8 + l_linenumber FROM lineitem JOIN reports ON l_orderkey = report_id JOIN part ON l_partkey = p_partkey),
c AS (SELECT company_id FROM reports WHERE report_year IN (1998, 1999, 2000) GROUP BY 1 HAVING count(DISTINCT report_year) = 3)
SELECT entity, NULL::BIGINT AS year, count(DISTINCT id) AS n FROM f GROUP BY 1 UNION ALL SELECT entity, year, count(DISTINCT id) FROM f GROUP BY 1, 2
UNION ALL SELECT 'complete', y, count(*) FROM c, (SELECT unnest([1998, 1999, 2000])::BIGINT AS y) GROUP BY 2""",
    "q58_increment_trends": f"""
WITH {REPORTS}, v AS (SELECT company_id, p_type AS indicator, l_linestatus AS unit, report_year AS year, l_orderkey * 8 + l_linenumber AS id, l_quantity::DECIMAL(18,2) AS value
  FROM lineitem JOIN reports ON l_orderkey = report_id JOIN part ON l_partkey = p_partkey),
y AS (SELECT company_id, indicator, unit, year, value FROM v QUALIFY row_number() OVER (PARTITION BY company_id, indicator, unit, year ORDER BY id, value) = 1),
t AS (SELECT *, count(*) OVER k AS n_years, lag(value) OVER (k ORDER BY year) AS previous, year - lag(year) OVER (k ORDER BY year) AS step FROM y WINDOW k AS (PARTITION BY company_id, indicator, unit))
SELECT company_id, indicator, unit, year, value::DOUBLE AS value, previous::DOUBLE AS previous, (value - previous)::DOUBLE AS change, n_years, step FROM t WHERE n_years >= 2""",
}

# the same rows by another plan
ORACLE_SQL["q52_anchor_hits"] = ORACLE_SQL["q44_catalogue_hits"]
