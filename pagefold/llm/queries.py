"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .audio import op6_audio_fingerprints
from .decontaminate import op9_benchmark_decontamination
from .html import op2_html_extraction
from .lines import MARKS, op3_line_dedup
from .lm import op10_lm_scoring
from .packing import op5_best_fit_packing
from .passages import op7_substring_dedup
from .quality import op4_quality_classifier
from .secrets import op1_secret_scan
from .simhash import op8_simhash_near_dedup

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_audio_fingerprints": op6_audio_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
}
#: Queries that SQL can express and run on whole tables; the tests hold all others against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
n AS (SELECT doc_id, no, line, translate(lower(line), '""" + MARKS.replace("'", "''") + """', '') AS norm FROM l),
f AS (SELECT norm, length(norm) AS len, min(doc_id * 4294967296 + no) AS loc FROM n WHERE norm <> '' GROUP BY norm),
p AS (SELECT a.norm AS x, b.norm AS y, a.loc AS lx, b.loc AS ly, a.len AS n FROM f a JOIN f b ON b.len BETWEEN a.len AND a.len + 1 AND a.len >= 20 AND a.norm <> b.norm
      AND (left(a.norm, a.len // 2) = left(b.norm, a.len // 2) OR right(a.norm, a.len - a.len // 2) = right(b.norm, a.len - a.len // 2))),
e AS (SELECT lx, ly FROM p WHERE len(list_filter(range(0, n + 1), lambda k: left(x, k) = left(y, k) AND (substr(x, k + 2) = substr(y, k + 2) AND length(x) = length(y) OR substr(x, k + 1) = substr(y, k + 2) AND length(y) = length(x) + 1))) > 0),
near AS (SELECT DISTINCT greatest(lx, ly) AS loc FROM e),
g AS (SELECT n.doc_id, n.no, n.line, n.norm <> '' AND (f.loc <> n.doc_id * 4294967296 + n.no OR near.loc IS NOT NULL) AS gone FROM n LEFT JOIN f ON n.norm = f.norm LEFT JOIN near ON near.loc = f.loc)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(list(CAST(no AS INT) ORDER BY no) FILTER (gone), []) AS dropped, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text FROM g GROUP BY doc_id""",
    "op9_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
x AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM s) z)),
h AS (SELECT x.doc_id, x.k, x.n, i.item_id FROM x JOIN i ON x.n = i.n AND x.key = i.key),
q AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
}
