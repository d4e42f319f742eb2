"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import math

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = doc_id AS kept FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c LEFT JOIN n USING (doc_id)"""

DECONTAMINATE = f"""
WITH iw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
dg AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dg JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _escaped(x: str) -> str:
    return rf"replace(replace({x}, '\', '\\'), '<|', '<\|')"


_SAID = "<|im_end|><|im_start|>assistant ok"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>') + length(replace({_escaped("role")}, chr(10), chr(92) || 'n')) + 1 + length({_escaped("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FEATURES = [("marks", "n_marks", "word_chars", True), ("upper", "n_upper", "word_chars", True), ("word_length", "word_chars", "n_words", True), ("dup_lines", "n_dup_lines", "n_lines", False), ("repeats", "n_repeat_words", "n_words", False)]
_RATIOS = " UNION ALL ".join(f"SELECT doc_key, lang, source, base_failed, '{f}' AS feature, {varies} AS varies, CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / {b} END AS v FROM m" for f, a, b, varies in _FEATURES)
_KEYS = "lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks"


def _level(groups: str) -> str:
    """mid, reach and docs of each feature in each group, from buckets 2 % wide."""
    keys = f"{groups}, " if groups else ""
    return f"""(SELECT {keys}feature, docs, mid, CASE WHEN varies AND mid > low THEN 8.0 * (mid - low) ELSE 2.0 * (high - mid) END AS reach FROM (
SELECT {keys}feature, varies, any_value(docs) AS docs, min(value) FILTER (upto >= 0.5::DOUBLE * docs) AS mid, min(value) FILTER (upto >= 0.1::DOUBLE * docs) AS low, min(value) FILTER (upto >= 0.995::DOUBLE * docs) AS high FROM (
SELECT {keys}feature, varies, CASE WHEN bucket IS NULL THEN 0 ELSE pow(1.02::DOUBLE, bucket) * (2 / 2.02::DOUBLE) END AS value, sum(n) OVER (PARTITION BY {keys}feature) AS docs, sum(n) OVER (PARTITION BY {keys}feature ORDER BY coalesce(bucket, -1048576)) AS upto
FROM (SELECT {keys}feature, varies, bucket, count(*) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}feature, varies))"""


def _drawn(level: str, up: str, join: str, keys: str) -> str:
    own = "(f.docs / (f.docs + 100))"
    least = f"CASE WHEN f.feature IN ('marks', 'upper', 'word_length') THEN greatest(f.reach, 0.5 * {up}.reach) ELSE f.reach END"
    return f"SELECT {keys}, f.feature, {own} * f.mid + (1 - {own}) * {up}.mid AS mid, {own} * ({least}) + (1 - {own}) * {up}.reach AS reach FROM {level} f JOIN {up} ON {up}.feature = f.feature {join}"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS doc_key, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_key, i, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_key, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM d)),
rep AS (SELECT doc_key, count(DISTINCT p) AS n FROM (SELECT doc_key, unnest(range(i, i + 3)) AS p FROM (SELECT doc_key, i, count(*) OVER (PARTITION BY doc_key, g) AS k FROM win) WHERE k > 1) GROUP BY doc_key),
m AS (SELECT doc_key, doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) AS n_marks,
len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) LEFT JOIN rep USING (doc_key)),
r AS ({_RATIOS}),
once AS (SELECT min(doc_key) AS doc_key FROM m WHERE NOT base_failed GROUP BY {_KEYS}),
sketch AS (SELECT lang, source, feature, varies, CASE WHEN v >= 1e-4::DOUBLE THEN CAST(ceil(ln(v) / {math.log1p(0.02)!r}::DOUBLE) AS BIGINT) END AS bucket FROM r JOIN once USING (doc_key)),
corpus AS (SELECT feature, mid, reach * (1 + 100 / docs) AS reach FROM {_level("")}),
langs AS ({_drawn(_level("lang"), "corpus", "", "f.lang")}),
cells AS ({_drawn(_level("lang, source"), "langs", "AND langs.lang IS NOT DISTINCT FROM f.lang", "f.lang, f.source")}),
over_ AS (SELECT doc_key, string_agg(r.feature, ',' ORDER BY CASE r.feature WHEN 'marks' THEN 1 WHEN 'upper' THEN 2 WHEN 'word_length' THEN 3 WHEN 'dup_lines' THEN 4 ELSE 5 END) AS f FROM r
JOIN cells c ON c.feature = r.feature AND c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source
WHERE r.v > CASE WHEN r.feature = 'repeats' THEN least((c.mid + c.reach) * 1.02::DOUBLE, 0.49) ELSE (c.mid + c.reach) * 1.02::DOUBLE END GROUP BY doc_key)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f IS NULL AS kept, concat_ws(',', CASE WHEN base_failed THEN 'base' END, f) AS failed FROM m LEFT JOIN over_ USING (doc_key)"""
