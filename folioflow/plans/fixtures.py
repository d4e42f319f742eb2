"""Layout, markdown and OCR relations derived from the supplied tables by integer arithmetic.

Each is one SQL text for Spark and DuckDB; only what differs (exploding, global replacement) is chosen by dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK, DUCK = "spark", "duckdb"

_EXPLODE = {
    SPARK: {
        "lines": r"SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\n', -1)) x AS pos, line",
        "tokens": r"SELECT doc_id, line_no, CAST(pos AS BIGINT) AS pos, token FROM decorated LATERAL VIEW posexplode(filter(split(text, '\\s+'), w -> w <> '')) x AS pos, token",
    },
    DUCK: {
        "lines": "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
        "tokens": r"SELECT doc_id, line_no, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, line_no, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM decorated)",
    },
}
_GLOBAL = {SPARK: "", DUCK: ", 'g'"}

VIEWS = {
    "decorated": """
SELECT doc_id, line_no, r, CASE r WHEN 0 THEN concat('• ', line) WHEN 1 THEN concat('1. ', line) WHEN 2 THEN concat('a) ', line)
  WHEN 3 THEN concat('(2) ', line) WHEN 4 THEN concat(line, ' see http://ex.org/p?id=', CAST(line_no AS VARCHAR(20)), ' or www.ex.org')
  WHEN 5 THEN concat(line, ' — «end» … 2019') WHEN 6 THEN concat(line, ' .....') WHEN 7 THEN concat(line, '-')
  WHEN 8 THEN concat('7 ', line, '   a|b|c|d|e|f') ELSE line END AS text
FROM (SELECT doc_id, line_no, line, (doc_id * 7 + line_no * 13) % 11 AS r FROM lines) q""",
    "doc_lines": """
SELECT doc_id AS page_id, CAST(floor(line_no / 4) AS BIGINT) AS block_no, CAST(line_no AS BIGINT) AS line_no, text, size,
  CASE WHEN r = 2 THEN 16 ELSE 0 END AS flags, r = 2 AS bold, x0, x0 + 5 * length(text) AS x1, y0, y0 + size AS y1
FROM (SELECT doc_id, line_no, r, text, CAST(CASE r WHEN 0 THEN 18 WHEN 1 THEN 14 WHEN 9 THEN 6 ELSE 11 END AS DOUBLE) AS size,
  CAST(CASE WHEN r % 2 = 0 THEN 72 ELSE 320 END AS DOUBLE) AS x0,
  CAST(72 + 14 * line_no + 20 * floor(line_no / 5) - CASE WHEN r = 10 THEN 6 ELSE 0 END AS DOUBLE) AS y0 FROM decorated) q""",
    "spans": """
SELECT page_id, block_no, line_no, span_no, text, x0, y0, x0 + w AS x1, y0 + 12 AS y1,
  CAST(CASE WHEN span_no % 9 = 8 THEN 7 ELSE 11 END AS DOUBLE) AS size, CASE s WHEN 7 THEN 'Courier New' WHEN 8 THEN 'Times Serif' WHEN 9 THEN 'Helvetica-Bold' WHEN 10 THEN CASE line_no % 4 WHEN 0 THEN 'MONACO' WHEN 1 THEN 'CambriaMath' WHEN 2 THEN 'ITC Zapf Code' ELSE 'Times New Roman-Oblique' END
  WHEN 11 THEN CASE line_no % 3 WHEN 0 THEN 'SourceCodePro' WHEN 1 THEN 'Source Code Pro' ELSE 'American Typewriter' END ELSE 'Helvetica' END AS font,
  CASE WHEN s = 3 THEN 16711680 WHEN s % 4 = 0 THEN 255 ELSE 0 END AS color, CASE WHEN s < 4 THEN 16 WHEN s = 5 THEN 2 WHEN s = 6 THEN 1 ELSE 0 END AS flags,
  y0 + 10 - CASE span_no % 18 WHEN 8 THEN 4 WHEN 17 THEN -3 ELSE 0 END AS origin_y
FROM (SELECT doc_id AS page_id, CAST(floor(line_no / 4) AS BIGINT) AS block_no, CAST(line_no AS BIGINT) AS line_no, CAST(pos AS BIGINT) AS span_no, token AS text,
  CAST(72 + 60 * pos AS DOUBLE) AS x0, CAST(CASE WHEN (pos + line_no) % 3 = 0 THEN 60 ELSE 50 END AS DOUBLE) AS w, CAST(72 + 14 * line_no AS DOUBLE) AS y0,
  (doc_id * 3 + line_no * 5 + CAST(floor(pos / 3) AS BIGINT) * 7) % 13 AS s FROM tokens) q""",
    "page_blocks": """
SELECT page_id, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(842 AS DOUBLE) AS height, CAST(595 AS DOUBLE) AS width
FROM doc_lines GROUP BY page_id, block_no""",
    "layout_blocks": """
SELECT page_id, blk_no, type, x0, y0, x0 + w AS x1, y0 + 30 AS y1, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height
FROM (SELECT page_id, k AS blk_no, CASE WHEN (page_id + k) % 7 = 6 THEN 'figure' WHEN k = 0 THEN 'title' ELSE 'text' END AS type,
  CAST(CASE WHEN page_id % 4 = 0 THEN 150 + 10 * (k % 3) WHEN page_id % 4 = 1 THEN 40 + 180 * (k % 3) WHEN page_id % 4 = 2 THEN 40 + 265 * (k % 2) ELSE 30 + 130 * (k % 2) + 3 * k END AS DOUBLE) AS x0,
  CAST(CASE WHEN page_id % 4 = 0 THEN 300 WHEN page_id % 4 = 1 THEN 150 WHEN page_id % 4 = 2 THEN 240 ELSE 120 END AS DOUBLE) AS w,
  CAST(60 + 70 * floor(k / 2) + length(html) % 11 AS DOUBLE) AS y0 FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) n) q""",
    "boxes": """
SELECT doc_id AS page_id, line_no * 1000 + pos AS box_no, token AS txt, CAST(72 + 40 * pos AS DOUBLE) AS x_min, CAST(72 + 40 * pos + 7 * length(token) AS DOUBLE) AS x_max,
  CAST(100 + 20 * line_no + (pos % 3) AS DOUBLE) AS y_min, CAST(114 + 20 * line_no + (pos % 3) AS DOUBLE) AS y_max,
  CAST(50 + 4 * ((doc_id * 7 + line_no * 13) % 11) AS DOUBLE) / 100 AS score, CAST(900 AS DOUBLE) AS width FROM tokens""",
    "markdown": """
SELECT page_id AS doc_id, concat(regexp_replace(replace(replace(replace(replace(replace(html, '<h1>', concat(chr(10), '# ')), '</h1>', concat(chr(10), chr(10))),
  '</p>', concat(chr(10), chr(10))), '</li>', chr(10)), '<br>', chr(10)), '<[^>]+>', ''{G}), chr(10), '| name | page |', chr(10), '|---|---|', chr(10),
  '| p', CAST(page_id AS VARCHAR(20)), ' | x < y & z |', chr(10), '| | k |', chr(10), '![img](x)', chr(10), 'tail **bold** [link](http://ex.org)', chr(10), '### end', chr(10), 'last') AS text FROM pages""",
    "page_images": """
SELECT page_id, CAST(595 AS DOUBLE) AS width, CAST(842 AS DOUBLE) AS height, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 75 ELSE 95 END AS pct,
  CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'a few words of text on it' ELSE html END AS text FROM pages""",
}
_NEEDS = {"decorated": ["lines"], "tokens": ["decorated"], "doc_lines": ["decorated"], "spans": ["tokens"], "page_blocks": ["doc_lines"], "boxes": ["tokens"]}


def text_of(name: str, dialect: str) -> str:
    if name in _EXPLODE[dialect]:
        return _EXPLODE[dialect][name]
    text = VIEWS[name].replace("{G}", _GLOBAL[dialect])
    return text.replace("VARCHAR(20)", "STRING") if dialect == SPARK else text


def needed(names: list[str]) -> list[str]:
    """Views in order of definition."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*needed(_NEEDS.get(n, [])), n] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    text = text_of(name, SPARK)
    used = [n for n in [*VIEWS, *_EXPLODE[SPARK]] if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", text)]
    tables = [t for t in ("documents", "pages", "benchmark") if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    frames = {n: view(spark, sf_dir, n) for n in used} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for n in frames:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **frames)


def with_views(names: list[str], query: str) -> str:
    """DuckDB text of a query over derived relations."""
    return "WITH " + ", ".join(f"{n} AS ({text_of(n, DUCK)})" for n in needed(names)) + " " + query
