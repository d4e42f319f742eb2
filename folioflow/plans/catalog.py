"""Named queries over the supplied tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T
from folioflow.operators import elements as E
from folioflow.operators import folds, layout, metrics, spans
from folioflow.operators.sentences import sentence_counts, sentence_list, sentences
from folioflow.plans.fixtures import view, with_views

#: Sought in every document: common words, parts of words, and what hardly any has.
KEYWORDS = ["the", "DE", "and", "la", "und", "que", "of", "der", "Token", "license", "tion", "sch", "ness", "xyzzy"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql may read derived views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(list(views), sql) if views else sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, n: int = 6):
    return F.round(c, n)


# DuckDB text of the expressions


def q_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def q_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def q_count(x: str, pattern: str) -> str:
    return "len(regexp_extract_all({}, '{}'))".format(x, pattern.replace("'", "''"))


def q_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


_RUNS = "|".join([rf"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789àèìòùáéíóúäëïöüñçßêÉÈÊÇÄÖÜÑÁÍÓÚ ,;:!#%&@=_<>~•—«»…'\"-"] + [rf"\{c}{{5,}}" for c in r".*+?()[]{}|^$\/"] + [r"\t{5,}"])


def q_parts(x: str) -> dict[str, str]:
    w = q_words(x)
    return {
        "special": q_ratio(q_count(x, r"""[^\p{L}\p{N}_\s.,;:!?'"()-]"""), f"length({x})"),
        "single": q_ratio(rf"len(list_filter({w}, lambda v: length(v) = 1 AND NOT regexp_matches(v, '^\p{{Nd}}$')))", f"len({w})"),
        "repeats": q_count(x, _RUNS),
        "vowels": q_ratio(q_count(x, f"[{config.VOWELS}]"), f"length({x})"),
        "length": q_ratio(f"coalesce(list_sum(list_transform({w}, lambda v: length(v))), 0)", f"len({w})"),
    }


_P = q_parts("text")
Q_SCORE = (
    f"CASE WHEN length({q_strip('text')}) < 5 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - 2 * {_P['special']} - 1.5 * {_P['single']}"
    f" - least(0.3, 0.1 * {_P['repeats']}) - CASE WHEN {_P['vowels']} < 0.1 THEN 0.2 ELSE 0 END)) END"
)
Q_ISSUES = (
    f"CASE WHEN length({q_strip('text')}) < 5 THEN 'empty_or_too_short' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN {_P['special']} > 0.15 THEN 'high_special_chars' END,"
    f" CASE WHEN {_P['single']} > 0.3 THEN 'fragmented' END, CASE WHEN {_P['repeats']} > 2 THEN 'repeated_chars' END,"
    f" CASE WHEN {_P['vowels']} < 0.1 AND length(text) > 50 THEN 'low_vowels' END, CASE WHEN {_P['length']} < 2.5 OR {_P['length']} > 15 THEN 'unusual_word_length' END), ''), 'good') END"
)


@query(f"SELECT doc_id, round({Q_SCORE}, 6) AS score FROM documents")
def text_quality(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rounded(T.quality_score("text")).alias("score"))


@query(f"SELECT doc_id, {Q_ISSUES} AS issues FROM documents")
def text_quality_issues(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.quality_issues("text").alias("issues"))


@query(
    f"""SELECT lang, count(*) AS n, round(avg(s), 6) AS mean_score, count(*) FILTER (issues <> 'good') AS flagged, count(*) FILTER (s >= 0.5 AND w >= 15) AS accepted
FROM (SELECT lang, {Q_SCORE} AS s, {Q_ISSUES} AS issues, len({q_words("text")}) AS w FROM documents) GROUP BY lang"""
)
def text_quality_by_lang(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", T.quality("text").alias("q"))
    accepted = (F.col("q.score") >= config.FAIR_QUALITY) & (F.col("q.words") >= config.FAIR_WORDS)
    return d.groupBy("lang").agg(F.count("*").alias("n"), rounded(F.avg("q.score")).alias("mean_score"), F.count_if(F.col("q.issues") != "good").alias("flagged"), F.count_if(accepted).alias("accepted"))


_S = q_strip("text")
Q_CONF = (
    rf"CASE WHEN length({_S}) < 5 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.85 AS DOUBLE) + CASE WHEN length({_S}) > 100 THEN 0.05 ELSE 0 END - CASE WHEN length({_S}) < 20 THEN 0.2 ELSE 0 END"
    rf" - CASE WHEN {q_ratio(q_count(_S, chr(91) + r'^\p{L}\p{N}\s' + chr(93)), f'length({_S})')} > 0.3 THEN 0.2 ELSE 0 END"
    rf" - CASE WHEN {q_ratio(f'len(list_filter({q_words(_S)}, lambda v: length(v) = 1))', f'len({q_words(_S)})')} > 0.4 THEN 0.15 ELSE 0 END)) END"
)


@query(f"SELECT doc_id, round({Q_CONF}, 6) AS confidence FROM documents")
def ocr_confidence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rounded(T.ocr_confidence("text")).alias("confidence"))


@query(f"SELECT doc_id, length(text) AS chars, len({q_words('text')}) AS words, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, round({Q_CONF}, 6) AS confidence FROM documents")
def ocr_page_record(spark, sf_dir):
    out = metrics.ocr_page_record(docs(spark, sf_dir))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chars", "words", "lines")], rounded(F.col("confidence")).alias("confidence"))


def q_tidy(x: str) -> str:
    for pattern, new in [(r"\.{4,}", " ... "), (r"[^\S\n]+", " "), (r"\n{3,}", "\n\n"), (r" +([.,;:!?])", r"\1"), (r"([.,;:!?])([A-Za-z])", r"\1 \2"), (r"[^\S\n]+(\n|$)", r"\1")]:
        x = "regexp_replace({}, '{}', {}, 'g')".format(x, pattern, "chr(10) || chr(10)" if "\n" in new else f"'{new}'")
    return q_strip(x)


@query(f"SELECT doc_id, line_no, {q_tidy('text')} AS text FROM decorated", ("decorated",))
def ocr_tidy(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.tidy("text").alias("text"))


@query(
    rf"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: {q_strip(r"replace(regexp_replace(p, '[ \t]+', ' ', 'g'), chr(10), ' ')")}),
lambda p: p <> ''), chr(10) || chr(10)) AS text FROM markdown""",
    ("markdown",),
)
def normalize_whitespace(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("doc_id", T.normalize_whitespace("text").alias("text"))


def q_strip_markdown(x: str) -> str:
    for pattern, new in [(r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}(.*?)\*{1,3}", r"\1"), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n")]:
        x = "regexp_replace({}, '{}', {}, 'g')".format(x, pattern, "chr(10) || chr(10)" if "\n" in new else f"'{new}'")
    return q_strip(x)


@query(f"SELECT doc_id, {q_strip_markdown('text')} AS text FROM markdown", ("markdown",))
def strip_markdown(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("doc_id", T.strip_markdown("text").alias("text"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape("html").alias("html"))


@query("SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages")
def strip_tags_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags("html").alias("text"))


# RE2 has no lookahead: the character that must not follow is read with the marker
_MARKERS = [
    ("bullet", r"^[•●○◦▪▸▹–—]\s"), ("hyphen", r"^-\s([^0-9]|$)"), ("number", r"^\d{1,3}[.)]\s"), ("letter", r"^[a-z][.)]\s"), ("capital", r"^[A-Z][.)]\s([^A-Z]|$)"),
    ("roman", r"^(?i:i{1,3}|iv|vi{0,3}|ix|x)[.)]\s"), ("number in parentheses", r"^\(\d{1,3}\)\s"), ("letter in parentheses", r"^\([a-z]\)\s"),
]


def q_kind(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({q_strip(x)}, '{p}') THEN '{n}'" for n, p in _MARKERS) + " END"


def q_prefix(x: str) -> str:
    return "CASE " + " ".join("WHEN regexp_matches({0}, '{1}') THEN regexp_extract({0}, '{2}')".format(q_strip(x), p, p.replace("([^0-9]|$)", "").replace("([^A-Z]|$)", "")) for _, p in _MARKERS) + " END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT {q_kind('text')} AS kind FROM decorated) WHERE kind IS NOT NULL GROUP BY kind", ("decorated",))
def list_items(spark, sf_dir):
    found = view(spark, sf_dir, "decorated").select(T.list_kind("text").alias("kind")).where("kind is not null")
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, line_no, {q_prefix('text')} AS prefix, substr({q_strip('text')}, coalesce(length({q_prefix('text')}), 0) + 1) AS body FROM decorated", ("decorated",))
def list_prefix(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.list_prefix("text").alias("prefix"), T.list_body("text").alias("body"))


_ABBREVIATIONS = ", ".join(f"'{a}'" for a in config.ABBREVIATIONS)
Q_SENTENCES = rf"""(SELECT doc_id, sent_no, string_agg(token, ' ' ORDER BY pos) AS sentence FROM (
SELECT doc_id, pos, token, CAST(coalesce(sum(CAST(closes AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sent_no FROM (
SELECT *, regexp_matches(token, '[.!?]$') AND bare NOT IN ({_ABBREVIATIONS}) AND length(bare) <> 1 AND NOT regexp_matches(regexp_replace(bare, '[,.]', '', 'g'), '^\p{{Nd}}+$') AS closes FROM (
SELECT doc_id, pos, token, lower(regexp_replace(token, '[.!?]+$', '')) AS bare FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, {q_words("text")} AS w FROM documents))))) GROUP BY doc_id, sent_no)"""


@query(f"SELECT doc_id, sent_no, sentence FROM {Q_SENTENCES}")
def sentences_(spark, sf_dir):
    return sentences(docs(spark, sf_dir))


QUERIES["sentences"], ORACLES["sentences"] = QUERIES.pop("sentences_"), ORACLES.pop("sentences_")


@query(f"SELECT lang, count(*) AS n, round(avg(len({q_words('sentence')})), 6) AS mean_words FROM {Q_SENTENCES} s JOIN documents USING (doc_id) GROUP BY lang")
def sentence_counts_by_lang(spark, sf_dir):
    return sentence_counts(docs(spark, sf_dir), "lang").withColumn("mean_words", rounded(F.col("mean_words")))


@query(
    f"""SELECT doc_id, i AS line, array_to_string(w[CAST(a AS INT) + 1 : CAST(b AS INT)], ' ') AS text FROM (
SELECT doc_id, w, i, CASE WHEN len(w) <= 4 THEN i ELSE i * (len(w) // 4) + least(i, len(w) % 4) END AS a,
CASE WHEN len(w) <= 4 THEN least(i + 1, len(w)) ELSE (i + 1) * (len(w) // 4) + least(i + 1, len(w) % 4) END AS b
FROM (SELECT doc_id, {q_words("text")} AS w FROM documents), (SELECT CAST(unnest(range(4)) AS BIGINT) AS i))"""
)
def distribute_words(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.distributed(F.col("text"), F.lit(4))).alias("line", "text"))
    return d.select("doc_id", F.col("line").cast("long").alias("line"), "text")


_URL = r'https?://[^\s<>"]+|www\.[^\s<>"]+'


@query(
    rf"""SELECT doc_id, line_no, array_to_string(list_transform(regexp_split_to_array(text, '{_URL}'), lambda p, i: CASE WHEN i = 1 THEN p ELSE '[URL' || (i - 2) || ']' || p END), '') AS text,
len(regexp_extract_all(text, '{_URL}')) AS n_urls, array_to_string(regexp_extract_all(text, '{_URL}'), ' ') AS urls FROM decorated""",
    ("decorated",),
)
def url_protect(spark, sf_dir):
    d = view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.protect_urls("text").alias("p"))
    return d.select("doc_id", "line_no", "p.text", F.size("p.urls").cast("long").alias("n_urls"), F.array_join("p.urls", " ").alias("urls"))


@query("SELECT " + ", ".join(f"CAST(sum({q_count('text', p)}) AS BIGINT) AS {n}" for n, p in config.TYPOGRAPHIC.items()) + " FROM decorated", ("decorated",))
def typographic_census(spark, sf_dir):
    return view(spark, sf_dir, "decorated").agg(*[F.sum(c).alias(n) for n, c in T.typographic("text").items()])


_CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"
_CJK_TEXT = "concat(text, CASE WHEN doc_id % 10 = 3 THEN '漢字かなカナ漢字' WHEN doc_id % 10 = 4 THEN '漢' ELSE '' END)"


@query(f"SELECT doc_id, {q_count(_CJK_TEXT, _CJK)} AS n, {q_count(_CJK_TEXT, _CJK)} > 5 AS flagged FROM documents")
def cjk_flag(spark, sf_dir):
    n = T.cjk(F.expr(_CJK_TEXT))
    return docs(spark, sf_dir).select("doc_id", n.cast("long").alias("n"), (n > 5).alias("flagged"))


@query(
    "SELECT doc_id, length(text) - length(replace(text, '|', '')) > 4 OR contains(text, chr(9)) OR len(list_filter(string_split(text, chr(10)), lambda x: contains("
    + q_strip("x")
    + ", '   '))) > 3 AS might FROM (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM decorated GROUP BY doc_id)",
    ("decorated",),
)
def might_contain_table(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    d = view(spark, sf_dir, "decorated").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return d.select("doc_id", T.might_contain_table("text").alias("might"))


Q_ELEMENTS = rf"""(
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS BIGINT) AS elem_no, side AS type,
CAST(CASE WHEN side = 'heading' THEN length(regexp_extract(lines[1], '^(#{{1,6}})\s', 1)) ELSE 0 END AS BIGINT) AS level,
CASE side WHEN 'heading' THEN {q_strip(r"regexp_extract(lines[1], '^#{1,6}\s+(.+)', 1)")} WHEN 'table' THEN array_to_string(lines, chr(10)) ELSE array_to_string(lines, ' ') END AS text,
array_to_string(lines, chr(10)) AS raw FROM (
SELECT doc_id, side, island, min(n) AS n, list(line ORDER BY n) AS lines FROM (
SELECT *, sum(CASE WHEN side = 'heading' THEN 1 WHEN side = 'table' AND before IS DISTINCT FROM 'table' THEN 1 WHEN side = 'paragraph' AND solid IS DISTINCT FROM 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM (
SELECT *, lag(side) OVER w AS before, last_value(nullif(side, 'image') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solid FROM (
SELECT *, CASE WHEN kind IN ('table', 'separator') THEN 'table' ELSE kind END AS side FROM (
SELECT doc_id, n, line, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^\|[\s\-:|]+\|$') THEN 'separator' WHEN starts_with(line, '|') THEN 'table'
WHEN regexp_matches(line, '^#{{1,6}}\s+.+') THEN 'heading' WHEN starts_with(line, '![') THEN 'image' ELSE 'paragraph' END AS kind FROM (
SELECT doc_id, unnest(range(len(l))) AS n, {q_strip("unnest(l)")} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM markdown))))
WINDOW w AS (PARTITION BY doc_id ORDER BY n))) WHERE kind IN ('table', 'heading', 'paragraph') GROUP BY doc_id, side, island))"""


@query(f"SELECT * FROM {Q_ELEMENTS}", ("markdown",))
def markdown_elements(spark, sf_dir):
    return E.elements(view(spark, sf_dir, "markdown"))


@query(f"SELECT type, level, count(*) AS n FROM {Q_ELEMENTS} GROUP BY type, level", ("markdown",))
def markdown_element_counts(spark, sf_dir):
    return E.elements(view(spark, sf_dir, "markdown")).groupBy("type", "level").agg(F.count("*").alias("n"))


def q_cells(x: str) -> str:
    parts = rf"list_transform(string_split({q_strip(x)}, '|'), lambda c: {q_strip('c')})"
    parts = f"(CASE WHEN ({parts})[1] = '' THEN ({parts})[2:] ELSE {parts} END)"
    return f"(CASE WHEN ({parts})[-1] = '' THEN ({parts})[:-2] ELSE {parts} END)"


@query(
    f"""SELECT doc_id, elem_no, r, unnest(range(len(c))) AS c, unnest(c) AS cell FROM (SELECT doc_id, elem_no, r, {q_cells("line")} AS c FROM (
SELECT doc_id, elem_no, unnest(range(len(l))) AS r, unnest(l) AS line FROM (SELECT doc_id, elem_no, string_split(text, chr(10)) AS l FROM {Q_ELEMENTS} WHERE type = 'table')))""",
    ("markdown",),
)
def table_cells(spark, sf_dir):
    return E.table_cells(E.elements(view(spark, sf_dir, "markdown")))


def q_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def q_table_html(x: str) -> str:
    cell = f"CASE WHEN i = 1 THEN '<th>' || {q_escape('v')} || '</th>' ELSE '<td>' || {q_escape('v')} || '</td>' END"
    row = f"'<tr>' || array_to_string(list_transform({q_cells('line')}, lambda v: {cell}), '') || '</tr>'"
    return f"'<table>' || chr(10) || array_to_string(list_transform(string_split({x}, chr(10)), lambda line, i: {row}), chr(10)) || chr(10) || '</table>'"


@query(f"SELECT doc_id, elem_no, {q_table_html('text')} AS html FROM {Q_ELEMENTS} WHERE type = 'table'", ("markdown",))
def table_html(spark, sf_dir):
    return E.elements(view(spark, sf_dir, "markdown")).where("type = 'table'").select("doc_id", "elem_no", T.table_html("text").alias("html"))


def q_table_mock(x: str) -> str:
    cell = f"CASE WHEN length({q_strip('v')}) >= 2 THEN '[TR] ' || v ELSE v END"
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda line: '| ' || array_to_string(list_transform({q_cells('line')}, lambda v: {cell}), ' | ') || ' |'), chr(10))"


@query(f"SELECT doc_id, elem_no, {q_table_mock('text')} AS translated FROM {Q_ELEMENTS} WHERE type = 'table'", ("markdown",))
def translate_table_mock(spark, sf_dir):
    return E.elements(view(spark, sf_dir, "markdown")).where("type = 'table'").select("doc_id", "elem_no", T.translated_table("text").alias("translated"))


@query(
    f"SELECT doc_id, elem_no, CASE WHEN type = 'table' THEN {q_table_mock('text')} WHEN length({q_strip('text')}) >= 2 THEN '[TR] ' || text ELSE text END AS translated FROM {Q_ELEMENTS}",
    ("markdown",),
)
def elements_translate_mock(spark, sf_dir):
    return E.translated_elements(E.elements(view(spark, sf_dir, "markdown"))).select("doc_id", "elem_no", "translated")


@query(
    f"""SELECT doc_id, string_agg(html, chr(10) ORDER BY elem_no) AS html FROM (SELECT doc_id, elem_no, CASE type WHEN 'table' THEN {q_table_html("text")}
WHEN 'heading' THEN '<h' || least(level, 6) || '>' || {q_escape("text")} || '</h' || least(level, 6) || '>' ELSE '<p>' || {q_escape("text")} || '</p>' END AS html FROM {Q_ELEMENTS} WHERE {q_strip("text")} <> '') GROUP BY doc_id""",
    ("markdown",),
)
def elements_html(spark, sf_dir):
    return E.elements_html(E.elements(view(spark, sf_dir, "markdown")))


@query(
    """SELECT doc_id, page FROM (SELECT doc_id, n, CASE WHEN n <= 4 THEN unnest(range(1, n + 1)) ELSE NULL END AS page FROM (SELECT doc_id, CAST(doc_id % 30 AS INT) AS n FROM documents) WHERE n BETWEEN 1 AND 4
UNION ALL SELECT doc_id, n, unnest([1, 3, n // 2, least(n, 20)]) FROM (SELECT doc_id, CAST(doc_id % 30 AS INT) AS n FROM documents) WHERE n > 4)"""
)
def page_sampling(spark, sf_dir):
    return metrics.sampled_pages(docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 30).cast("int").alias("n_pages"))).select("doc_id", F.col("page").cast("long").alias("page"))


def _images(spark, sf_dir):
    p = view(spark, sf_dir, "page_images")
    rect = lambda a, b: F.struct(F.lit(0.0).alias("x0"), a.cast("double").alias("y0"), F.col("width").alias("x1"), b.cast("double").alias("y1"))
    half = F.col("pct") * 842 / 200
    # two images that each cover half of the share
    return p.withColumn("images", F.when(F.col("pct") == 0, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")).otherwise(F.array(rect(F.lit(0.0), half), rect(half, half * 2))))


def q_scanned(large: str, chars: str) -> str:
    w = f"len({q_words('text')})"
    return f"""SELECT page_id, round(pct / 100.0, 6) AS coverage, CASE WHEN {large} AND {w} < 10 THEN 'large image, few words' WHEN pct > 70 AND {w} < 20 THEN 'images, few words'
WHEN pct > 90 THEN 'images' WHEN {chars} < 5 AND pct > 0 THEN 'image without text' END AS reason FROM page_images"""


@query(q_scanned("pct / 2 > 50", "length(text)"), ("page_images",))
def scanned_pages(spark, sf_dir):
    return layout.scanned(_images(spark, sf_dir)).select("page_id", rounded(F.col("coverage")).alias("coverage"), "reason")


@query(q_scanned("pct > 50", f"length({q_strip('text')})"), ("page_images",))
def scanned_pages_audit(spark, sf_dir):
    return layout.scanned(_images(spark, sf_dir), audit=True).select("page_id", rounded(F.col("coverage")).alias("coverage"), "reason")


def q_alignment(some: str, around: str, label: str) -> str:
    mode = "(SELECT page_id, {0} AS edge FROM (SELECT page_id, {0}, count(*) AS n, min(block_no * 100000 + line_no) AS seen FROM e GROUP BY page_id, {0}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, seen) = 1)"
    return f""", e AS (SELECT page_id, block_no, line_no, round_even(x0, 0) AS l, round_even(x1, 0) AS r FROM doc_lines WHERE {some}),
j AS (SELECT e.page_id, e.r, ml.edge AS lm, mr.edge AS rm, {around} AS mid FROM e JOIN {mode.format("l")} ml USING (page_id) JOIN {mode.format("r")} mr USING (page_id)),
s AS (SELECT page_id, lm, rm, sqrt(avg((r - mid) * (r - mid))) AS spread, count(*) AS n, count(*) FILTER (abs(r - rm) < 15) AS near FROM j GROUP BY page_id, lm, rm)
SELECT page_id, coalesce({label}, 'left') AS alignment, coalesce(lm, 0.0) AS left_margin, coalesce(rm, 595.0) AS right_margin FROM (SELECT DISTINCT page_id FROM doc_lines) LEFT JOIN s USING (page_id)"""


def _cte(views: list[str], rest: str) -> str:
    return with_views(views, "").rstrip() + rest


@query()
def page_alignment(spark, sf_dir):
    return layout.alignment(view(spark, sf_dir, "doc_lines"), 595)


ORACLES["page_alignment"] = _cte(
    ["doc_lines"],
    q_alignment(f"length({q_strip('text')}) >= 30", "avg(e.r) OVER (PARTITION BY e.page_id)", "CASE WHEN n >= 3 AND (spread < 10 OR (spread < 25 AND near > 0.6 * n)) THEN 'justify' ELSE 'left' END"),
)


@query()
def page_alignment_diagnostic(spark, sf_dir):
    return layout.alignment(view(spark, sf_dir, "doc_lines"), 595, diagnostic=True)


ORACLES["page_alignment_diagnostic"] = _cte(["doc_lines"], q_alignment("true", "mr.edge", "CASE WHEN spread < 10 THEN 'justify' WHEN spread < 30 THEN 'mixed' WHEN spread IS NOT NULL THEN 'left' END"))

Q_LEVELS = """(SELECT doc_id, size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS BIGINT) AS level FROM (
SELECT doc_id, size, arg_max(size, chars * 100 + size) OVER (PARTITION BY doc_id) AS body FROM (SELECT CAST(floor(page_id / 4) AS BIGINT) AS doc_id, CAST(round_even(size, 0) AS BIGINT) AS size, sum(length(text)) AS chars FROM doc_lines GROUP BY 1, 2)) WHERE size > body QUALIFY level <= 4)"""


def _book_lines(spark, sf_dir):
    """Lines of documents of four pages."""
    return view(spark, sf_dir, "doc_lines").withColumn("doc_id", F.floor(F.col("page_id") / 4))


@query(f"SELECT * FROM {Q_LEVELS}", ("doc_lines",))
def heading_levels(spark, sf_dir):
    return layout.heading_levels(_book_lines(spark, sf_dir))


Q_FLAGS = """(SELECT *, (flags & 16) <> 0 OR contains(lower(font), 'bold') AS bold, (flags & 2) <> 0 OR contains(lower(font), 'italic') AS italic,
(flags & 1) <> 0 OR (m > 0 AND size < 0.8 * m AND base > 0 AND origin_y > 0 AND origin_y < base - 0.3 * size) OR contains(lower(font), 'sup') AS superscript,
(m > 0 AND size < 0.8 * m AND base > 0 AND origin_y > 0 AND origin_y > base + 0.2 * size) OR (contains(lower(font), 'sub') AND NOT contains(lower(font), 'subhead')) AS subscript,
regexp_matches(font, '(?i)courier|mono|consolas|monaco|menlo|source code') AS mono, regexp_matches(font, '(?i)times|serif|georgia|garamond|palatino|cambria') AS serif FROM (
SELECT *, coalesce(avg(CASE WHEN size >= 0.8 * m THEN origin_y END) OVER l, avg(origin_y) OVER l) AS base FROM (
SELECT *, avg(size) OVER (PARTITION BY page_id, block_no, line_no) AS m FROM spans) WINDOW l AS (PARTITION BY page_id, block_no, line_no)))"""


@query(f"SELECT page_id, block_no, line_no, span_no, bold, italic, superscript, subscript, mono, serif FROM {Q_FLAGS}", ("spans",))
def span_flags(spark, sf_dir):
    return spans.flags(view(spark, sf_dir, "spans")).select(*spans.LINE, "span_no", "bold", "italic", "superscript", "subscript", "mono", "serif")


@query(
    f"""SELECT page_id, block_no, line_no, round(sum(size * n) / sum(n), 6) AS avg_size, 2 * coalesce(sum(n) FILTER (bold), 0) > sum(n) AS bold, 2 * coalesce(sum(n) FILTER (italic), 0) > sum(n) AS italic,
2 * coalesce(sum(n) FILTER (serif), 0) > sum(n) AS serif, bool_or(mono) AS mono, any_value(top) AS color FROM (SELECT *, length(text) AS n FROM {Q_FLAGS}) JOIN (
SELECT page_id, block_no, line_no, color AS top FROM (SELECT page_id, block_no, line_no, color, sum(length(text)) AS k, min(span_no) AS first FROM spans GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY page_id, block_no, line_no ORDER BY k DESC, first) = 1) USING (page_id, block_no, line_no) GROUP BY page_id, block_no, line_no""",
    ("spans",),
)
def line_style(spark, sf_dir):
    return spans.line_style(view(spark, sf_dir, "spans")).withColumn("avg_size", rounded(F.col("avg_size")))


@query(
    """SELECT page_id, block_no, line_no, string_agg(piece, '' ORDER BY span_no) AS text FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER w >= 0.3 * lag(size) OVER w THEN ' ' ELSE '' END || text AS piece FROM spans
WINDOW w AS (PARTITION BY page_id, block_no, line_no ORDER BY span_no)) GROUP BY page_id, block_no, line_no""",
    ("spans",),
)
def span_join(spark, sf_dir):
    return spans.joined(view(spark, sf_dir, "spans"))


Q_RUNS = f"""SELECT page_id, block_no, line_no, CAST(run_no AS BIGINT) AS run_no, bold, italic, string_agg(CASE WHEN NOT new AND wide THEN ' ' ELSE '' END || text, '' ORDER BY span_no) AS text, count(*) AS n_spans FROM (
SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY page_id, block_no, line_no ORDER BY span_no) - 1 AS run_no FROM (
SELECT *, lag(key) OVER w IS DISTINCT FROM key AS new, coalesce(x0 - lag(x1) OVER w >= 0.3 * lag(size) OVER w, false) AS wide FROM (
SELECT *, concat_ws('|', bold, italic, size, color, font[:10]) AS key FROM {Q_FLAGS}) WINDOW w AS (PARTITION BY page_id, block_no, line_no ORDER BY span_no))) GROUP BY ALL"""


@query(Q_RUNS, ("spans",))
def format_runs(spark, sf_dir):
    return spans.runs(view(spark, sf_dir, "spans"))


@query(
    "SELECT page_id, block_no, line_no, round(avg_size, 6) AS avg_size, round(coalesce(avg(origin_y) FILTER (size >= 0.8 * avg_size), avg(origin_y)), 6) AS baseline FROM (SELECT *, avg(size) OVER (PARTITION BY page_id, block_no, line_no) AS avg_size FROM spans) GROUP BY page_id, block_no, line_no, avg_size",
    ("spans",),
)
def line_means(spark, sf_dir):
    out = spans.line_means(view(spark, sf_dir, "spans"))
    return out.select(*spans.LINE, rounded(F.col("avg_size")).alias("avg_size"), rounded(F.col("baseline")).alias("baseline"))


def q_ends(x: str, marks: str, longer: int, capitals: int) -> str:
    last = rf"regexp_replace(regexp_extract({q_strip(x)}, '\S+$'), '[{marks}]+$', '')"
    return f"(regexp_matches({q_strip(x)}, '[{marks}]$') AND (length({last}) > {longer} OR (upper({last}) = {last} AND lower({last}) <> {last} AND length({last}) > {capitals})))"


@query(
    f""", h AS (SELECT d.*, coalesce(v.level, 0) AS level FROM doc_lines d LEFT JOIN {Q_LEVELS} v ON CAST(floor(d.page_id / 4) AS BIGINT) = v.doc_id AND CAST(round_even(d.size, 0) AS BIGINT) = v.size),
p AS (SELECT *, lag(text) OVER w AS pt, lag(y1) OVER w AS py, lag(size) OVER w AS ps, lag(level) OVER w AS pl, lag(bold) OVER w AS pb, lag(line_no) OVER w AS pn FROM h WINDOW w AS (PARTITION BY page_id, block_no ORDER BY line_no))
SELECT page_id, block_no, line_no, CAST(sum(CASE WHEN pn IS NULL THEN 0 WHEN ({q_ends("pt", ".!?:", 2, 0)} AND y0 - py > 0.8 * (ps + size) / 2) OR pl <> level OR (level = 0 AND pb <> bold) OR {q_kind("text")} IS NOT NULL OR y0 - py > 1.5 * (ps + size) / 2 THEN 1 ELSE 0 END)
OVER (PARTITION BY page_id, block_no ORDER BY line_no) AS BIGINT) AS group_no FROM p"""
)
def paragraph_groups(spark, sf_dir):
    lines = _book_lines(spark, sf_dir)
    return layout.paragraphs(layout.with_headings(lines, layout.heading_levels(lines))).select("page_id", "block_no", "line_no", "group_no")


ORACLES["paragraph_groups"] = _cte(["doc_lines"], ORACLES["paragraph_groups"])

_BLOCK_TEXT = "SELECT page_id, block_no, string_agg(text, ' ' ORDER BY line_no) AS text, first(size ORDER BY line_no) AS size, first(bold ORDER BY line_no) AS bold FROM doc_lines GROUP BY page_id, block_no"


def _page_blocks(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", "size", "bold")))
    first = lines.groupBy("page_id", "block_no").agg(ordered.alias("l"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), " ")
    return first.select("page_id", "block_no", text.alias("text"), F.col("l")[0]["size"].alias("size"), F.col("l")[0]["bold"].alias("bold"), "x0", "y0", "x1", "y1", F.lit(842.0).alias("height"))


_META = "|".join(config.METADATA)


def q_title(x: str) -> str:
    t, cased = q_strip(x), r"\p{Lu}\p{Ll}\p{Lt}"
    title = rf"(regexp_matches({t}, '\p{{Lu}}|\p{{Lt}}') AND NOT regexp_matches({t}, '(^|[^{cased}])\p{{Ll}}|[{cased}][\p{{Lu}}\p{{Lt}}]'))"
    capitals = rf"(regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '\p{{Ll}}|\p{{Lt}}'))"
    return f"({t} <> '' AND length({t}) < 50 AND len({q_words(x)}) <= 8 AND right({t}, 1) NOT IN ('.', ',', ';', ':') AND ({title} OR {capitals}))"


@query(
    rf""", b AS (SELECT * FROM ({_BLOCK_TEXT}) JOIN page_blocks USING (page_id, block_no)),
p AS (SELECT *, lag(text) OVER w AS pt, lag(y1) OVER w AS py1, lag(y0) OVER w AS py0, lag(size) OVER w AS ps, lag(bold) OVER w AS pb, lag(block_no) OVER w AS pn, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1 FROM b WINDOW w AS (PARTITION BY page_id ORDER BY block_no))
SELECT page_id, block_no, CAST(sum(CASE WHEN pn IS NULL THEN 0 WHEN {q_ends("pt", ".!?", 3, 1)} OR ((regexp_matches(lower(rtrim(pt)), '{_META}') OR regexp_matches(rtrim(pt), '\b(19|20)\d{{2}}\b\s*$')) AND length(rtrim(pt)) < 60)
OR size / ps > 1.15 OR size / ps < 0.85 OR pb <> bold OR {q_kind("text")} IS NOT NULL OR y0 - py1 > ps + size OR {q_title("text")}
OR (coalesce(try_cast(nullif(regexp_extract({q_strip("text")}, '^(\d{{1,2}})\s', 1), '') AS INT), 0) BETWEEN 1 AND 99 AND (size < 9.5 OR y0 > 0.70 * 842))
OR ((y0 < 0.08 * 842) <> (py1 < 0.08 * 842)) OR ((y0 > 0.92 * 842) <> (py0 > 0.92 * 842))
OR greatest(0, least(x1, px1) - greatest(x0, px0)) / greatest(1, least(x1 - x0, px1 - px0)) < 0.30 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY block_no) AS BIGINT) AS group_no FROM p"""
)
def block_groups(spark, sf_dir):
    found = _page_blocks(spark, sf_dir).withColumn("title", T.title_like("text"))
    return layout.blocks(found, titles="title").select("page_id", "block_no", "group_no")


ORACLES["block_groups"] = _cte(["doc_lines", "page_blocks"], ORACLES["block_groups"])


@query("SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM doc_lines GROUP BY page_id", ("doc_lines",))
def bbox_union(spark, sf_dir):
    return layout.bbox(view(spark, sf_dir, "doc_lines"), ["page_id"])


def q_metrics(tolerance: int) -> str:
    return f"""(SELECT page_id, count(*) AS n_lines, CAST(sum(len({q_words("text")})) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(size) AS min_font, max(size) AS max_font,
count(*) FILTER (size < 7) AS under_7, count(*) FILTER (py > 0 AND y0 < py - {tolerance}) AS "overlaps" FROM (SELECT *, lag(y1) OVER (PARTITION BY page_id, block_no ORDER BY line_no) AS py FROM doc_lines) GROUP BY page_id)"""


@query(f"SELECT * FROM {q_metrics(0)}", ("doc_lines",))
def page_overlap_tol0(spark, sf_dir):
    return metrics.page_metrics(view(spark, sf_dir, "doc_lines"), 0)


@query(f"SELECT * FROM {q_metrics(1)}", ("doc_lines",))
def page_overlap_tol1(spark, sf_dir):
    return metrics.page_metrics(view(spark, sf_dir, "doc_lines"), 1)


@query(
    f"""SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS pages, round(avg(o), 6) AS mean_overlap, round(avg(u), 6) AS mean_small, round(sum(s) / sum(n), 6) AS seconds_per_page, count(*) FILTER (o < 10) AS docs_ok FROM (
SELECT page_id % 50 AS doc, avg(100.0 * "overlaps" / n_lines) AS o, avg(100.0 * under_7 / n_lines) AS u, sum(CAST(page_id % 7 AS DOUBLE)) AS s, count(*) AS n FROM {q_metrics(1)} GROUP BY 1)""",
    ("doc_lines",),
)
def corpus_summary(spark, sf_dir):
    pages = metrics.page_metrics(view(spark, sf_dir, "doc_lines"), 1).withColumns({"doc": F.col("page_id") % 50, "seconds": (F.col("page_id") % 7).cast("double")})
    out = metrics.corpus_summary(pages)
    return out.select("docs", "pages", "docs_ok", *[rounded(F.col(c)).alias(c) for c in ("mean_overlap", "mean_small", "seconds_per_page")])


@query(
    """SELECT *, CASE WHEN recall >= 0.9 THEN 'good' WHEN recall >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (hit) AS found,
coalesce(string_agg(keyword, ';' ORDER BY keyword) FILTER (NOT hit), '') AS missing, round(CAST(count(*) FILTER (hit) AS DOUBLE) / count(*), 6) AS recall
FROM (SELECT doc_id, keyword, contains(lower(text), lower(keyword)) AS hit FROM documents, (SELECT unnest([{}]) AS keyword)) GROUP BY doc_id)""".format(", ".join(f"'{k}'" for k in KEYWORDS)),
)
def keyword_recall(spark, sf_dir):
    return metrics.keyword_recall(docs(spark, sf_dir), KEYWORDS).withColumn("recall", rounded(F.col("recall")))


@query(
    """SELECT page_id, bool_and(c > 0.15 AND c < 0.85) AND avg(c) BETWEEN 0.40 AND 0.60 AS centered, count(*) <= 8 AND sum(y1 - y0) < 0.30 * 842 AS sparse, min(y0) AS y_min, max(y1) AS y_max, round(avg(c), 6) AS avg_center
FROM (SELECT *, (x0 + x1) / 2 / width AS c FROM layout_blocks WHERE type IN ('text', 'title', 'paragraph_title', 'list')) GROUP BY page_id""",
    ("layout_blocks",),
)
def layout_hints(spark, sf_dir):
    return layout.hints(view(spark, sf_dir, "layout_blocks")).withColumn("avg_center", rounded(F.col("avg_center")))


Q_NARROW = """(SELECT * FROM (SELECT * FROM (SELECT * FROM layout_blocks WHERE type IN ('text', 'title', 'paragraph_title', 'list') QUALIFY count(*) OVER (PARTITION BY page_id) >= 3) WHERE x1 - x0 < 0.7 * width)
QUALIFY count(*) OVER (PARTITION BY page_id) >= 3)"""
Q_NUMBERED = "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY c0) - 1 AS BIGINT) AS col_no, c0 AS x0, c1 AS x1 FROM (SELECT * FROM {} QUALIFY count(*) OVER (PARTITION BY page_id) BETWEEN 2 AND 6)"
Q_GAPS = Q_NUMBERED.format(
    f"""(SELECT page_id, c0, c1 FROM (SELECT r.page_id, r.width, c0, c1, count(*) FILTER (m BETWEEN c0 - 5 AND c1 + 5) AS n FROM (
SELECT page_id, width, min(bin) * 5.0::DOUBLE AS c0, (max(bin) + 1) * 5.0::DOUBLE AS c1 FROM (SELECT *, sum(CASE WHEN bin - pb - 1 >= greatest(2, floor(greatest(0.02 * width, 15) / 5)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY bin) AS island FROM (
SELECT *, lag(bin) OVER (PARTITION BY page_id ORDER BY bin) AS pb FROM (SELECT DISTINCT page_id, width, unnest(range(CAST(greatest(0, floor(x0 / 5)) AS BIGINT), CAST(least(floor(width / 5) + 1, floor(x1 / 5)) AS BIGINT) + 1)) AS bin FROM {Q_NARROW}))) GROUP BY page_id, width, island) r
JOIN (SELECT page_id, (x0 + x1) / 2 AS m FROM {Q_NARROW}) b USING (page_id) GROUP BY r.page_id, r.width, c0, c1) WHERE n >= 2 OR (n >= 1 AND (c1 - c0) / width >= 0.25))"""
)


@query(Q_GAPS, ("layout_blocks",))
def columns_gap(spark, sf_dir):
    return layout.columns_by_gap(view(spark, sf_dir, "layout_blocks"))


@query(
    Q_NUMBERED.format(
        f"""(SELECT page_id, c0, c1 FROM (SELECT *, bool_or(coalesce(clash, false)) OVER (PARTITION BY page_id) AS any_clash FROM (SELECT *, lag(c1) OVER w - c0 > 0.15 * least(lag(c1 - c0) OVER w, c1 - c0) AS clash FROM (
SELECT page_id, width, cluster, count(*) AS n, min(x0) AS c0, max(x1) AS c1 FROM (SELECT *, max(cluster) OVER (PARTITION BY page_id) + 1 AS k FROM (SELECT *, sum(CASE WHEN m - pm > greatest(0.08 * width, 50) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY m, x0, x1) AS cluster FROM (
SELECT *, lag(m) OVER (PARTITION BY page_id ORDER BY m, x0, x1) AS pm FROM (SELECT *, (x0 + x1) / 2 AS m FROM {Q_NARROW})))) WHERE k BETWEEN 2 AND 6 GROUP BY page_id, width, cluster)
WHERE n >= 2 AND c1 - c0 >= 0.08 * width WINDOW w AS (PARTITION BY page_id ORDER BY cluster))) WHERE NOT any_clash)"""
    ),
    ("layout_blocks",),
)
def columns_center(spark, sf_dir):
    return layout.columns_by_center(view(spark, sf_dir, "layout_blocks"))


_BOXES = "SELECT page_id, blk_no AS box_no, x0 + 11 * blk_no AS x0, x1 + 11 * blk_no AS x1 FROM layout_blocks"


@query(
    f"""SELECT page_id, box_no, x.x0, x.x1, coalesce(arg_max(col_no, greatest(0, least(x.x1, c.x1) - greatest(x.x0, c.x0)) * 100 - col_no), 0) AS col_no FROM ({_BOXES}) x LEFT JOIN ({Q_GAPS}) c USING (page_id) GROUP BY page_id, box_no, x.x0, x.x1""",
    ("layout_blocks",),
)
def assign_column(spark, sf_dir):
    found = view(spark, sf_dir, "layout_blocks")
    boxes = found.select("page_id", F.col("blk_no").alias("box_no"), (F.col("x0") + 11 * F.col("blk_no")).alias("x0"), (F.col("x1") + 11 * F.col("blk_no")).alias("x1"))
    return layout.assigned(boxes, layout.columns_by_gap(found))


_TABLES = "SELECT page_id, CAST(100 AS DOUBLE) AS x0, CAST(80 AS DOUBLE) AS y0, CAST(400 AS DOUBLE) AS x1, CAST(160 + page_id % 3 * 40 AS DOUBLE) AS y1 FROM layout_blocks WHERE blk_no = 0"


@query(
    f"""SELECT page_id, blk_no FROM layout_blocks b WHERE NOT EXISTS (SELECT 1 FROM ({_TABLES}) t WHERE t.page_id = b.page_id AND least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0)
AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))""",
    ("layout_blocks",),
)
def table_block_exclusion(spark, sf_dir):
    found = view(spark, sf_dir, "layout_blocks")
    return layout.without_tables(found, spark.sql(_TABLES.replace("FROM layout_blocks", "FROM {found}"), found=found)).select("page_id", "blk_no")


def _after(lines: DataFrame) -> DataFrame:
    return lines.where("line_no % 5 <> 4").withColumn("y0", F.col("y0") * (1 + F.col("page_id") % 4 / 8)).withColumn("text", T.translated(F.col("text")))


_AFTER = "(SELECT page_id, block_no, line_no, '[TR] ' || text AS text, size, y0 * (1 + page_id % 4 / 8.0::DOUBLE) AS y0 FROM doc_lines WHERE line_no % 5 <> 4)"


@query(
    f"""SELECT page_id, round(CASE WHEN b = 0 THEN 0 ELSE a / b END, 6) AS ratio, CASE WHEN b = 0 THEN 0 ELSE a / b END BETWEEN 0.8 AND 1.3 AS ok FROM (SELECT page_id, max(y0) - min(y0) AS b FROM doc_lines WHERE {q_strip("text")} <> '' GROUP BY page_id)
JOIN (SELECT page_id, max(y0) - min(y0) AS a FROM {_AFTER} WHERE {q_strip("text")} <> '' GROUP BY page_id) USING (page_id)""",
    ("doc_lines",),
)
def yspan_ratio(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    return metrics.preserved(lines, _after(lines)).select("page_id", rounded(F.col("ratio")).alias("ratio"), "ok")


@query(
    f"""SELECT *, round_even({q_ratio("new_chars", "old_chars")}, 2) AS chars_ratio, round_even({q_ratio("new_y_span", "old_y_span")}, 2) AS y_span_ratio, round_even({q_ratio("new_size", "old_size")}, 2) AS size_ratio, page_id % 5 - page_id % 3 AS links_lost FROM (
SELECT page_id, count(DISTINCT block_no) AS old_blocks, count(*) AS old_lines, CAST(sum(length(text)) AS BIGINT) AS old_chars, round_even(avg(size), 1) AS old_size, round_even(max(y0) - min(y0), 1) AS old_y_span FROM doc_lines GROUP BY page_id)
FULL JOIN (SELECT page_id, count(DISTINCT block_no) AS new_blocks, count(*) AS new_lines, CAST(sum(length(text)) AS BIGINT) AS new_chars, round_even(avg(size), 1) AS new_size, round_even(max(y0) - min(y0), 1) AS new_y_span FROM {_AFTER} GROUP BY page_id) USING (page_id)""",
    ("doc_lines",),
)
def before_after(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    media = docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % 5).alias("links_before"), (F.col("doc_id") % 3).alias("links_after"))
    return metrics.compared(lines, _after(lines), media)


@query(
    f"""SELECT doc_id, line_no, concat_ws(',', CASE WHEN len({q_words("text")}) < 5 AND length({q_strip("text")}) > 20 THEN 'LOW_WORDS' END, CASE WHEN length({q_strip("text")}) = 0 THEN 'NO_CONTENT' END,
CASE WHEN length({q_strip("text")}) < 20 THEN 'EMPTY' END, CASE WHEN {q_count("text", _CJK)} > 5 THEN 'CJK' END) AS flags FROM decorated""",
    ("decorated",),
)
def audit_flags(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", metrics.audit_flags(F.col("text")).alias("flags"))


@query(
    """SELECT page_id, CASE WHEN marks = 0 THEN 'none' WHEN marks < calls THEN 'incomplete' ELSE 'complete' END AS state FROM (SELECT page_id, count(*) AS calls,
len(regexp_extract_all(string_agg(CASE WHEN page_id % 3 = 0 OR (page_id % 3 = 1 AND line_no % 2 = 0) THEN '[TR] ' ELSE '' END || text, chr(10)), '\\[TR\\] ')) AS marks FROM doc_lines GROUP BY page_id)""".replace("\\\\", "\\"),
    ("doc_lines",),
)
def translation_completeness(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    marked = (F.col("page_id") % 3 == 0) | ((F.col("page_id") % 3 == 1) & (F.col("line_no") % 2 == 0))
    out = lines.withColumn("t", F.when(marked, T.translated(F.col("text"))).otherwise(F.col("text")))
    out = out.groupBy("page_id").agg(F.array_join(F.collect_list("t"), "\n").alias("t"), F.count("*").alias("calls"))
    return out.select("page_id", metrics.completeness(F.col("t"), F.col("calls")).alias("state"))


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 0")
def pending_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return metrics.pending(pages, pages.where("page_id % 3 = 0").select("page_id")).select("page_id", "url")


@query("SELECT doc_id, CAST((round_even(degrees(atan2(-sin(radians(a)), cos(radians(a)))) / 90, 0) * 90 + 360) AS INT) % 360 AS rotation FROM (SELECT doc_id, CAST(doc_id % 8 * 50 AS DOUBLE) AS a FROM documents)")
def rotation(spark, sf_dir):
    a = F.radians((F.col("doc_id") % 8 * 50).cast("double"))
    return docs(spark, sf_dir).select("doc_id", spans.rotation(F.cos(a), F.sin(a)).alias("rotation"))


@query("SELECT page_id, round(avg(score), 6) AS confidence, count(*) AS boxes FROM boxes GROUP BY page_id", ("boxes",))
def mean_confidence(spark, sf_dir):
    return metrics.mean_confidence(view(spark, sf_dir, "boxes")).withColumn("confidence", rounded(F.col("confidence")))


@query('SELECT page_id, l AS "left", r AS "right", l > 3 AND r > 3 AS two_columns FROM (SELECT page_id, count(*) FILTER (x1 < 297.5) AS l, count(*) FILTER (x0 > 297.5) AS r FROM doc_lines GROUP BY page_id)', ("doc_lines",))
def column_sides(spark, sf_dir):
    return metrics.column_sides(view(spark, sf_dir, "doc_lines"), F.lit(297.5))


_CANDIDATES = "SELECT page_id, m AS method_ord, 'm' || m AS method, CASE WHEN m = 0 AND page_id % 4 = 0 THEN '' WHEN m = 0 AND page_id % 4 = 1 THEN 'x y z # # # $ $ % a b c' ELSE text END AS text, CASE WHEN page_id % 5 = 0 THEN concat(text, ' and more of it') END AS ocr FROM (SELECT doc_id AS page_id, text FROM documents) l CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1) k"


@query()
def chosen_text(spark, sf_dir):
    pages = docs(spark, sf_dir)
    return metrics.chosen_text(spark.sql(_CANDIDATES.replace("FROM documents", "FROM {pages}").replace("AS ocr FROM", "AS ocr_text FROM"), pages=pages))


def _q_score_of(c: str) -> str:
    return Q_SCORE.replace("text", c)


ORACLES["chosen_text"] = (
    f"""WITH c AS (SELECT *, {Q_SCORE} AS q, len({q_words("text")}) AS n, length({q_strip("text")}) > 10 AS u FROM ({_CANDIDATES})),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY u DESC, CASE WHEN u AND q > 0.8 THEN method_ord ELSE 1000000 END, q DESC, method_ord) = 1),
d AS (SELECT *, CASE WHEN u AND (q > 0.8 OR (q >= 0.5 AND n >= 15)) THEN method WHEN ocr IS NOT NULL AND (({_q_score_of("ocr")}) > CASE WHEN u THEN q ELSE 0 END OR len({q_words("ocr")}) > 1.5 * CASE WHEN u THEN n ELSE 0 END) THEN 'ocr' WHEN u THEN method ELSE 'none' END AS chosen FROM b)
SELECT page_id, chosen AS method, CASE chosen WHEN 'ocr' THEN ocr WHEN 'none' THEN '[no text]' ELSE text END AS text FROM d"""
)

# without SQL: folds, Unicode tables, Python's notion of title case


def q_post(source: str) -> str:
    """CTEs from a table of (id, text), cleaned, to posted(id, text): line repair, artifacts and white space.

    A line takes the next one's first word if it ends in a hyphen, unless it was itself taken whole: in a run of hyphenated lines of one word every other one takes.
    """
    q, spaced = q_strip, r"replace(regexp_replace(p, '[ \t]+', ' ', 'g'), chr(10), ' ')"
    taken = r"CASE WHEN takes THEN own[:-2] || regexp_extract(follow, '^\S+') ELSE own END"
    return rf""", l0 AS (SELECT id, n, {q("x")} AS t FROM (SELECT id, unnest(range(len(l))) AS n, unnest(l) AS x FROM (SELECT id, string_split(text, chr(10)) AS l FROM {source}))),
l1 AS (SELECT *, ends_with(t, '-') AND coalesce(lead(t) OVER w, '') <> '' AS c, regexp_matches(t, '^\S+$') AS one, lead(t) OVER w AS follow FROM l0 WINDOW w AS (PARTITION BY id ORDER BY n)),
l2 AS (SELECT *, max(CASE WHEN NOT (one AND c) THEN n END) OVER b AS j, last_value(CASE WHEN NOT (one AND c) THEN c AND NOT one END IGNORE NULLS) OVER b AS aj FROM l1 WINDOW b AS (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT *, CASE WHEN one AND c THEN ((n - coalesce(j, -1)) % 2 = 1) <> coalesce(aj, false) ELSE c END AS takes FROM l2),
l4 AS (SELECT *, CASE WHEN lag(takes) OVER (PARTITION BY id ORDER BY n) THEN regexp_replace(t, '^\S+\s*', '') ELSE t END AS own FROM l3),
l5 AS (SELECT id, n, {q(taken)} AS t FROM l4),
l6 AS (SELECT id, coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (t = '' OR NOT (regexp_matches(t, '^\p{{Nd}}+$') OR (length(t) < 3 AND NOT regexp_matches(t, '^\p{{L}}+$')) OR regexp_matches(t, '^[^\p{{L}}\p{{N}}_]+$'))), '') AS text FROM l5 GROUP BY id),
posted AS (SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: {q(spaced)}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM l6)"""


def q_cleaned(x: str) -> str:
    """The rules of OCR output, written out for DuckDB."""
    rules = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), (r"([A-Za-z])0([a-z])", r"\1o\2"), (r"([a-z])1([a-z])", r"\1l\2"), (r"\b5([a-z]{3})", r"S\1"), (r"([a-z]{3})([A-Z][a-z]{2})", r"\1 \2")]
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def q_mapped(x: str, old: str, new: str) -> str:
    quoted = new.replace("'", "''")
    return f"translate({x}, '{old}', '{quoted}')"


#: Characters that the two normalizations map, written out, and what they become.
Q_MT = ("“”‘’„‟«»‹›–—−", "\"\"''\"\"\"\"''---")
Q_PAGE = ("“”‘’«»„‚–—‒―−", "\"\"''\"\"\"'-----")
# some lines of a document end in a hyphen, and some are one hyphenated word
_BROKEN = "CASE line_no % 4 WHEN 0 THEN concat(text, '-') WHEN 1 THEN text WHEN 2 THEN 'sole-' ELSE CASE doc_id % 3 WHEN 0 THEN 'word-' WHEN 1 THEN '12' ELSE text END END"


@query()
def post_process_ocr(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.expr(_BROKEN).alias("t")))), lambda x: x["t"])
    pages = view(spark, sf_dir, "decorated").groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))
    return pages.select("doc_id", folds.post_processed("text").alias("text"))


ORACLES["post_process_ocr"] = _cte(
    ["decorated"],
    f""", raw AS (SELECT doc_id AS id, string_agg({_BROKEN}, chr(10) ORDER BY line_no) AS text FROM decorated GROUP BY doc_id), cleaned AS (SELECT id, {q_tidy(q_cleaned("text"))} AS text FROM raw){q_post("cleaned")}
SELECT id AS doc_id, text FROM posted""",
)


@query(
    f"""SELECT doc_id, CAST(i AS INT) AS line, CASE WHEN len(l) > 5 THEN array_to_string(l[CAST(round_even(i * (len(l) / 5.0::DOUBLE), 0) AS INT) + 1 : CASE WHEN i = 4 THEN len(l) ELSE CAST(round_even((i + 1) * (len(l) / 5.0::DOUBLE), 0) AS INT) END], ' ')
WHEN len(l) = 5 THEN l[i + 1] WHEN len(w) <= 5 THEN coalesce(w[i + 1], '') ELSE array_to_string(w[i * (len(w) // 5) + least(i, len(w) % 5) + 1 : (i + 1) * (len(w) // 5) + least(i + 1, len(w) % 5)], ' ') END AS text
FROM (SELECT doc_id, l, {q_words("array_to_string(l, ' ')")} AS w FROM (SELECT doc_id, list(sentence ORDER BY sent_no) AS l FROM {Q_SENTENCES} GROUP BY doc_id)), (SELECT unnest(range(5)) AS i)"""
)
def align_sentences(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", sentence_list("text").alias("sentences")).where(F.size("sentences") > 0)
    return found.select("doc_id", F.posexplode(folds.align_sentences("sentences", F.lit(5))).alias("line", "text"))


# rows of boxes lie 20 points apart here and vary by 2, so a row is a multiple of 20; the rules of columns and of order are those of any page
_COLUMNS = """, bx AS (SELECT *, (y_min + y_max) / 2 AS y, CAST(floor((y_min - 100) / 20) AS BIGINT) AS row, avg(y_max - y_min) OVER (PARTITION BY page_id) AS tall, count(*) OVER (PARTITION BY page_id) AS n FROM boxes),
pg AS (SELECT page_id, any_value(width) AS width, any_value(tall) AS tall, any_value(n) AS n, count(*) FILTER (k >= 2) AS several, count(*) AS rows_ FROM (SELECT page_id, row, any_value(width) AS width, any_value(tall) AS tall, any_value(n) AS n, count(*) AS k FROM bx GROUP BY ALL) GROUP BY page_id),
gaps AS (SELECT page_id, least(199, greatest(0, CAST(trunc((x_max + follow) / 2 / (width / 200)) AS INT))) AS slot FROM (SELECT *, lead(x_min) OVER (PARTITION BY page_id, row ORDER BY x_min, box_no) AS follow FROM bx) WHERE follow - x_max >= 1.5 * tall),
smooth AS (SELECT page_id, s, count(*) AS k FROM (SELECT page_id, unnest(range(slot - 2, slot + 3)) AS s FROM gaps) WHERE s BETWEEN 0 AND 199 GROUP BY ALL),
peak AS (SELECT page_id, s, sum(CASE WHEN s - before > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY s) AS island FROM (SELECT page_id, s, lag(s) OVER (PARTITION BY page_id ORDER BY s) AS before FROM smooth JOIN pg USING (page_id) WHERE k >= greatest(3, floor(0.25 * several)) AND rows_ >= 3 AND several >= 3)),
edge AS (SELECT page_id, x FROM (SELECT page_id, (min(s) + max(s)) / 2.0::DOUBLE * (any_value(width) / 200) AS x, any_value(width) AS width FROM peak JOIN pg USING (page_id) GROUP BY page_id, island) WHERE x > 0.05 * width AND x < 0.95 * width UNION ALL SELECT page_id, 0 FROM pg UNION ALL SELECT page_id, width FROM pg),
piece AS (SELECT page_id, a, b, sum(CASE WHEN a = 0 OR b - a >= 0.08 * width THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY a) AS island FROM (SELECT page_id, x AS a, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS b FROM edge) JOIN pg USING (page_id) WHERE b IS NOT NULL),
merged AS (SELECT page_id, min(a) AS a, max(b) AS b FROM piece GROUP BY page_id, island),
held AS (SELECT m.page_id, a, b FROM merged m JOIN pg USING (page_id) JOIN bx ON bx.page_id = m.page_id AND x_min >= a - bx.tall AND x_max <= b + bx.tall GROUP BY m.page_id, a, b HAVING count(*) >= greatest(3, 0.05 * any_value(pg.n))),
several_ AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS k FROM held),
cols AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a) - 1 AS col_no, a AS x0, b AS x1 FROM several_ WHERE k > 1
UNION ALL SELECT page_id, 0, 0.0, width FROM pg WHERE page_id NOT IN (SELECT page_id FROM several_ WHERE k > 1))"""


@query()
def reading_order(spark, sf_dir):
    return folds.reading_order(view(spark, sf_dir, "boxes"))


# no box is wide enough here to stand across columns
ORACLES["reading_order"] = _cte(
    ["boxes"],
    f"""{_COLUMNS}, home AS (SELECT bx.page_id, box_no, row, y, x_min, txt, any_value(bx.tall) AS tall, arg_max(col_no, greatest(0, least(x_max, x1) - greatest(x_min, x0)) * 1000 - col_no) AS col FROM bx JOIN cols USING (page_id) GROUP BY ALL),
line AS (SELECT page_id, col, row, min(y) AS y, any_value(tall) AS tall, string_agg(txt, ' ' ORDER BY x_min, box_no) AS t FROM home GROUP BY page_id, col, row),
spaced AS (SELECT page_id, col, row, CASE WHEN y - lag(y) OVER (PARTITION BY page_id, col ORDER BY row) > 1.5 * tall THEN chr(10) || t ELSE t END AS t FROM line)
SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY col) AS text FROM (SELECT page_id, col, string_agg(t, chr(10) ORDER BY row) AS t FROM spaced GROUP BY page_id, col) GROUP BY page_id""",
)


@query()
def columns_ocr_gap(spark, sf_dir):
    return folds.columns_by_ocr_gaps(view(spark, sf_dir, "boxes"))


ORACLES["columns_ocr_gap"] = _cte(["boxes"], f"{_COLUMNS} SELECT * FROM cols")


@query("SELECT page_id, box_no, dense_rank() OVER (PARTITION BY page_id ORDER BY floor((y_min - 100) / 20)) - 1 AS row FROM boxes", ("boxes",))
def anchored_rows(spark, sf_dir):
    return folds.anchored_rows(view(spark, sf_dir, "boxes"))


def _segments(spark, sf_dir):
    found = spans.merged_runs(spans.runs(view(spark, sf_dir, "spans")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "text", "bold", "italic"))), lambda x: F.struct(x["text"].alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic")))
    lines = found.groupBy(*spans.LINE).agg(ordered.alias("segments"))
    return lines.withColumn("translated", T.translated(F.array_join(F.transform("segments", lambda s: s["text"]), " ")))


_LINE = "page_id, block_no, line_no"
# segments of each line: neighbouring runs of equal bold and italic; the line's translation, and its words
_SEGMENTED = f""", g AS (SELECT {_LINE}, part AS k, bold, italic, string_agg(text, ' ' ORDER BY run_no) AS text FROM (
SELECT *, sum(CAST(step AS BIGINT)) OVER (PARTITION BY {_LINE} ORDER BY run_no) - 1 AS part FROM (SELECT *, lag(bold::INT * 2 + italic::INT) OVER (PARTITION BY {_LINE} ORDER BY run_no) IS DISTINCT FROM bold::INT * 2 + italic::INT AS step FROM ({Q_RUNS}))) GROUP BY ALL),
t AS (SELECT {_LINE}, '[TR] ' || string_agg(text, ' ' ORDER BY k) AS translated, count(*) AS m, bool_or(bold OR italic) AS styled FROM g GROUP BY ALL),
tw AS (SELECT *, {q_words("translated")} AS w FROM t)"""


def q_tagged(x: str, bold: str = "bold", italic: str = "italic") -> str:
    return f"concat(CASE WHEN {bold} THEN '<b>' ELSE '' END, CASE WHEN {italic} THEN '<i>' ELSE '' END, {q_escape(x)}, CASE WHEN {italic} THEN '</i>' ELSE '' END, CASE WHEN {bold} THEN '</b>' ELSE '' END)"


# words for each segment in turn: its share, one at least while the later ones keep one, the rest for the last
_SHARED = f""", n AS (SELECT g.*, len({q_words("text")}) AS n, sum(len({q_words("text")})) OVER (PARTITION BY {_LINE}) AS whole, m, len(w) AS total, w FROM g JOIN tw USING ({_LINE})),
p AS (SELECT *, 0 AS given, CASE WHEN m = 1 THEN total ELSE least(greatest(1, CAST(round_even(CAST(n AS DOUBLE) / whole * total, 0) AS INT)), total - (m - 1)) END AS size FROM n WHERE k = 0
UNION ALL SELECT n.*, p.given + p.size, CASE WHEN n.k = n.m - 1 THEN n.total - p.given - p.size ELSE least(greatest(1, CAST(round_even(CAST(n.n AS DOUBLE) / n.whole * n.total, 0) AS INT)), n.total - p.given - p.size - (n.m - n.k - 1)) END FROM p JOIN n USING ({_LINE}) WHERE n.k = p.k + 1),
proportional AS (SELECT {_LINE}, string_agg({q_tagged("array_to_string(w[CAST(given + 1 AS INT) : CAST(given + size AS INT)], ' ')")}, ' ' ORDER BY k) AS html FROM p GROUP BY {_LINE})"""
# the first similar word that is still free for each short bold or italic segment in turn
_SIMILAR = "NOT list_contains(places, i) AND want <> '' AND bare[i + 1] <> '' AND (starts_with(bare[i + 1], want[:4]) OR contains(bare[i + 1], want) OR contains(want, bare[i + 1]))"
_MATCHED = f""", q AS (SELECT {_LINE}, row_number() OVER (PARTITION BY {_LINE} ORDER BY k) AS j, lower({q_strip("text")}) AS want, bold, italic FROM g WHERE (bold OR italic) AND len({q_words("text")}) <= 3),
b AS (SELECT {_LINE}, w, list_transform(w, lambda x: trim(lower(x), '.,;:!?"''()-')) AS bare FROM tw),
f AS (SELECT {_LINE}, 0::BIGINT AS j, []::BIGINT[] AS places, []::BIGINT[] AS styles FROM b
UNION ALL SELECT {_LINE}, j, CASE WHEN place IS NULL THEN places ELSE list_append(places, place) END, CASE WHEN place IS NULL THEN styles ELSE list_append(styles, style) END FROM (
SELECT {_LINE}, q.j, places, styles, q.bold::BIGINT * 2 + q.italic::BIGINT AS style, list_filter(range(len(bare)), lambda i: {_SIMILAR})[1] AS place FROM f JOIN q USING ({_LINE}) JOIN b USING ({_LINE}) WHERE q.j = f.j + 1)),
last AS (SELECT {_LINE}, arg_max(places, j) AS places, arg_max(styles, j) AS styles FROM f GROUP BY {_LINE}),
wd AS (SELECT {_LINE}, w, unnest(range(len(w))) AS i, places, styles FROM last JOIN b USING ({_LINE})),
keyword AS (SELECT {_LINE}, CASE WHEN any_value(len(places)) > 0 THEN string_agg({q_tagged("w[i + 1]", "style >= 2", "style % 2 = 1")}, ' ' ORDER BY i) END AS html FROM (
SELECT *, coalesce(styles[list_position(places, i)], 0) AS style FROM wd) GROUP BY {_LINE})"""


@query()
def keyword_format_map(spark, sf_dir):
    return _segments(spark, sf_dir).select(*spans.LINE, folds.keyword_format_map("segments", "translated").alias("html"))


@query()
def proportional_map(spark, sf_dir):
    return _segments(spark, sf_dir).select(*spans.LINE, folds.proportional_format_map("segments", "translated").alias("html"))


@query()
def format_map(spark, sf_dir):
    return _segments(spark, sf_dir).select(*spans.LINE, folds.format_map("segments", "translated").alias("html"))


def _recursive(rest: str) -> str:
    return _cte(["spans"], _SEGMENTED + rest).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["keyword_format_map"] = _recursive(f"{_MATCHED} SELECT * FROM keyword")
ORACLES["proportional_map"] = _recursive(f"{_SHARED} SELECT * FROM proportional")
ORACLES["format_map"] = _recursive(
    f"{_MATCHED}{_SHARED} SELECT {_LINE}, CASE WHEN NOT styled THEN translated WHEN m = 1 THEN {q_tagged('translated', 'one.bold', 'one.italic')} ELSE coalesce(k.html, p.html) END AS html FROM t JOIN (SELECT {_LINE}, bold, italic FROM g WHERE k = 0) one USING ({_LINE}) JOIN keyword k USING ({_LINE}) JOIN proportional p USING ({_LINE})"
)


# the documents hold no character that NFKC changes; those put before them do
@query("SELECT doc_id, concat('fi 1⁄2 \"a\" - ', {}) AS text FROM documents".format(q_mapped("text", *Q_MT)))
def nfkc_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", folds.normalized_for_translation(F.concat(F.lit("ﬁ ½ “a” – "), F.col("text"))).alias("text"))


_HEADED = "CASE WHEN r = 0 THEN upper(substr(text, 1, 30)) WHEN r < 4 THEN regexp_replace(substr(text, 3, 24), '[.,;:]', ''{G}) WHEN r = 4 THEN 'Of The Things That Were' WHEN r = 5 THEN 'McDonald Said It''S So' WHEN r = 6 THEN 'Éa 3b ÇÀ' ELSE text END"


@query(f"SELECT doc_id, line_no, {q_title('t')} AS title_like FROM (SELECT doc_id, line_no, {_HEADED.replace('{G}', ', ' + chr(39) + 'g' + chr(39))} AS t FROM decorated)", ("decorated",))
def title_case_lines(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.title_like(F.expr(_HEADED.replace("{G}", "").replace("''S", "\\'S"))).alias("title_like"))


@query(
    f"""SELECT doc_id AS page_id, CAST(n AS INT) AS unit_no, source, CASE WHEN length({q_strip('source')}) >= 2 THEN '[TR] ' || source ELSE source END AS translated
FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS source FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
)
def translate_pages_mock(spark, sf_dir):
    from folioflow.sources.adapters import MarkTranslator, translate

    units = docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("unit_no", "source"))
    return translate(units, MarkTranslator())
