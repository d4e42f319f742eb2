"""Queries of page picking, reports, re-setting, translation units and sources, with DuckDB SQL as in catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import elements as E
from folioflow.operators import extraction, folds, layout, metrics, reports, spans
from folioflow.operators.sentences import sentence_list
from folioflow.plans.catalog import _AFTER, Q_ELEMENTS, Q_FLAGS, Q_MT, Q_NARROW, Q_PAGE, Q_SENTENCES, _after, _cte, _page_blocks, docs, q_kind, q_cleaned, q_mapped, q_post, q_prefix, q_ratio, q_strip, q_tidy, q_words, query, rounded, table
from folioflow.plans.catalog import ORACLES as ORACLES
from folioflow.plans.fixtures import view
from folioflow.sources import adapters
from folioflow.streaming.batches import event_counts as counted_events

# pages


@query("SELECT doc_id, page FROM (SELECT doc_id, unnest(range(1, doc_id % 12 + 1)) AS page FROM documents) WHERE page <= 3")
def first_pages(spark, sf_dir):
    pages = docs(spark, sf_dir).where("doc_id % 12 > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 12)).alias("page"))
    return metrics.first_pages(pages, 3)


@query(
    """SELECT doc_id, array_to_string(CASE WHEN len(p) > 3 THEN [p[1], p[3]] ELSE p[:1] END, ',') AS audit, coalesce(p[3], p[2], p[1]) AS body FROM (
SELECT doc_id, list_filter(range(CAST(doc_id % 9 AS BIGINT)), lambda x: (x + doc_id) % 3 <> 0) AS p FROM documents)"""
)
def representative_pages(spark, sf_dir):
    numbers = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")), lambda x: (x < F.col("doc_id") % 9) & ((x + F.col("doc_id")) % 3 != 0))
    found = metrics.representative_pages(docs(spark, sf_dir).select("doc_id", F.reverse(numbers).alias("pages")))
    return found.withColumn("audit", F.array_join("audit", ","))


@query("SELECT doc_id, l[doc_id % len(l) + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def page_fetch(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return docs(spark, sf_dir).select("doc_id", metrics.page_at(lines, (F.col("doc_id") % F.size(lines)).cast("int")).alias("line"))


@query("SELECT page_id // 10 AS doc_id, page_id % 10 AS page, url FROM pages WHERE page_id % 3 <> 0 ORDER BY ALL")
def saved_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("doc_id"), (F.col("page_id") % 10).alias("page"), "url", "page_id")
    return reports.saved_pages(pages.drop("page_id"), pages.where("page_id % 3 <> 0").select("doc_id", "page"))


@query(
    "SELECT page_id, line, text FROM (SELECT page_id, 'a' AS line, url AS text FROM pages WHERE page_id % 2 = 0 UNION SELECT page_id, 'a', url FROM pages WHERE page_id % 3 = 0) EXCEPT SELECT page_id, 'a', url FROM pages WHERE page_id % 5 = 0"
)
def page_sets(spark, sf_dir):
    """Found by two searches, each once, without those that are done."""
    some = lambda n: table(spark, sf_dir, "pages").where(F.col("page_id") % n == 0).select("page_id", F.lit("a").alias("line"), F.col("url").alias("text"))
    return some(2).unionByName(some(3)).distinct().exceptAll(some(5))


_METHODS = f""", w AS (SELECT page_id, string_agg(text, chr(10) ORDER BY line_no) AS t, string_agg({q_strip("text")}, chr(10) ORDER BY line_no) AS trimmed FROM doc_lines GROUP BY page_id),
k AS (SELECT page_id, block_no, regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g') AS b FROM doc_lines GROUP BY page_id, block_no),
j AS (SELECT page_id, string_agg(b, ' ' ORDER BY block_no) AS b FROM k WHERE length({q_strip("b")}) > 2 GROUP BY page_id),
d AS (SELECT page_id, string_agg(text, ' ' ORDER BY block_no, line_no, span_no) AS d FROM spans WHERE {q_strip("text")} <> '' GROUP BY page_id)
SELECT page_id, m AS method_ord, ['standard', 'whitespace', 'dehyphenate', 'blocks', 'dict', 'words'][m + 1] AS method,
[trimmed, t, regexp_replace(t, '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g'), coalesce(b, ''), coalesce(d, ''), CASE WHEN len({q_words("t")}) > 10 THEN array_to_string({q_words("t")}, ' ') ELSE '' END][m + 1] AS text
FROM w LEFT JOIN j USING (page_id) LEFT JOIN d USING (page_id), (SELECT unnest(range(6)) AS m)"""


@query()
def extraction_methods(spark, sf_dir):
    found = extraction.extracted(view(spark, sf_dir, "doc_lines"), view(spark, sf_dir, "spans"))
    return found.withColumn("method_ord", F.col("method_ord").cast("long"))


ORACLES["extraction_methods"] = _cte(["doc_lines", "spans"], _METHODS)

# reports


@query(
    f"""SELECT page_id, round({q_ratio("a", "b")}, 6) AS ratio, {q_ratio("a", "b")} BETWEEN 0.7 AND 1.3 AS ok FROM (SELECT page_id, max(y1) - min(y0) AS b FROM doc_lines WHERE {q_strip("text")} <> '' GROUP BY page_id)
JOIN (SELECT page_id, max(y1) - min(y0) AS a FROM (SELECT d.page_id, a.y0, d.y1, a.text FROM {_AFTER} a JOIN doc_lines d USING (page_id, block_no, line_no)) WHERE {q_strip("text")} <> '' GROUP BY page_id) USING (page_id)""",
    ("doc_lines",),
)
def yrange_ratio(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    return metrics.preserved(lines, _after(lines), 0.7, 1.3, blocks=True).select("page_id", rounded(F.col("ratio")).alias("ratio"), "ok")


def _media(spark, sf_dir):
    n = lambda k: F.col("page_id") % k
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", n(7).alias("links_before"), n(5).alias("links_after"), n(3).alias("images_before"), n(4).alias("images_after"), T.strip_tags("html").alias("text"), (n(15) / 10).alias("y_ratio"))


_TEXT = "replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')"
_FLAGGED = f"""(SELECT page_id, page_id % 5 >= (page_id % 7) * 0.8 AS links_ok, page_id % 4 >= page_id % 3 AS images_ok, length({q_strip(_TEXT)}) > 50 AS has_text,
CAST(page_id % 15 AS DOUBLE) / 10 BETWEEN 0.7 AND 1.3 AS y_ok FROM pages)"""


@query(f"SELECT * FROM {_FLAGGED}")
def preservation_flags(spark, sf_dir):
    return reports.preservation(_media(spark, sf_dir), 0.8, 0.7).select("page_id", "links_ok", "images_ok", "has_text", "y_ok")


@query(f"SELECT count(*) AS pages, count(*) FILTER (links_ok) AS links_ok, count(*) FILTER (images_ok) AS images_ok, count(*) FILTER (has_text) AS has_text, count(*) FILTER (y_ok) AS y_ok FROM {_FLAGGED}")
def preservation_summary(spark, sf_dir):
    return reports.preservation_summary(reports.preservation(_media(spark, sf_dir), 0.8, 0.7))


_MD = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '# A' WHEN 2 THEN concat('| ab | cd |', chr(10), '| 漢字かなカナ漢字 | 2 |') WHEN 3 THEN 'Abcdefghijklmnopqrstuvwxyz onlytwo' ELSE text END"
_AUDITED = f"""(SELECT doc_id, length(text) AS chars, coalesce(e.elements, 0) AS elements, coalesce(h, 0) AS headings, coalesce(p, 0) AS paragraphs, coalesce(t, 0) AS tables, coalesce(w, 0) AS words,
concat_ws(',', CASE WHEN coalesce(w, 0) < 5 AND length(text) > 20 THEN 'LOW_WORDS' END, CASE WHEN coalesce(h, 0) + coalesce(p, 0) = 0 THEN 'NO_CONTENT' END, CASE WHEN length(text) < 20 THEN 'EMPTY' END,
CASE WHEN len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{309f}}\\x{{30a0}}-\\x{{30ff}}]')) > 5 THEN 'CJK_CHARS' END) AS issues FROM odd
LEFT JOIN (SELECT doc_id, count(*) AS elements, count(*) FILTER (type = 'heading') AS h, count(*) FILTER (type = 'paragraph') AS p, count(*) FILTER (type = 'table') AS t, CAST(sum(len({q_words("text")})) AS BIGINT) AS w
FROM {Q_ELEMENTS.replace("FROM markdown", "FROM odd")} GROUP BY doc_id) e USING (doc_id))"""


def _audited(spark, sf_dir):
    texts = view(spark, sf_dir, "markdown").withColumn("text", F.expr(_MD.replace("chr(10)", "'\\n'")))
    return reports.audited(E.elements(texts), texts).withColumn("chars", F.col("chars").cast("long"))


@query()
def audit_pages(spark, sf_dir):
    return _audited(spark, sf_dir).withColumn("issues", F.array_join("issues", ","))


ORACLES["audit_pages"] = _cte(["markdown"], f", odd AS (SELECT doc_id, {_MD} AS text FROM markdown) SELECT * FROM {_AUDITED}")


@query()
def audit_summary(spark, sf_dir):
    return reports.audit_summary(_audited(spark, sf_dir).withColumn("error", F.when(F.col("doc_id") % 13 == 0, F.lit("unreadable"))))


ORACLES["audit_summary"] = _cte(
    ["markdown"],
    f""", odd AS (SELECT doc_id, {_MD} AS text FROM markdown) SELECT count(*) AS pages, count(*) FILTER (issues = '' AND doc_id % 13 <> 0) AS ok, count(*) FILTER (issues <> '') AS with_issues, count(*) FILTER (doc_id % 13 = 0) AS errors,
CAST(sum(elements) AS BIGINT) AS elements, CAST(sum(headings) AS BIGINT) AS headings, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(words) AS BIGINT) AS words FROM {_AUDITED}""",
)


@query("SELECT page_id, type, count(*) AS n FROM layout_blocks GROUP BY page_id, type", ("layout_blocks",))
def type_histogram(spark, sf_dir):
    return reports.type_histogram(view(spark, sf_dir, "layout_blocks"))


@query(
    f"SELECT doc_id, CAST(len(string_split(text, chr(10))) + coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda x: len(list_filter({q_words('x')}, lambda v: length(v) % 5 <> 0)))), 0) AS BIGINT) AS n FROM documents"
)
def element_count(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    span = lambda w: F.struct(F.when(F.length(w) % 5 == 0, F.lit("discarded")).when(F.length(w) % 5 == 1, F.lit("text")).alias("type"))
    block = lambda x: F.struct(F.array(F.struct(F.transform(T.words(x), span).alias("spans"))).alias("lines"))
    return docs(spark, sf_dir).select("doc_id", reports.element_count(lines, F.transform(lines, block)).cast("long").alias("n"))


_RECORDS = "SELECT page_id % 40 AS doc_id, CAST(page_id % 9 AS DOUBLE) / 4 AS seconds, CAST(page_id % 11 AS DOUBLE) / 11 AS confidence, CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 8 AS DOUBLE) / 8 END AS recall FROM pages"


@query(f"SELECT count(DISTINCT doc_id) AS docs, count(*) AS pages, sum(seconds) AS seconds, round(sum(seconds) / count(*), 6) AS seconds_per_page, round(avg(confidence), 6) AS mean_confidence, round(avg(recall), 6) AS mean_recall FROM ({_RECORDS})")
def ocr_summary(spark, sf_dir):
    out = reports.ocr_summary(spark.sql(_RECORDS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages")))
    return out.select("docs", "pages", "seconds", *[rounded(F.col(c)).alias(c) for c in ("seconds_per_page", "mean_confidence", "mean_recall")])


@query(f"SELECT count(*) AS pages, sum(seconds) AS seconds, round(sum(seconds) / greatest(count(*), 1), 6) AS seconds_per_page FROM ({_RECORDS})")
def throughput(spark, sf_dir):
    out = reports.throughput(spark.sql(_RECORDS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages")))
    return out.withColumn("seconds_per_page", rounded(F.col("seconds_per_page")))


_PAGE_LISTS = f"(SELECT page_id, count(*) FILTER ({q_kind('text')} IS NOT NULL) AS lists, bool_or(regexp_matches(text, '[«»‘’“”–—…\\x{{a0}}]')) AS typographic FROM doc_lines GROUP BY page_id)"


@query(
    f"""SELECT page_id // 3 AS doc_id, string_agg(said, ';' ORDER BY page_id) AS issues FROM (SELECT page_id, concat_ws(';', CASE WHEN page_id % 4 > 0 THEN concat('Has ', page_id % 4, ' tables', p) END, CASE WHEN page_id % 5 > 2 THEN concat('Has ', page_id % 5 - 2, ' links', p) END,
CASE WHEN lists > 0 THEN concat('Has ', lists, ' list items', p) END, CASE WHEN typographic THEN concat('Has typographic chars', p) END, CASE WHEN page_id % 8 = 7 THEN concat('Table-text overlap', p) END) AS said
FROM (SELECT *, concat(' (page ', page_id % 3 + 1, ')') AS p FROM {_PAGE_LISTS})) WHERE said <> '' GROUP BY page_id // 3""",
    ("doc_lines",),
)
def document_issues(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    some = lines.groupBy("page_id").agg(F.count_if(T.is_list_item("text")).alias("lists"), F.bool_or(F.col("text").rlike("[«»‘’“”–—…\xa0]")).alias("typographic"))
    p = F.col("page_id")
    pages = some.select(F.floor(p / 3).alias("doc_id"), (p % 3 + 1).alias("page"), (p % 4).alias("tables"), (p % 5 - 2).alias("links"), "lists", "typographic", (p % 8 == 7).alias("overlap"))
    return reports.document_issues(pages).withColumn("issues", F.array_join("issues", ";"))


@query(
    f"""SELECT doc_id, elem_no, concat('[', upper(type[1]), level, '] ', replace(text[:75], chr(10), ' '), CASE WHEN length(text) > 75 THEN '...' ELSE '' END) AS preview, more FROM (
SELECT *, greatest(count(*) OVER (PARTITION BY doc_id) - 6, 0) AS more FROM {Q_ELEMENTS}) WHERE elem_no < 6""",
    ("markdown",),
)
def element_previews(spark, sf_dir):
    return reports.element_previews(E.elements(view(spark, sf_dir, "markdown")))


@query("SELECT concat_ws(' | ', page_id, url, CASE WHEN page_id % 2 = 0 THEN '-' ELSE 'odd' END) AS value FROM pages")
def text_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("kind", F.when(F.col("page_id") % 2 == 1, F.lit("odd")))
    return reports.table_report(pages, ["page_id", "url", "kind"])


# classifiers and functions


@query(
    "SELECT doc_id, line_no, CASE WHEN regexp_matches({0}, '^[•●○◦▪▸▹–—-]\\s') THEN 'bullet' WHEN regexp_matches({0}, '^\\d+[.)]\\s') THEN 'numbered' WHEN regexp_matches({0}, '^[a-z][.)]\\s') THEN 'lettered' WHEN regexp_matches({0}, '^[ivxlcdm]+[.)]\\s') THEN 'roman' WHEN regexp_matches({0}, '^[A-Z][.)]\\s') THEN 'cap-lettered' END AS kind FROM decorated".format(q_strip("text")),
    ("decorated",),
)
def diagnostic_lists(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.diagnostic_list_kind("text").alias("kind"))


_MEETING = "SELECT page_id, CAST(100 AS DOUBLE) AS x0, CAST(80 AS DOUBLE) AS y0, CAST(400 AS DOUBLE) AS x1, CAST(131 + page_id % 3 * 40 AS DOUBLE) AS y1 FROM layout_blocks WHERE blk_no = 0 AND page_id % 5 <> 0"


@query(
    f"SELECT page_id, blk_no, EXISTS (SELECT 1 FROM ({_MEETING}) t WHERE t.page_id = b.page_id AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0) AS in_table FROM layout_blocks b",
    ("layout_blocks",),
)
def table_overlap(spark, sf_dir):
    found = view(spark, sf_dir, "layout_blocks")
    return layout.in_table(found, spark.sql(_MEETING.replace("FROM layout_blocks", "FROM {found}"), found=found)).select("page_id", "blk_no", "in_table")


@query("SELECT doc_id, i - 1 AS sent_no, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {}), lambda x: x <> '') AS l FROM documents))".format(q_strip("x")))
def capital_sentences(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", F.posexplode(T.capital_sentences("text")).alias("sent_no", "sentence"))
    return found.withColumn("sent_no", F.col("sent_no").cast("long"))


_MISREAD = "concat('5ection c0ntract art1cle oﬃce ﬁnal ﬂow AuthorizedDealer ', text)"


@query(f"SELECT doc_id, {q_cleaned(_MISREAD)} AS text FROM documents")
def ocr_corrections(spark, sf_dir):
    from folioflow import config

    return docs(spark, sf_dir).select("doc_id", T.corrected(F.expr(_MISREAD), config.OCR_RULES).alias("text"))


@query(f"SELECT doc_id, line_no, {q_tidy(q_cleaned('text'))} AS text FROM decorated", ("decorated",))
def clean_ocr_text(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.cleaned_ocr("text").alias("text"))


_FANCY = "concat('“a” ‘b’ «c» „d‚ ‟e ‹f› – — ‒ ― − … ', text)"


@query("SELECT doc_id, {} AS text, replace({}, '…', '...') AS page FROM documents".format(q_mapped(_FANCY, *Q_MT), q_mapped(_FANCY, *Q_PAGE)))
def typographic_maps(spark, sf_dir):
    """The maps of both normalizations, without NFKC, which SQL lacks."""
    from folioflow import config

    c = F.expr(_FANCY)
    return docs(spark, sf_dir).select("doc_id", T.mapped(c, config.QUOTES | config.DASHES).alias("text"), T.mapped(c, config.PAGE_QUOTES | config.PAGE_DASHES).alias("page"))


@query("SELECT doc_id, concat('fi 1⁄2 \"a\" - ... ', replace({}, '…', '...')) AS ocr, concat('fi 1⁄2 “a” – ... ', text) AS native FROM documents".format(q_mapped("text", *Q_PAGE)))
def pdf_normalize(spark, sf_dir):
    c = F.concat(F.lit("ﬁ ½ “a” – … "), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", folds.normalized_for_page(c).alias("ocr"), folds.normalized_for_page(c, ocr=False).alias("native"))


_TERMS = ["the", "on", "ISO", "[[TERM0]]", "der"]


def q_terms(x: str) -> str:
    for i, t in enumerate(_TERMS):
        x = f"replace({x}, '{t}', '[[TERM{i}]]')"
    return x


def q_present() -> str:
    x, out = "text", []
    for i, t in enumerate(_TERMS):
        out.append(f"CASE WHEN contains({x}, '{t}') THEN '[[TERM{i}]]={t}' END")
        x = f"replace({x}, '{t}', '[[TERM{i}]]')"
    return f"concat_ws(',', {', '.join(out)})"


@query(f"SELECT doc_id, {q_terms('text')} AS text, {q_present()} AS terms FROM documents")
def protect_terms(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", T.protect_terms("text", _TERMS).alias("p"))
    return p.select("doc_id", "p.text", F.array_join(F.transform(F.map_entries("p.terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("terms"))


@query("SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'it' WHEN 1 THEN 'en' WHEN 2 THEN 'es' WHEN 3 THEN 'fr' WHEN 4 THEN 'de' WHEN 5 THEN 'pt' WHEN 6 THEN 'nl' ELSE 'en' END AS code FROM documents")
def language_codes(spark, sf_dir):
    names = F.array(*map(F.lit, ["Italiano", "English", "Español", "Français", "Deutsch", "Português", "Nederlands", "Klingon"]))
    return docs(spark, sf_dir).select("doc_id", T.language_code(F.try_element_at(names, (F.col("doc_id") % 9 + 1).cast("int"))).alias("code"))


def q_quotes(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


_LEVEL = r"length(regexp_extract(x, '^(#{1,6})\s', 1))"


@query(
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text || chr(10) || '# It''s "A" & <b>', chr(10)), lambda x: {q_strip("x")}), lambda x: x <> '' AND NOT starts_with(x, '|')),
lambda x: CASE WHEN regexp_matches(x, '^#{{1,6}}\\s') THEN '<h' || {_LEVEL} || '>' || {q_quotes("regexp_replace(x, '^#{1,6}" + chr(92) + "s+', '')")} || '</h' || {_LEVEL} || '>' ELSE '<p>' || {q_quotes("x")} || '</p>' END), chr(10)) AS html FROM markdown""",
    ("markdown",),
)
def simple_html(spark, sf_dir):
    return view(spark, sf_dir, "markdown").select("doc_id", T.simple_html(F.concat("text", F.lit("\n# It's \"A\" & <b>"))).alias("html"))


_BODY = q_strip(f"substr({q_strip('text')}, length({q_prefix('text')}) + 1)")


@query(f"SELECT doc_id, line_no, CASE WHEN {q_prefix('text')} IS NULL THEN '[TR] ' || text ELSE {q_prefix('text')} || '[TR] ' || {_BODY} END AS translated FROM decorated", ("decorated",))
def translate_keeping_prefix(spark, sf_dir):
    return view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.translated_after_prefix("text").alias("translated"))


@query(
    f"""SELECT page_id, block_no, coalesce(p, '') || '[TR] ' || CASE WHEN p IS NULL THEN whole ELSE concat_ws(' ', {q_strip("substr(" + q_strip("l[1]") + ", length(p) + 1)")}, CASE WHEN len(l) > 1 THEN array_to_string(l[2:], ' ') END) END AS translated FROM (
SELECT *, {q_prefix("l[1]")} AS p, array_to_string(l, ' ') AS whole FROM (SELECT page_id, block_no, list(text ORDER BY line_no) AS l FROM doc_lines GROUP BY page_id, block_no))""",
    ("doc_lines",),
)
def translate_paragraphs(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    blocks = view(spark, sf_dir, "doc_lines").groupBy("page_id", "block_no").agg(ordered.alias("lines"))
    return blocks.select("page_id", "block_no", T.translated_paragraph("lines").alias("translated"))


@query("SELECT doc_id, line_no, text FROM decorated", ("decorated",))
def url_round_trip(spark, sf_dir):
    """What comes back after links are hidden and restored, places spaced and in small letters as a translation leaves them."""
    p = view(spark, sf_dir, "decorated").select("doc_id", "line_no", T.protect_urls("text").alias("p"))
    spaced = F.regexp_replace("p.text", r"\[URL(\d+)\]", "[ url $1 ]")
    return p.select("doc_id", "line_no", T.restore_urls(spaced, "p.urls").alias("text"))


@query()
def sentence_chunks(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", sentence_list("text").alias("sentences")).where(F.size("sentences") > 0)
    return found.select("doc_id", F.posexplode(folds.packed_sentences("sentences", F.lit(1500))).alias("chunk_no", "text"))


ORACLES["sentence_chunks"] = f"""WITH RECURSIVE s AS (SELECT doc_id, sent_no, sentence, length(sentence) AS n FROM {Q_SENTENCES}),
r AS (SELECT doc_id, sent_no, sentence, CASE WHEN n > 1500 THEN 1 ELSE 0 END AS chunk, n AS total FROM s WHERE sent_no = 0
UNION ALL SELECT s.doc_id, s.sent_no, s.sentence, CASE WHEN total + n > 1500 THEN chunk + 1 ELSE chunk END, CASE WHEN total + n > 1500 THEN n ELSE total + n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.sent_no = r.sent_no + 1)
SELECT doc_id, chunk AS chunk_no, string_agg(sentence, ' ' ORDER BY sent_no) AS text FROM r GROUP BY ALL UNION ALL SELECT doc_id, 0, '' FROM s WHERE sent_no = 0 AND n > 1500"""

# formats


@query(
    f"""SELECT page_id, block_no, line_no, span_no, o || c AS tags, concat_ws('; ', CASE WHEN bold THEN 'font-weight: bold' END, CASE WHEN italic THEN 'font-style: italic' END,
concat('color: rgb(', CAST(trunc((color >> 16 & 255) / 255.0::DOUBLE * 255) AS INT), ', ', CAST(trunc((color >> 8 & 255) / 255.0::DOUBLE * 255) AS INT), ', ', CAST(trunc((color & 255) / 255.0::DOUBLE * 255) AS INT), ')')) AS css FROM (
SELECT *, concat(CASE WHEN superscript THEN '<sup>' END, CASE WHEN subscript THEN '<sub>' END, CASE WHEN bold THEN '<b>' END, CASE WHEN italic THEN '<i>' END) AS o,
concat(CASE WHEN italic THEN '</i>' END, CASE WHEN bold THEN '</b>' END, CASE WHEN subscript THEN '</sub>' END, CASE WHEN superscript THEN '</sup>' END) AS c FROM {Q_FLAGS})""",
    ("spans",),
)
def span_markup(spark, sf_dir):
    start, end = spans.html_tags()
    return spans.flags(view(spark, sf_dir, "spans")).select(*spans.LINE, "span_no", F.concat(start, end).alias("tags"), spans.css_style().alias("css"))


@query("SELECT doc_id, concat('rgb(', CAST(trunc(r * 255) AS INT), ', ', CAST(trunc(g * 255) AS INT), ', 255)') AS css FROM (SELECT doc_id, CAST(doc_id % 101 AS DOUBLE) / 100 AS r, CAST(doc_id % 7 AS DOUBLE) / 7 AS g FROM documents)")
def css_colors(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", spans.css_rgb(F.col("doc_id") % 101 / 100, F.col("doc_id") % 7 / 7, F.lit(1.0)).alias("css"))


# re-setting pages

_W, _H = "CAST(180 + doc_id % 500 AS DOUBLE)", "CAST(500 + doc_id % 400 AS DOUBLE)"
_KIND = "CASE WHEN length(text) > 2000 OR doc_id % 25 > 20 THEN 'dense' WHEN doc_id % 2 = 0 THEN 'sparse' ELSE 'normal' END"


def _resized(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", F.expr(_W).alias("width"), F.expr(_H).alias("height"))
    return d.withColumn("kind", layout.density(F.length("text"), F.col("doc_id") % 25, F.col("doc_id") % 2 == 0))


_AREA = f"""(SELECT *, CASE WHEN w - 2 * m < 100 THEN 20 ELSE m END AS x0, CASE kind WHEN 'dense' THEN greatest(30, h * 0.035::DOUBLE) ELSE greatest(40, h * 0.045::DOUBLE) END AS y0 FROM (
SELECT *, CASE kind WHEN 'dense' THEN greatest(28, w * 0.04::DOUBLE) WHEN 'sparse' THEN greatest(50, w * 0.08::DOUBLE) ELSE greatest(36, w * 0.06::DOUBLE) END AS m FROM (SELECT doc_id, text, {_W} AS w, {_H} AS h, {_KIND} AS kind FROM documents)))"""


@query(
    f"""SELECT doc_id, kind, round(x0, 6) AS x0, round(y0, 6) AS y0, round(w - x0, 6) AS x1, round(h - y0, 6) AS y1, round(body, 6) AS body, round(body * CASE kind WHEN 'dense' THEN 0.25 WHEN 'sparse' THEN 0.8 ELSE 0.4 END, 6) AS paragraph,
round(body * CASE kind WHEN 'dense' THEN 0.5 WHEN 'sparse' THEN 1.5 ELSE 0.8 END, 6) AS above, round(body * CASE kind WHEN 'dense' THEN 0.2 WHEN 'sparse' THEN 0.6 ELSE 0.3 END, 6) AS below,
CAST(CASE kind WHEN 'dense' THEN 1.15 WHEN 'sparse' THEN 1.4 ELSE 1.25 END AS DOUBLE) AS line_height
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN greatest(b, least(14, t / 35)) ELSE b END AS body FROM (SELECT *, greatest(8.0::DOUBLE, least(11, t / 50)) AS b FROM (SELECT *, w - 2 * x0 AS t FROM {_AREA})))"""
)
def page_setting(spark, sf_dir):
    d = _resized(spark, sf_dir).withColumn("a", layout.text_area(F.col("kind"), F.col("width"), F.col("height")))
    d = d.withColumn("body", layout.body_size(F.col("a.x1") - F.col("a.x0"), F.col("doc_id") % 2 == 0)).withColumn("s", layout.spacing(F.col("kind"), F.col("body")))
    six = lambda c: rounded(F.col(c)).alias(c.split(".")[-1])
    return d.select("doc_id", "kind", *map(six, ["a.x0", "a.y0", "a.x1", "a.y1", "body", "s.paragraph", "s.above", "s.below"]), "s.line_height")


@query(
    """SELECT doc_id, round(n0, 6) AS y0, round(CASE WHEN e < 0.85 AND h * e * 1.10 > n0 + 100 THEN h * e * 1.10 ELSE y1 END, 6) AS y1 FROM (SELECT *, CASE WHEN s > 0.10 AND h * s * 0.85 > y0 AND h * s * 0.85 < h * 0.5 THEN h * s * 0.85 ELSE y0 END AS n0 FROM (
SELECT doc_id, 700.0::DOUBLE AS h, 40.0::DOUBLE AS y0, 660.0::DOUBLE AS y1, CAST(doc_id % 70 AS DOUBLE) * 10 / 842 AS s, (CAST(doc_id % 70 AS DOUBLE) * 10 + doc_id % 13 * 20) / 842 AS e FROM documents))"""
)
def sparse_area(spark, sf_dir):
    first = (F.col("doc_id") % 70).cast("double") * 10
    found = layout.sparse_area(F.lit(40.0), F.lit(660.0), first, first + F.col("doc_id") % 13 * 20, F.lit(842.0), F.lit(700.0))
    return docs(spark, sf_dir).select("doc_id", found.alias("a")).select("doc_id", rounded(F.col("a.y0")).alias("y0"), rounded(F.col("a.y1")).alias("y1"))


@query(
    f"""SELECT page_id, block_no, round(CASE WHEN n >= 2 AND abs(page_id % 6 - n) <= 2 AND span > 0 AND g > 10 THEN greatest(10, 700 * g / span) ELSE 0 END, 6) AS gap FROM (
SELECT page_id, block_no, y0 - lag(y1) OVER (PARTITION BY page_id ORDER BY y0, block_no) AS g, count(*) OVER p AS n, max(y1) OVER p - min(y0) OVER p AS span FROM (
SELECT page_id, block_no, min(y0) AS y0, max(y1) AS y1 FROM (SELECT * REPLACE (y0 + block_no * 15 * (page_id % 3) AS y0, y1 + block_no * 15 * (page_id % 3) AS y1) FROM doc_lines) GROUP BY page_id, block_no) WINDOW p AS (PARTITION BY page_id))""",
    ("doc_lines",),
)
def sparse_gaps(spark, sf_dir):
    shift = F.col("block_no") * 15 * (F.col("page_id") % 3)
    lines = view(spark, sf_dir, "doc_lines").withColumns({"y0": F.col("y0") + shift, "y1": F.col("y1") + shift})
    blocks = lines.groupBy("page_id", "block_no").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).withColumns({"n_elements": F.col("page_id") % 6, "room": F.lit(700.0)})
    return layout.sparse_gaps(blocks).select("page_id", "block_no", rounded(F.col("gap")).alias("gap"))


@query(
    """SELECT doc_id, round(height, 6) AS height, height >= 9 * 1.5 AS fits FROM (SELECT doc_id, least(greatest(1, length(text) / greatest(1, CAST(trunc(w / 4.5) AS INT)) + 1) * 9 * 1.3::DOUBLE * 1.5, 40 * (doc_id % 20)) AS height
FROM (SELECT doc_id, text, CAST(doc_id % 300 AS DOUBLE) AS w FROM documents))"""
)
def box_fit(spark, sf_dir):
    fit = layout.box_fit(F.length("text"), (F.col("doc_id") % 300).cast("double"), F.lit(9.0), (40 * (F.col("doc_id") % 20)).cast("double"))
    return docs(spark, sf_dir).select("doc_id", fit.alias("f")).select("doc_id", rounded(F.col("f.height")).alias("height"), "f.fits")


@query(
    """SELECT doc_id, CASE WHEN length(text) <= n THEN text ELSE substr(text, 1, CASE WHEN n >= 3 THEN n - 3 ELSE greatest(length(text) + n - 3, 0) END) || '...' END AS text, round(length(text) * 8 * 0.52::DOUBLE, 6) AS width
FROM (SELECT doc_id, text, CAST(trunc(CAST(doc_id % 400 AS DOUBLE) * 3 / (8 * 0.45::DOUBLE)) AS INT) AS n FROM documents)"""
)
def truncation(spark, sf_dir):
    cut = layout.truncated(F.col("text"), (F.col("doc_id") % 400).cast("double") * 3, F.lit(8.0))
    return docs(spark, sf_dir).select("doc_id", cut.alias("text"), rounded(layout.text_width(F.length("text"), F.lit(8))).alias("width"))


@query(
    """SELECT table_id, r, c, round(100 + c * w + 2, 6) AS x0, round(50 + r * t + 2, 6) AS y0, round(100 + (c + 1) * w - 2, 6) AS x1, round(50 + (r + 1) * t - 2, 6) AS y1, round(least(10, greatest(6, t * 0.5)), 6) AS size FROM (
SELECT table_id, n, k, unnest(range(n)) AS r, 400.0::DOUBLE / k AS w, CAST(20 + table_id % 90 AS DOUBLE) / n AS t FROM (SELECT page_id AS table_id, page_id % 5 AS n, page_id % 4 AS k FROM pages) WHERE n > 0 AND k > 0), LATERAL (SELECT unnest(range(k)) AS c)"""
)
def cell_grid(spark, sf_dir):
    p = F.col("page_id")
    tables = table(spark, sf_dir, "pages").select(p.alias("table_id"), F.lit(100.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(500.0).alias("x1"), (70 + p % 90).cast("double").alias("y1"), (p % 5).alias("n_rows"), (p % 4).alias("n_cols"))
    found = layout.cell_grid(tables)
    return found.select("table_id", "r", "c", *[rounded(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1", "size")])


_GROUPED = "SELECT page_id, block_no, CAST(floor(line_no / 3) AS BIGINT) AS group_no, x0, y0, x1, y1 FROM doc_lines"


@query(
    f"""SELECT page_id, group_no, x0, CASE WHEN taller THEN b0 ELSE y0 END AS y0, x1, CASE WHEN taller THEN b1 ELSE y1 END AS y1 FROM (SELECT g.*, b.y0 - 5 AS b0, b.y1 AS b1, lo = hi AND b.y1 - b.y0 + 5 > g.y1 - g.y0 AS taller FROM (
SELECT page_id, group_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(block_no) AS lo, max(block_no) AS hi FROM ({_GROUPED}) GROUP BY page_id, group_no) g JOIN page_blocks b ON b.page_id = g.page_id AND b.block_no = g.lo)""",
    ("doc_lines", "page_blocks"),
)
def paragraph_boxes(spark, sf_dir):
    lines = view(spark, sf_dir, "doc_lines")
    grouped = lines.withColumn("group_no", F.floor(F.col("line_no") / 3))
    return layout.paragraph_boxes(grouped, _page_blocks(spark, sf_dir).withColumn("y0", F.col("y0") - 5))


@query(
    """SELECT doc_id, i AS col_no, round(50 + i * (e + 16), 6) AS x0, round(50 + i * (e + 16) + e, 6) AS x1 FROM (SELECT doc_id, n, (500.0::DOUBLE - 16 * (n - 1)) / n AS e, unnest(range(n)) AS i FROM (SELECT doc_id, doc_id % 5 + 1 AS n FROM documents) WHERE n <> 3)
UNION ALL SELECT doc_id, unnest([0, 1]), unnest([50, 310]), unnest([290, 550]) FROM documents WHERE doc_id % 5 = 2"""
)
def column_rects(spark, sf_dir):
    pair = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in ((0.0, 240.0), (260.0, 500.0))])
    found = F.when(F.col("doc_id") % 5 == 2, pair).otherwise(F.array().cast("array<struct<x0:double,x1:double>>"))
    rects = docs(spark, sf_dir).select("doc_id", F.posexplode(layout.column_rects(found, F.lit(500.0), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(16.0))).alias("col_no", "r"))
    return rects.select("doc_id", F.col("col_no").cast("long").alias("col_no"), rounded(50 + F.col("r.x0")).alias("x0"), rounded(50 + F.col("r.x1")).alias("x1"))


_SIZES = "SELECT doc_id, CAST(doc_id % 7 AS INT) AS level, CAST(6 + doc_id % 9 AS DOUBLE) AS size, CAST(doc_id % 842 AS DOUBLE) AS y, CAST(72 + doc_id % 40 * 15 AS DOUBLE) AS dpi, CAST(20 + doc_id % 700 * 10 AS DOUBLE) AS w, CAST(10 + doc_id % 90 * 60 AS DOUBLE) AS h FROM documents"


@query(
    f"""SELECT doc_id, CAST(CASE level WHEN 1 THEN 1.5 WHEN 2 THEN 1.3 WHEN 3 THEN 1.15 ELSE 1.05 END AS DOUBLE) AS heading, CAST(CASE WHEN size < 11 OR y > 0.7 * 842 THEN 0.4 ELSE 0.5 END AS DOUBLE) AS least_scale, round(CASE WHEN dpi < 150 OR dpi > 300 THEN 150 / dpi ELSE 1 END, 6) AS ocr,
greatest(floor(w * s), 300) AS image_width, greatest(floor(h * s), 300) AS image_height, greatest(0, w - 50) AS indent FROM (SELECT *, least(1, 3000 / greatest(w, h)) AS s FROM ({_SIZES}))"""
)
def scales(spark, sf_dir):
    d = spark.sql(_SIZES.replace("FROM documents", "FROM {docs}"), docs=docs(spark, sf_dir))
    c = F.col
    d = d.withColumn("f", layout.fitted(c("w"), c("h")))
    return d.select(
        "doc_id", E.heading_scale(c("level")).alias("heading"), layout.scale_floor(c("size"), c("y"), F.lit(842)).alias("least_scale"), rounded(layout.ocr_scale(c("dpi"), 150.0)).alias("ocr"),
        c("f.width").alias("image_width"), c("f.height").alias("image_height"), layout.indent(c("w"), F.lit(50.0)).alias("indent"),
    )


# sources and streams

_DUMPS = "SELECT page_id // 4 AS doc_id, concat('head', chr(10), string_agg(concat('--- Pagina ', page_id % 4 + 1, '/4 ---', chr(10), CASE WHEN page_id % 3 <> 0 THEN concat('Tempo: ', page_id % 50, '.5s', chr(10)) ELSE '' END, url, chr(10), 'second line', chr(10), chr(10)), '' ORDER BY page_id)) AS value FROM pages GROUP BY page_id // 4"


@query("SELECT CAST(page_id // 4 AS VARCHAR) AS path, page_id % 4 + 1 AS page_no, 4 AS pages, CASE WHEN page_id % 3 <> 0 THEN page_id % 50 + 0.5::DOUBLE END AS seconds, concat(url, chr(10), 'second line') AS text FROM pages")
def ocr_dumps(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    time = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Tempo: "), (F.col("page_id") % 50).cast("string"), F.lit(".5s\n"))).otherwise(F.lit(""))
    page = F.concat(F.lit("--- Pagina "), (F.col("page_id") % 4 + 1).cast("string"), F.lit("/4 ---\n"), time, F.col("url"), F.lit("\nsecond line\n\n"))
    files = p.withColumn("s", F.struct("page_id", page.alias("page"))).groupBy(F.floor(F.col("page_id") / 4).cast("string").alias("path"))
    files = files.agg(F.concat(F.lit("head\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["page"]), "")).alias("value"))
    return adapters.parse_ocr_dumps(files)


@query("SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    found = counted_events(table(spark, sf_dir, "events"))
    return found.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query()
def fallback_chain(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), "text")
    lines = view(spark, sf_dir, "markdown").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 == 1, F.lit("# x")).otherwise(F.col("text")).alias("text"))
    return adapters.fallback(d, lines, d.where("page_id % 2 = 0"))


ORACLES["fallback_chain"] = _cte(
    ["markdown"],
    f""", cleaned AS (SELECT doc_id AS id, {q_tidy(q_cleaned("text"))} AS text FROM documents WHERE doc_id % 2 = 0){q_post("cleaned")}
SELECT d.doc_id AS page_id, CASE WHEN m.text IS NOT NULL THEN 'layout' WHEN p.text IS NOT NULL THEN 'ocr' ELSE 'unchanged' END AS source, coalesce(m.text, p.text, d.text) AS text FROM documents d
LEFT JOIN (SELECT doc_id, text FROM markdown WHERE doc_id % 3 = 2 AND length({q_strip("text")}) >= 5) m USING (doc_id) LEFT JOIN (SELECT id, text FROM posted WHERE length({q_strip("text")}) >= 3) p ON p.id = d.doc_id""",
)


@query(f"SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM {Q_NARROW} GROUP BY page_id", ("layout_blocks",))
def narrow_blocks(spark, sf_dir):
    return layout._narrow(view(spark, sf_dir, "layout_blocks")).groupBy("page_id").agg(F.count("*").alias("n"))

