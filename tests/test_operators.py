"""Worked examples of operators, and properties over generated input."""

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import elements as E
from folioflow.operators import folds, layout, metrics, reports, spans
from folioflow.operators.sentences import sentences
from folioflow.sources import adapters
from folioflow.streaming.batches import event_counts, translate_stream

WORDS = st.lists(st.sampled_from(["a", "bb", "ccc", "d."]), max_size=12)


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "text string").select(*columns).first())


def test_markdown_has_seven_elements(spark):
    md = "# Title\n\nFirst line\nof a paragraph.\n\n## Part\n| a | b | c |\n|---|:-:|---|\n| 1 | 2 | 3 |\nText after\n![image](x.png)\nstill it\n\n### Deep\n\nLast."
    rows = E.elements(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("elem_no").collect()
    assert [(r.type, r.level, r.text) for r in rows] == [
        ("heading", 1, "Title"), ("paragraph", 0, "First line of a paragraph."), ("heading", 2, "Part"), ("table", 0, "| a | b | c |\n| 1 | 2 | 3 |"),
        ("paragraph", 0, "Text after still it"), ("heading", 3, "Deep"), ("paragraph", 0, "Last."),
    ]


def test_quality_of_odd_texts(spark):
    score = T.quality_score("text")
    assert one(spark, None, score, T.quality_issues("text")) == (0.0, "empty_or_too_short")
    assert one(spark, "    \n ", score)[0] == 0.0
    assert one(spark, "A plain sentence of ordinary words.", T.quality_issues("text"))[0] == "good"
    assert one(spark, "@@##$$%%^^&&**~~@@##", score)[0] == 0.0


def test_cleaning(spark):
    assert one(spark, "Part ......... 5 , and\t more .So\n\n\n\nEnd  \n", T.tidy("text"))[0] == "Part... 5, and more. So\n\nEnd"  # the later rule on punctuation closes the gap
    assert one(spark, "a  b\nc\n \n\n d ", T.normalize_whitespace("text"))[0] == "a b c\n\nd"
    assert one(spark, "12\nx\n--\nkept\n\n", T.without_artifacts("text"))[0] == "x\nkept\n\n"
    once = one(spark, "a  b\n\n\nc", T.normalize_whitespace("text"), T.normalize_whitespace(T.normalize_whitespace("text")))
    assert once[0] == once[1]
    assert folds.repair("com-\nputer science\nend-\nall") == "computer\nscience\nendall\n"


def test_entities_are_read_once(spark):
    assert one(spark, "<b>&amp;lt;</b>", T.strip_tags("text"))[0] == "&lt;"


def test_lists(spark):
    for text, kind, body in [("• x", "bullet", "x"), ("- 5", None, "- 5"), ("- x", "hyphen", "x"), ("12) x", "number", "x"), ("A. X", None, "A. X"), ("IV. x", "roman", "x"), ("(b) x", "letter in parentheses", "x")]:
        assert one(spark, text, T.list_kind("text"), T.list_body("text")) == (kind, body), text


def test_urls_return(spark):
    p = T.protect_urls("text")
    text = "see http://a.b/c$1?x and www.d.e, or " + " ".join(f"http://h{i}.x" for i in range(12))
    got = spark.createDataFrame([(text,)], "text string").select(p.alias("p")).select("p.text", T.restore_urls("p.text", "p.urls").alias("back")).first()
    assert got.text.startswith("see [URL0] and [URL1] or [URL2]") and got.back == text


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Mr. Smith came. He paid 3.14. for J. Doe! Then left"), (2, " "), (3, None)], "doc_id long, text string")
    assert [r.sentence for r in sentences(df).orderBy("doc_id", "sent_no").collect()] == ["Mr. Smith came.", "He paid 3.14. for J. Doe!", "Then left"]


def aligned(sentences: list[str], lines: int) -> list[str]:
    """Sentences over lines: merged where there are more of them, else their words spread."""
    if lines <= 0 or not sentences:
        return [" ".join(sentences)] if lines <= 0 and sentences else [""] * max(lines, 0)
    if len(sentences) <= lines:
        return list(sentences) if len(sentences) == lines else spread(" ".join(sentences), lines)
    out, start = [], 0
    for k in range(1, lines + 1):
        end = len(sentences) if k == lines else max(round(k * (len(sentences) / lines)), start + 1)
        out.append(" ".join(sentences[start:end]))
        start = end
    return out


def spread(sentence: str, lines: int) -> list[str]:
    w = sentence.split()
    base, extra = divmod(len(w), lines)
    if lines == 1 and w:
        return [sentence]
    if len(w) <= lines:
        return w + [""] * (lines - len(w))
    ends = [base * k + min(k, extra) for k in range(lines + 1)]
    return [" ".join(w[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


@given(WORDS, st.integers(1, 8))
def test_spreading_keeps_words(words, lines):
    got = spread(" ".join(words), lines)
    assert len(got) == lines and " ".join(got).split() == words


@given(WORDS, st.integers(1, 8))
def test_alignment_keeps_words(words, lines):
    got = aligned(words, lines)
    assert len(got) == lines and " ".join(got).split() == " ".join(words).split()


@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(6, 40))
def test_shares_add_up(counts, total):
    got = folds.shares(counts, total)
    assert sum(got) == total and all(n >= 1 for n in got[:-1])


def test_alignment_in_spark(spark):
    rows = [([f"s{i} x" for i in range(n)], k) for n in range(23) for k in range(7)]
    df = spark.createDataFrame(rows, "s array<string>, k int").withColumn("got", folds.align_sentences("s", F.col("k")))
    assert all(r.got == aligned(list(r.s), r.k) for r in df.collect())


def test_distribution_in_spark(spark):
    rows = [(" ".join("abcdefghij"[:n]), k) for n in range(11) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "s string, k int").withColumn("got", T.distributed(F.col("s"), F.col("k")))
    assert all(r.got == ([r.s] if r.k == 1 and r.s else spread(r.s, r.k)) for r in df.collect())


def test_rows_are_anchored():
    assert folds.visual_rows([0, 4, 8, 12, 16], 5) == [0, 0, 1, 1, 2]


def boxes(two_columns):
    rows = [(1, 0, "wide title", 50, 750, 10, 24)]
    for k in range(8):
        rows.append((1, 2 * k + 1, f"l{k}", 60, 300, 60 + 20 * k, 74 + 20 * k))
        if two_columns:
            rows.append((1, 2 * k + 2, f"r{k}", 450, 700, 60 + 20 * k, 74 + 20 * k))
    rows.append((1, 99, "foot", 60, 740, 400, 414))
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(["page_id", "box_no", "txt", "x_min", "x_max", "y_min", "y_max"])} | {"width": [800.0] * len(rows)})
    return next(folds.page_boxes(table))


def test_reading_order():
    got = folds.ordered_text(boxes(True)).split()
    assert got == ["wide", "title", *[f"l{k}" for k in range(8)], *[f"r{k}" for k in range(8)], "foot"]
    assert len(folds.gap_columns(boxes(True))) == 2 and folds.gap_columns(boxes(False)) == [(0.0, 800.0)]


def test_formats_on_translations():
    segments = [("The", False, False), ("important", True, False), ("word here", False, False)]
    assert folds.formatted(segments, "La importante parola") == "La <b>importante</b> parola"
    assert folds.formatted(segments, "x y z q") == "x <b>y</b> z q"
    assert folds.formatted([("a", True, True)], "b < c") == "<b><i>b &lt; c</i></b>"


def test_packing():
    assert folds.packed(["a" * 1600, "b", "c"], 1500) == ["", "a" * 1600, "b c"]
    assert folds.packed(["a" * 700, "b" * 800, "c"], 1500) == ["a" * 700 + " " + "b" * 800, "c"] and folds.packed([]) == []


PLAIN_MAP = {"“": '"', "”": '"', "‘": "'", "’": "'", "„": '"', "‟": '"', "«": '"', "»": '"', "‹": "'", "›": "'", "–": "-", "—": "-", "−": "-"}
PAGE_MAP = {"“": '"', "”": '"', "‘": "'", "’": "'", "«": '"', "»": '"', "„": '"', "‚": "'", "–": "-", "—": "-", "‒": "-", "―": "-", "−": "-"}


def test_characters_of_both_normalizations(spark):
    """Every character from U+00A0 to U+2300, against the standard library and maps written out here."""
    import unicodedata

    rows = [(chr(c),) for c in range(0xA0, 0x2300)] + [("ﬁ",), ("ﬄ",), ("½",)]
    got = spark.createDataFrame(rows, "t string").select("t", folds.normalized_for_translation("t").alias("mt"), folds.normalized_for_page("t").alias("ocr"), folds.normalized_for_page("t", ocr=False).alias("native")).collect()
    for r in got:
        plain = unicodedata.normalize("NFKC", r.t)
        assert r.native == plain
        assert r.mt == "".join(PLAIN_MAP.get(x, x) for x in plain), r.t
        assert r.ocr == "".join(PAGE_MAP.get(x, x) for x in plain), r.t


@given(st.lists(st.text(st.sampled_from("aAéÉßǅ1 .,;:-ª'"), max_size=12), max_size=12))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_title_case_is_pythons(spark, values):
    def plain(t):
        t = t.strip()
        return bool(t) and len(t) < 50 and len(t.split()) <= 8 and t[-1] not in ".,;:" and (t.istitle() or t.isupper())

    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", T.title_like("t").alias("x")).collect()
    assert {r.k: r.x for r in got} == {k: plain(v) for k, v in enumerate(values)}


def test_engines_fall_back(spark):
    class FakeOcr:
        def is_available(self):
            return True

        def recognize_text(self, image, mode="text"):
            if image == b"bad":
                raise RuntimeError
            text = image.decode()
            return (f"| {text} |", 0.9 if "sure" in text else 0.1) if mode == "table" else (text, 0.5)

    class FakeLayout:
        def extract_page_markdown(self, pdf, page_num):
            return ("# " + pdf.decode() if page_num else "#", {})

    images = spark.createDataFrame([(1, bytearray(b"plain text")), (2, bytearray(b"a|b|c|d|e|f sure")), (3, bytearray(b"a|b|c|d|e|f")), (4, bytearray(b"bad")), (5, None)], "page_id long, image binary")
    ocr = adapters.read_scans(images, FakeOcr())
    assert {r.page_id: r.text for r in ocr.collect()} == {1: "plain text", 2: "| a|b|c|d|e|f sure |", 3: "a|b|c|d|e|f", 4: None, 5: None}
    pages = spark.createDataFrame([(1, (bytearray(b"one"), 0)), (2, (bytearray(b"two"), 1)), (4, None)], "page_id long, image struct<pdf: binary, page_no: int>")
    layouts = adapters.read_layouts(pages, FakeLayout())
    assert {r.page_id: r.text for r in layouts.collect()} == {1: None, 2: "# two", 4: None}
    got = adapters.fallback(spark.createDataFrame([(k, f"page {k}") for k in (1, 2, 4, 6)], "page_id long, text string"), layouts, ocr)
    assert {r.page_id: (r.source, r.text) for r in got.collect()} == {1: ("ocr", "plain text"), 2: ("layout", "# two"), 4: ("unchanged", "page 4"), 6: ("unchanged", "page 6")}


def test_languages_have_english_on_one_side():
    import pytest

    assert adapters.model_pair("it", "en") == ("it", "en")
    for pair in (("it", "fr"), ("en", "en"), ("en", "xx")):
        with pytest.raises(ValueError):
            adapters.model_pair(*pair)
    assert isinstance(adapters.translator_of("en", "nl", lambda a, b: adapters.IdentityTranslator()), adapters.IdentityTranslator)


def test_files_are_listed_once_and_parsed(spark, tmp_path):
    import json

    import pytest

    (tmp_path / "in").mkdir()
    for name, body in [("b.pdf", "two pages"), ("in/a.pdf", "one"), ("c.txt", "x")]:
        (tmp_path / name).write_text(body)
    found = [r.path.rsplit("/", 1)[1] for r in adapters.list_files(spark, [str(tmp_path), str(tmp_path / "in")]).collect()]
    assert found == ["b.pdf", "a.pdf"]
    pages = adapters.read_pdfs(spark, str(tmp_path), lambda content: [{"word": w} for w in content.decode().split()])
    assert sorted((r.path.rsplit("/", 1)[1], r.page_no, json.loads(r.page)["word"]) for r in pages.collect()) == [("a.pdf", 0, "one"), ("b.pdf", 0, "two"), ("b.pdf", 1, "pages")]
    (tmp_path / "broken.pdf").write_text(" ")
    with pytest.raises(Exception, match="broken.pdf"):
        adapters.read_pdfs(spark, str(tmp_path), lambda content: [{"first": content.decode().split()[0]}]).collect()


def test_page_numbers_are_checked(spark):
    import pytest

    pages = spark.createDataFrame([(["a", "b"],)], "pages array<string>")
    assert pages.select(metrics.page_at(F.col("pages"), F.lit(1))).first()[0] == "b"
    for wrong in (2, -1):
        with pytest.raises(Exception, match="no page"):
            pages.select(metrics.page_at(F.col("pages"), F.lit(wrong))).collect()


def test_report_lines_are_written(spark, tmp_path):
    lines = reports.table_report(spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), ["k", "v"])
    adapters.write_report(lines.coalesce(1), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 | -", "2 | x"]


def test_corrections_see_earlier_ones(spark):
    assert one(spark, "ﬁ x", T.corrected("text", [("ﬁ", "fl"), ("fl", "z")]))[0] == "z x"
    assert one(spark, "5ection c0ntract ofﬁce JohnSmith theName", T.cleaned_ocr("text"))[0] == "Section contract office John Smith the Name"


def test_first_seen_margin_wins(spark):
    rows = [(1, 0, k, "x" * 40, x0, 500.0 + k) for k, x0 in enumerate([70.0, 90.0, 90.0, 70.0])]
    got = layout.alignment(spark.createDataFrame(rows, "page_id long, block_no long, line_no long, text string, x0 double, x1 double"), 595).first()
    assert (got.left_margin, got.alignment) == (70.0, "justify")


def test_scans(spark):
    schema = "page_id long, width double, height double, images array<struct<x0:double,y0:double,x1:double,y1:double>>, text string"
    rows = [(1, 10.0, 10.0, [(0.0, 0.0, 10.0, 6.0)], "few words"), (2, 10.0, 10.0, [(0.0, 0.0, 10.0, 3.0)] * 2, "few words"), (3, 0.0, 10.0, [], ""), (4, 10.0, 10.0, [(0.0, 0.0, 1.0, 1.0)], "abc")]
    got = {r.page_id: r.scanned for r in layout.scanned(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    assert {r.page_id: r.scanned for r in layout.scanned(spark.createDataFrame(rows, schema), audit=True).collect()}[2]


def test_rotation(spark):
    import math

    rows = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (0, 90, 180, 270, 44)]
    got = [r[0] for r in spark.createDataFrame(rows, "c double, s double").select(spans.rotation(F.col("c"), F.col("s"))).collect()]
    assert got == [0, 270, 180, 90, 0]


def test_sampled_pages(spark):
    got = metrics.sampled_pages(spark.createDataFrame([(1, 3), (2, 50), (3, 5), (4, 0)], "doc_id long, n_pages int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (2, 20), (2, 25), (3, 1), (3, 2), (3, 3), (3, 5)]


def test_failed_translations_keep_the_source(spark):
    class Fails:
        def translate(self, texts):
            raise RuntimeError

    units = spark.createDataFrame([(1, 0, "some text"), (1, 1, "x"), (1, 2, None)], "page_id long, unit_no int, source string")
    assert [r.translated for r in adapters.translate(units, Fails()).collect()] == ["some text", "x", None]
    assert [r.translated for r in adapters.translate(units, adapters.MarkTranslator()).collect()] == ["[TR] some text", "x", None]


def test_models_are_few():
    made = []
    for k in (1, 2, 3, 4, 1, 5, 2):
        adapters.cached(k, lambda k=k: made.append(k) or adapters.MarkTranslator())
    assert made == [1, 2, 3, 4, 5, 2]


def test_ocr_dumps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head\n--- Pagina 1/2 ---\nTempo: 1.5s\nline one\nline two\n\n--- Pagina 2/2 ---\nTempo: 2s\nlast\n")
    got = adapters.read_ocr_dumps(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r.page_no, r.pages, r.seconds, r.text) for r in got] == [(1, 2, 1.5, "line one\nline two"), (2, 2, 2.0, "last")]


def test_stream_resumes(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put = lambda ids: spark.createDataFrame([(i, 0, f"text {i}") for i in ids], "page_id long, unit_no int, source string").coalesce(1).write.mode("append").parquet(source)
    seen = []
    for ids in ([1, 2], [2, 3]):
        put(ids)
        translate_stream(spark, source, sink, mark, adapters.MarkTranslator(), progress=lambda n, k: seen.append((n, k))).awaitTermination()
    assert sorted((r.page_id, r.translated) for r in spark.read.parquet(sink).collect()) == [(i, f"[TR] text {i}") for i in (1, 2, 3)]
    assert seen == [(0, 2), (1, 1)]


def test_events_by_window(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    assert event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_images_and_columns_of_engines(spark):
    class Draws:
        def render(self, pdf, page_num, zoom):
            return pdf + b"!" * page_num, int(100 * zoom), 1 // (2 - page_num)

    class Tools:
        def size(self, image):
            return (6000, 3) if image.startswith(b"big") else (1 // (len(image) - 3), 9)

        def prepare(self, image, crop_below, width, height, pad, contrast, sharpness):
            return f"{width}x{height}".encode()

    class Halves:
        def columns(self, blocks, width):
            return [(0, width / 2), (width / 2, width)] if len(blocks) > 1 else [(0, width)]

    pages = spark.createDataFrame([(1, (bytearray(b"big"), 1)), (2, (bytearray(b"x"), 2)), (3, None)], "page_id long, image struct<pdf: binary, page_no: int>")
    drawn = adapters.render_pages(pages, Draws(), 1.5)
    assert {r.page_id: (bytes(r.image), r.width) if r.image else None for r in drawn.collect()} == {1: (b"big!", 150), 2: None, 3: None}
    images = spark.createDataFrame([(1, bytearray(b"big")), (2, bytearray(b"bad")), (3, None)], "page_id long, image binary")
    assert {r.page_id: r.image and bytes(r.image) for r in adapters.prepared_images(images, Tools()).collect()} == {1: b"3000x1", 2: b"bad", 3: None}
    assert [r.page_id for r in adapters.side_by_side(images, images.where("page_id = 2")).collect()] == [2]
    blocks = spark.createDataFrame([(1, "text", float(k), 0.0, k + 1.0, 1.0, 600.0) for k in range(2)] + [(2, "text", 0.0, 0.0, 1.0, 1.0, 600.0)], "page_id long, type string, x0 double, y0 double, x1 double, y1 double, width double")
    assert sorted(map(tuple, adapters.native_columns(blocks, Halves()).collect())) == [(1, 0, 0.0, 300.0), (1, 1, 300.0, 600.0), (2, 0, 0.0, 600.0)]
    assert adapters.native_columns(blocks).count() == 0
