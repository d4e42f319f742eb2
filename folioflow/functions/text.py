"""Text functions as column expressions: whitespace, quality, cleaning, lists, markup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import config

#: Characters that Python takes for white space, as a part of a character class and as such.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column | str) -> Column:
    """Without white space of any script at its ends."""
    return F.btrim(col(c), F.lit(_SPACES))


def words(c: Column | str) -> Column:
    """Array of maximal runs without white space; empty for blank texts."""
    t = strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+"))


def n_words(c: Column | str) -> Column:
    return count(c, f"[^{SPACE}]+")


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


# quality of extracted text


def single_spaced(c: Column | str) -> Column:
    """Words with one space between them."""
    return F.regexp_replace(strip(c), f"[{SPACE}]+", " ")


def _spaced_counts(t: Column) -> tuple[Column, Column]:
    """Words of a single-spaced text, and characters in words."""
    solid = F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(solid == 0, 0).otherwise(F.length(t) - solid + 1), solid


def quality_parts(c: Column | str) -> Column:
    """struct(short, chars, words, special, single, repeats, vowels, word_length); the text is read once for each."""
    c = col(c)
    whole = F.length(c)

    def parts(t: Column) -> Column:
        n, solid = _spaced_counts(t)
        rare = F.regexp_replace(t, r"""[A-Za-z0-9_.,;:!?'"() \-]+""", "")  # what is left is short
        return F.struct(
            (F.length(strip(c)) < config.SHORTEST_TEXT).alias("short"),
            whole.alias("chars"),
            n.alias("words"),
            ratio(count(rare, r"[^\p{L}\p{N}]"), whole).alias("special"),
            ratio(count(t, r"(?:^| )[^ \p{Nd}](?= |$)"), n).alias("single"),
            count(c, r"(.)\1{4,}").alias("repeats"),
            ratio(whole - F.length(F.translate(c, config.VOWELS, "")), whole).alias("vowels"),
            ratio(solid, n).alias("word_length"),
        )

    return let(single_spaced(c), parts)


def _score(p: Column) -> Column:
    lost = 2.0 * p["special"] + 1.5 * p["single"] + F.least(F.lit(0.3), 0.1 * p["repeats"].cast("double")) + F.when(p["vowels"] < 0.1, F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when(p["chars"].isNull() | p["short"], F.lit(0.0)).otherwise(clamp(1.0 - lost))


def _issues(p: Column) -> Column:
    # fixed values: names and limits of the issues
    found = F.concat_ws(
        "; ",
        F.when(p["special"] > 0.15, "high_special_chars"),
        F.when(p["single"] > 0.3, "fragmented"),
        F.when(p["repeats"] > 2, "repeated_chars"),
        F.when((p["vowels"] < 0.1) & (p["chars"] > 50), "low_vowels"),
        F.when((p["word_length"] < 2.5) | (p["word_length"] > 15), "unusual_word_length"),
    )
    return F.when(p["chars"].isNull() | p["short"], "empty_or_too_short").otherwise(F.coalesce(F.nullif(found, F.lit("")), F.lit("good")))


def quality(c: Column | str) -> Column:
    """struct(score, issues, words) of a text, from parts that are worked out once."""
    return let(quality_parts(c), lambda p: F.struct(_score(p).alias("score"), _issues(p).alias("issues"), F.coalesce(p["words"], F.lit(0)).alias("words")))


def quality_score(c: Column | str) -> Column:
    """0 (garbled, or hardly any text) to 1."""
    return let(quality_parts(c), _score)


def quality_issues(c: Column | str) -> Column:
    """Names of what is wrong, joined by '; '; 'good' if nothing is."""
    return let(quality_parts(c), _issues)


def ocr_confidence(c: Column | str) -> Column:
    t = strip(c)

    def scored(spaced: Column) -> Column:
        n = F.length(t)
        special = ratio(count(F.regexp_replace(spaced, "[A-Za-z0-9 ]+", ""), r"[^\p{L}\p{N}]"), n)
        single = ratio(count(spaced, "(?:^| )[^ ](?= |$)"), _spaced_counts(spaced)[0])
        part = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
        score = F.lit(0.85) + part(n > 100, 0.05) - part(n < 20, 0.2) - part(special > 0.3, 0.2) - part(single > 0.4, 0.15)
        return F.when(n.isNull() | (n < config.SHORTEST_TEXT), F.lit(0.0)).otherwise(clamp(score))

    return let(single_spaced(c), scored)


# cleaning


def corrected(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Rules (pattern, replacement with $1) one after another: later ones see what earlier ones made."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, col(c))


def cleaned_ocr(c: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    """OCR output corrected by rules (config.OCR_RULES unless others are given), then tidied."""
    return tidy(corrected(c, config.OCR_RULES if rules is None else rules))


def tidy(c: Column | str) -> Column:
    """Dot leaders, spacing and blank lines of OCR output."""
    t = corrected(c, [(r"\.{4,}", " ... "), (r"(?U)[^\S\n]+", " "), (r"\n{3,}", "\n\n"), (r" +([.,;:!?])", "$1"), (r"([.,;:!?])(?=[A-Za-z])", "$1 "), (r"(?U)[^\S\n]+(?=\n|$)", "")])
    return strip(t)


def normalize_whitespace(c: Column | str) -> Column:
    """Paragraphs joined by one blank line, each on one line."""
    parts = F.transform(F.split(col(c), r"(?U)\n\s*\n"), lambda p: strip(F.replace(F.regexp_replace(p, r"[ \t]+", " "), F.lit("\n"), F.lit(" "))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def without_artifacts(c: Column | str) -> Column:
    """Without lines that are page numbers, short noise or punctuation; blank lines stay."""
    lines = F.transform(F.split(col(c), "\n", -1), strip)
    noise = lambda s: (s != "") & (s.rlike(r"^\p{Nd}+$") | ((F.length(s) < 3) & ~s.rlike(r"^\p{L}+$")) | s.rlike(r"^[^\p{L}\p{N}_]+$"))
    return F.array_join(F.filter(lines, lambda s: ~noise(s)), "\n")


def strip_markdown(c: Column | str) -> Column:
    rules = [(r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}(.*?)\*{1,3}", "$1"), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n")]
    return strip(corrected(c, rules))


def cjk(c: Column | str) -> Column:
    return count(c, r"[一-鿿぀-ゟ゠-ヿ]")


def typographic(c: Column | str) -> dict[str, Column]:
    return {name: count(c, pattern) for name, pattern in config.TYPOGRAPHIC.items()}


def mapped(c: Column | str, maps: dict[str, str]) -> Column:
    """Characters replaced by what the map has for them, single characters in one pass."""
    single = {a: b for a, b in maps.items() if len(b) == 1}
    out = F.translate(col(c), "".join(single), "".join(single.values()))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [p for p in maps.items() if p[0] not in single], out)


def language_code(name: Column | str) -> Column:
    """ISO code of a language's name; English for unknown ones."""
    codes = F.create_map(*[F.lit(x) for pair in config.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.coalesce(col(name), F.lit(""))), F.lit("en"))


def protect_terms(c: Column | str, terms: list[str]) -> Column:
    """struct(text, terms): each term that occurs replaced by [[TERMi]], i its place in the list, one after another; terms maps places to what stood there."""
    text, kept = col(c), []
    for i, term in enumerate(terms):
        place = f"[[TERM{i}]]"
        kept.append(F.when(F.contains(text, F.lit(term)), F.struct(F.lit(place).alias("key"), F.lit(term).alias("value"))))
        text = F.replace(text, F.lit(term), F.lit(place))
    found = F.array_compact(F.array(*kept)) if kept else F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(text.alias("text"), F.map_from_entries(found).alias("terms"))


def restore_terms(c: Column | str, terms: Column | str) -> Column:
    return F.aggregate(F.map_entries(col(terms)), col(c), lambda t, e: F.replace(t, e["key"], e["value"]))


def capital_sentences(c: Column | str) -> Column:
    """Sentences that end where a mark, white space and an ASCII capital follow each other; trimmed, none blank."""
    return F.filter(F.transform(F.split(col(c), f"(?<=[.!?])[{SPACE}]+(?=[A-Z])"), strip), lambda x: x != "")


def might_contain_table(c: Column | str) -> Column:
    c = col(c)
    aligned = F.size(F.filter(F.split(c, "\n", -1), lambda x: F.contains(strip(x), F.lit("   "))))
    return (count(c, r"\|") > 4) | F.contains(c, F.lit("\t")) | (aligned > 3)


def title_like(c: Column | str) -> Column:
    """Short texts, not ending in a mark, in title case (capitals only where no letter precedes, small letters only where one does) or capitals."""
    t = strip(c)
    upper = t.rlike(r"\p{IsUppercase}|\p{Lt}")
    title = upper & ~t.rlike(r"(?:^|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}])\p{IsLowercase}|[\p{IsUppercase}\p{IsLowercase}\p{Lt}][\p{IsUppercase}\p{Lt}]")
    capitals = t.rlike(r"\p{IsUppercase}") & ~t.rlike(r"\p{IsLowercase}|\p{Lt}")
    return (t != "") & (F.length(t) < 50) & (n_words(t) <= 8) & ~F.right(t, F.lit(1)).isin(".", ",", ";", ":") & (title | capitals)


# lists


def list_kind(c: Column | str) -> Column:
    """Name of the first list marker that fits; null if none does."""
    t = strip(c)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(name)) for name, p in config.LIST_MARKERS])


def diagnostic_list_kind(c: Column | str) -> Column:
    """The same by the diagnostic report's fewer patterns."""
    t = strip(c)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(name)) for name, p in config.DIAGNOSTIC_MARKERS])


def is_list_item(c: Column | str) -> Column:
    return list_kind(c).isNotNull()


def list_prefix(c: Column | str) -> Column:
    """The marker with its white space, or null."""
    t = strip(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(t, f"({p})", 1), F.lit("")) for _, p in config.LIST_MARKERS])


def list_body(c: Column | str) -> Column:
    return F.substr(strip(c), F.coalesce(F.length(list_prefix(c)), F.lit(0)) + 1)


# HTML


def escape(c: Column | str) -> Column:
    """&, < and > only."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], col(c))


def strip_tags(c: Column | str) -> Column:
    """Without tags; four entities read, & last, so that an escaped entity stays one."""
    t = F.regexp_replace(col(c), r"<[^>]+>", "")
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")], t)


def escape_quotes(c: Column | str) -> Column:
    """&, <, > and both quotes."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [('"', "&quot;"), ("'", "&#x27;")], escape(c))


def simple_html(c: Column | str) -> Column:
    """Markdown lines as headings or paragraphs, one each; blank and table lines go, and quotes are escaped."""

    def line_html(x: Column) -> Column:
        level = F.length(F.regexp_extract(x, rf"^(#{{1,6}})[{SPACE}]", 1)).cast("string")
        body = escape_quotes(F.regexp_replace(x, rf"^#{{1,6}}[{SPACE}]+", ""))
        heading = F.concat(F.lit("<h"), level, F.lit(">"), body, F.lit("</h"), level, F.lit(">"))
        return F.when(x.rlike(rf"^#{{1,6}}[{SPACE}]"), heading).otherwise(F.concat(F.lit("<p>"), escape_quotes(x), F.lit("</p>")))

    lines = F.filter(F.transform(F.split(col(c), "\n", -1), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("|")))
    return F.array_join(F.transform(lines, line_html), "\n")


# tables of markdown


def cells(c: Column | str) -> Column:
    """Trimmed cells of a table line, without one empty cell at each end."""
    parts = F.transform(F.split(strip(c), r"\|", -1), strip)
    parts = F.when(F.element_at(parts, 1) == "", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1) == "").otherwise(False)
    return F.when(last, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def table_html(c: Column | str) -> Column:
    row = lambda line, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(line), lambda x: F.when(i == 0, F.concat(F.lit("<th>"), escape(x), F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), escape(x), F.lit("</td>")))), ""), F.lit("</tr>"))
    lines = F.filter(F.split(col(c), "\n"), lambda x: strip(x) != "")
    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(lines, row), "\n"), F.lit("\n</table>"))


def translated(c: Column) -> Column:
    """The mock translation, which marks what was asked for."""
    return F.concat(F.lit("[TR] "), c)


def translated_after_prefix(c: Column | str, translate: Callable[[Column], Column] = translated) -> Column:
    """A line translated with its list marker kept; a blank result keeps the line or its body."""
    prefix = list_prefix(c)
    other = lambda new, old: F.when(F.coalesce(strip(new), F.lit("")) == "", old).otherwise(new)
    body = list_body(c)
    return F.when(prefix.isNotNull(), F.concat(prefix, other(translate(strip(body)), body))).otherwise(other(translate(col(c)), col(c)))


def translated_paragraph(lines: Column | str, translate: Callable[[Column], Column] = translated) -> Column:
    """Lines (an array, the first one not null) translated as one text, which keeps the first line's list marker; null if the result is blank: then each line is translated by itself."""
    lines = col(lines)
    first = strip(lines[0])
    prefix = list_prefix(first)
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    whole = F.when(prefix.isNotNull(), F.array_join(F.concat(F.array(strip(list_body(first))), rest), " ")).otherwise(F.array_join(lines, " "))
    new = translate(whole)
    return F.when(strip(new) != "", F.concat(F.coalesce(prefix, F.lit("")), new))


def translated_table(c: Column | str) -> Column:
    cell = lambda x: F.when(F.length(strip(x)) >= 2, translated(x)).otherwise(x)
    row = lambda line: F.concat(F.lit("| "), F.array_join(F.transform(cells(line), cell), " | "), F.lit(" |"))
    return F.array_join(F.transform(F.split(col(c), "\n"), row), "\n")


# words over lines


def distributed(sentence: Column, lines: Column) -> Column:
    """The words over so many lines, evenly, the first lines longer by one; blank lines after a few words."""
    w = words(sentence)
    n = F.size(w)
    base, extra = F.floor(n / lines), n % lines
    start = lambda i: F.when(n <= lines, i).otherwise(i * base + F.least(i, extra))
    size = lambda i: F.when(n <= lines, (i < n).cast("long")).otherwise(base + (i < extra).cast("long"))
    return F.transform(F.sequence(F.lit(0), lines - 1), lambda i: F.array_join(F.slice(w, (start(i) + 1).cast("int"), size(i).cast("int")), " "))


# links


URL = r"""(?U)https?://[^\s<>"]+|www\.[^\s<>"]+"""


def protect_urls(c: Column | str) -> Column:
    """struct(text, urls): each URL replaced by [URLn], n from 0."""
    urls = F.regexp_extract_all(col(c), F.lit(f"({URL})"), 1)
    pieces = F.split(col(c), URL, -1)
    marked = F.transform(pieces, lambda p, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("[URL"), (i - 1).cast("string"), F.lit("]"))), p))
    return F.struct(F.array_join(marked, "").alias("text"), urls.alias("urls"))


def restore_urls(c: Column | str, urls: Column | str) -> Column:
    """Places [URLn] filled again, also where a translation has spaced or changed them in case; highest number first."""
    numbered = F.reverse(F.transform(col(urls), lambda u, i: F.struct(i.alias("i"), u.alias("u"))))
    put = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?i)\[?\s*URL\s*"), x["i"].cast("string"), F.lit(r"(?![0-9])\s*\]?")), F.regexp_replace(x["u"], r"([\\$])", r"\\$1"))
    return F.aggregate(numbered, col(c), put)
