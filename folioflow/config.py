"""Thresholds and word lists that decide results."""

from __future__ import annotations

# Results depend on them.
VOWELS = "aeiouAEIOUàèìòùáéíóúäëïöü"
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "inc", "ltd", "fig", "vol", "no", "pp", "ed", "eds", "rev", "col",
    "gen", "gov", "hon", "lt", "sgt", "rep", "sen", "st", "co", "corp", "dept", "div", "dott", "sig", "sig.ra", "avv", "ing",
    "arch", "geom", "nr", "str", "tel", "bzw", "av", "bd", "env", "m", "mme", "mlle",
]
METADATA = ["draft:", "first draft", "version:", "date:", "revised:", "bozza:", "prima bozza", "versione:", "data:", "revisionato:"]
LIST_MARKERS = [
    ("bullet", r"^[•●○◦▪▸▹–—]\s"),
    ("hyphen", r"^-\s(?![0-9])"),
    ("number", r"^\d{1,3}[.)]\s"),
    ("letter", r"^[a-z][.)]\s"),
    ("capital", r"^[A-Z][.)]\s(?![A-Z])"),
    ("roman", r"^(?i:i{1,3}|iv|vi{0,3}|ix|x)[.)]\s"),
    ("number in parentheses", r"^\(\d{1,3}\)\s"),
    ("letter in parentheses", r"^\([a-z]\)\s"),
]
MONO_NAMES = ["Courier", "Mono", "Consolas", "Monaco", "Menlo", "Source Code"]
SERIF_NAMES = ["Times", "Serif", "Georgia", "Garamond", "Palatino", "Cambria"]
#: Before translation, after NFKC.
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'", "„": '"', "‟": '"', "«": '"', "»": '"', "‹": "'", "›": "'"}
DASHES = {"–": "-", "—": "-", "−": "-"}
#: OCR output for a re-set page, after NFKC.
PAGE_QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'", "«": '"', "»": '"', "„": '"', "‚": "'"}
PAGE_DASHES = {"–": "-", "—": "-", "‒": "-", "―": "-", "−": "-", "…": "...", "\u00a0": " ", "\u2003": " ", "\u2002": " ", "\u2009": " "}
DIAGNOSTIC_MARKERS = [
    ("bullet", r"^[•●○◦▪▸▹–—-]\s"),
    ("numbered", r"^\d+[.)]\s"),
    ("lettered", r"^[a-z][.)]\s"),
    ("roman", r"^[ivxlcdm]+[.)]\s"),
    ("cap-lettered", r"^[A-Z][.)]\s"),
]
TYPOGRAPHIC = {"guillemets": "[«»]", "curly_quotes": "[‘’“”]", "en_dash": "–", "em_dash": "—", "ellipsis": "…", "nbsp": " "}
CONTENT_TYPES = ["text", "title", "paragraph_title", "list"]
LANGUAGES = {"English": "en", "Italiano": "it", "Español": "es", "Français": "fr", "Deutsch": "de", "Português": "pt", "Nederlands": "nl"}
#: Of a re-set page: margins as (least points, share of the page) at the sides, the top and the bottom.
MARGINS = {"dense": ((28, 0.04), (30, 0.035), (30, 0.035)), "sparse": ((50, 0.08), (40, 0.045), (40, 0.045)), "normal": ((36, 0.06), (40, 0.045), (40, 0.045))}
#: Space around paragraphs, above and below headings, as shares of the body size; and line height.
SPACING = {"dense": (0.25, 0.5, 0.2, 1.15), "sparse": (0.8, 1.5, 0.6, 1.4), "normal": (0.4, 0.8, 0.3, 1.25)}
HEADING_SCALES = {1: 1.5, 2: 1.3, 3: 1.15}
SMALLER_HEADINGS = 1.05

#: Quality of extracted text.
SHORTEST_TEXT, GOOD_QUALITY, FAIR_QUALITY, FAIR_WORDS = 5, 0.8, 0.5, 15
#: Zones of a page, as shares of its height.
HEADER, FOOTER, FOOTNOTES = 0.08, 0.92, 0.70
SMALL_FONT, FOOTNOTE_FONT = 7.0, 9.5
#: Shortest texts that are translated: any unit, a paragraph of OCR output, a page of markdown.
SHORTEST_UNIT, SHORTEST_OCR, SHORTEST_MARKDOWN = 2, 3, 5

#: Neutral corrections of OCR output (pattern, replacement), in this order: ligatures, digits within words, words run together.
OCR_RULES = [
    ("ﬀ", "ff"),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    (r"([A-Za-z])0([a-z])", "$1o$2"),
    (r"([a-z])1([a-z])", "$1l$2"),
    (r"\b5([a-z]{3})", "S$1"),
    (r"([a-z]{3})([A-Z][a-z]{2})", "$1 $2"),
]
