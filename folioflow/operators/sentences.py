"""Sentences of texts, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as T


def closes(token: Column) -> Column:
    """A token that ends in . ! or ? ends a sentence, unless it is an abbreviation, an initial or a number."""
    bare = F.lower(F.regexp_replace(token, r"[.!?]+$", ""))
    other = bare.isin(config.ABBREVIATIONS) | (F.length(bare) == 1) | F.regexp_replace(bare, "[,.]", "").rlike(r"^\p{Nd}+$")
    return F.right(token, F.lit(1)).isin(".", "!", "?") & ~other


def sentence_structs(c: Column | str) -> Column:
    """Sentences of a text as an array of struct(sentence, words), in the text's row: the ends of sentences cut the array of words."""

    def cut(w: Column) -> Column:
        last = F.size(w) - 1
        ends = F.filter(F.transform(w, lambda x, i: F.when(closes(x) | (i == last), i)), lambda i: i.isNotNull())

        def pieces(e: Column) -> Column:
            start = lambda k: F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1)
            piece = lambda end, k: F.slice(w, start(k) + 1, end - start(k) + 1)
            return F.transform(e, lambda end, k: F.struct(F.array_join(piece(end, k), " ").alias("sentence"), (end - start(k) + 1).alias("words")))

        return T.let(ends, pieces)

    return T.let(T.words(c), cut)


def sentence_list(c: Column | str) -> Column:
    return F.transform(sentence_structs(c), lambda s: s["sentence"])


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, sent_no, sentence). Blank and null texts have none. Nothing is shuffled: a text's sentences come from its row."""
    found = df.select(key, *keep, F.posexplode(sentence_structs(text)).alias("sent_no", "s"))
    return found.select(key, *keep, F.col("sent_no").cast("long").alias("sent_no"), F.col("s.sentence").alias("sentence"))


def sentence_counts(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, n, mean_words): sentences of a group's texts and the mean of their words, without making them."""
    s = df.select(by, T.let(sentence_structs(text), lambda x: F.struct(F.size(x).alias("n"), F.aggregate(x, F.lit(0), lambda n, y: n + y["words"]).alias("words"))).alias("s"))
    return s.where(F.col("s.n") > 0).groupBy(by).agg(F.sum("s.n").alias("n"), T.ratio(F.sum("s.words"), F.sum("s.n")).alias("mean_words"))
