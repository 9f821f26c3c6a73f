"""Scores of speech transcripts; the language is an input column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pystrip, text_of

DEVANAGARI = r"[ऀ-ॿ]"
ARABIC = r"[؀-ۿ]"
LATIN = r"[A-Za-z]"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def quality_penalty(text: Column) -> Column:
    """Long runs of one character, few distinct words, and very long words."""
    t = pystrip(text_of(text))
    words = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n = F.greatest(F.lit(1), F.size(words))
    distinct = F.size(F.array_distinct(F.transform(words, F.lower))) / n
    average = F.aggregate(words, F.lit(0), lambda s, w: s + F.char_length(w)) / n
    some = F.size(words) > 0
    runs = count_of(t, r"(.)\1{5,}") * 4.0
    few = F.when(some & (distinct < 0.45), (0.45 - distinct) * 8.0).otherwise(0.0)
    long_ = F.when(some & (average > 18), F.least(F.lit(3.0), (average - 18.0) * 0.5)).otherwise(0.0)
    return F.when(t == "", 1000.0).otherwise(runs + few + long_)


def candidate_score(text: Column, asked: Column, detected: Column) -> Column:
    t = text_of(text)
    language = F.when(detected == "hi", 1.2).when(detected == "en", 1.0).otherwise(0.0)
    agree = F.when((asked == "hi") & (detected == "hi"), 0.4).otherwise(0.0)
    latin = F.when(asked == "en", 0.1 * count_of(t, LATIN)).otherwise(0.0)
    score = 0.02 * F.char_length(t) + 0.35 * count_of(t, DEVANAGARI) - 0.6 * count_of(t, ARABIC) + language + agree + latin - quality_penalty(t)
    return F.when(t == "", -1e6).otherwise(score)


def good_enough(text: Column, detected: Column) -> Column:
    t = pystrip(text_of(text))
    script = count_of(t, DEVANAGARI) + count_of(t, LATIN)
    n = F.char_length(t)
    short = (n <= 80) & (script >= F.greatest(F.lit(2), F.floor(n * 0.35)))
    return (t != "") & (count_of(t, ARABIC) == 0) & (quality_penalty(t) < 2.0) & (script > 0) & (F.coalesce(detected.isin("en", "hi"), F.lit(False)) | short)


def best_candidate(auto: Column, hi: Column, en: Column) -> Column:
    """The best of three structs (text, detected); an English pass much shorter than the others loses 5."""
    longest = F.greatest(F.char_length(text_of(auto["text"])), F.char_length(text_of(hi["text"])))
    short = (longest >= 20) & (F.char_length(text_of(en["text"])) < F.floor(0.75 * longest))
    scored = [
        F.struct(candidate_score(auto["text"], F.lit("auto"), auto["detected"]).alias("score"), F.lit(2).alias("first"), F.lit("auto").alias("lang"), auto["text"].alias("text")),
        F.struct(candidate_score(hi["text"], F.lit("hi"), hi["detected"]).alias("score"), F.lit(1).alias("first"), F.lit("hi").alias("lang"), hi["text"].alias("text")),
        F.struct((candidate_score(en["text"], F.lit("en"), en["detected"]) - F.when(short, 5.0).otherwise(0.0)).alias("score"), F.lit(0).alias("first"), F.lit("en").alias("lang"), en["text"].alias("text")),
    ]
    return F.greatest(*scored)
