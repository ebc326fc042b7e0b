"""Words as columns: normal forms, similarity, tokens, markers and what is shown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SENTENCE_MARKS = ".!?।"
DROPPED_MARKS = ".,!?।"


def normalize_word(word: Column) -> Column:
    """Lower case, letters and digits only; combining marks go."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def similar_normal(na: Column, nb: Column, threshold: float = 0.45) -> Column:
    """``similar`` for words that are in normal form already."""
    longer = F.greatest(F.length(na), F.length(nb))
    # A length gap that alone reaches the threshold is cheaper to see than the distance.
    gap = F.abs(F.length(na) - F.length(nb)) / longer < threshold
    return (na == nb) | ((longer > 2) & gap & (F.levenshtein(na, nb) / longer < threshold))


def similar(a: Column, b: Column, threshold: float = 0.45) -> Column:
    """Equal normal forms, or over two characters and an edit distance under ``threshold`` of the longer one."""
    return similar_normal(normalize_word(a), normalize_word(b), threshold)


def tokens(phrase: Column) -> Column:
    """Words of a phrase; any Unicode white space separates."""
    return F.filter(F.split(phrase, r"(?U)\s+"), lambda x: x != "")


def ends_sentence(word: Column, trim: bool = True) -> Column:
    """Is the last character a sentence mark?  White space after it counts for nothing with ``trim``."""
    marks = f"[{SENTENCE_MARKS}]"
    return F.coalesce(word.rlike(marks + (r"(?U)\s*\z" if trim else r"\z")), F.lit(False))


def display_word(word: Column, roman: Column) -> Column:
    """The romanized word unless it is null or empty, else the word."""
    return F.coalesce(F.nullif(roman, F.lit("")), word, F.lit(""))


def is_ascii(word: Column) -> Column:
    """ASCII only, sentence marks aside."""
    return ~F.translate(word, DROPPED_MARKS, "").rlike(r"[^\x00-\x7F]")


def pass_through(word: Column) -> Column:
    """An ASCII word as its own romanization; null if nothing is left."""
    return F.nullif(F.trim(F.translate(F.lower(word), DROPPED_MARKS, "")), F.lit(""))


@F.pandas_udf(StringType())
def strip_diacritics(words: pd.Series) -> pd.Series:
    """Canonical decomposition without the marks U+0300 to U+036F."""
    marked = ~words.fillna("").map(str.isascii)  # nothing to take off the others
    out = words.copy()
    out[marked] = words[marked].str.normalize("NFD").str.replace("[\u0300-\u036f]", "", regex=True)
    return out


def join_words(words: Column) -> Column:
    """A marker sentence of an array of words: ``[0] w0 [1] w1 ...``."""
    return F.array_join(F.transform(words, lambda w, j: F.concat(F.lit("["), j, F.lit("] "), F.trim(w))), " ")


def split_markers(text: Column) -> Column:
    """The segments after each marker: array of word texts by place."""
    parts = F.split(text, r"\[\d+\]")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.btrim(s))


def clean_roman(text: Column) -> Column:
    """A romanized segment without marks and brackets; null without a Latin letter."""
    clean = F.trim(F.translate(text, DROPPED_MARKS + "[]", ""))
    return F.when(clean.rlike("[a-zA-Z]"), clean)


def model_list(answer: Column) -> Column:
    """A model's JSON list as an array of strings by place.

    Code fences go; an object gives its ``words`` or else its values.  Items that
    are blank or no string are null.  Broken JSON gives null.
    """
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(answer), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    value = F.try_parse_json(bare)
    of_words = F.try_variant_get(value, "$.words", "array<variant>")
    whole = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), of_words, F.map_values(F.try_variant_get(value, "$", "map<string, variant>")))
    # A number must not turn into a string, so each item's own type is asked for.
    item = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.btrim(F.try_variant_get(v, "$", "string")), F.lit("")))
    return F.transform(whole, item)
