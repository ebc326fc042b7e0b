"""Language codes, scripts and the romanization of Telugu."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions.text import DROPPED_MARKS

# Spoken-language names and locale codes to two-letter codes.
SHORT_CODES = {
    "en-in": "en", "hi-in": "hi", "te-in": "te", "ta-in": "ta", "kn-in": "kn", "ml-in": "ml", "bn-in": "bn", "gu-in": "gu", "mr-in": "mr", "pa-in": "pa", "od-in": "or",
    "telugu": "te", "hindi": "hi", "tamil": "ta", "kannada": "kn", "malayalam": "ml", "bengali": "bn", "gujarati": "gu", "marathi": "mr", "punjabi": "pa", "odia": "or", "english": "en",
}

# Two-letter codes to locale codes.
LOCALES = {"te": "te-IN", "hi": "hi-IN", "ta": "ta-IN", "kn": "kn-IN", "ml": "ml-IN", "bn": "bn-IN", "gu": "gu-IN", "mr": "mr-IN", "pa": "pa-IN", "or": "od-IN"}

# Locale codes by the first code point of their script's block (each of 128), in order of preference.
SCRIPTS = (("te-IN", 0x0C00), ("hi-IN", 0x0900), ("ta-IN", 0x0B80), ("kn-IN", 0x0C80), ("ml-IN", 0x0D00), ("bn-IN", 0x0980), ("gu-IN", 0x0A80), ("pa-IN", 0x0A00))

# Telugu consonants (without their inherent vowel), vowels and signs in Latin letters.
CONSONANTS = {
    "క": "k", "ఖ": "kh", "గ": "g", "ఘ": "gh", "ఙ": "ng", "చ": "ch", "ఛ": "chh", "జ": "j", "ఝ": "jh", "ఞ": "ny",
    "ట": "t", "ఠ": "th", "డ": "d", "ఢ": "dh", "ణ": "n", "త": "t", "థ": "th", "ద": "d", "ధ": "dh", "న": "n",
    "ప": "p", "ఫ": "ph", "బ": "b", "భ": "bh", "మ": "m", "య": "y", "ర": "r", "ల": "l", "వ": "v",
    "శ": "sh", "ష": "sh", "స": "s", "హ": "h", "ళ": "l", "ఱ": "r",
}
VOWELS = {"అ": "a", "ఆ": "aa", "ఇ": "i", "ఈ": "ee", "ఉ": "u", "ఊ": "oo", "ఋ": "ru", "ఎ": "e", "ఏ": "e", "ఐ": "ai", "ఒ": "o", "ఓ": "o", "ఔ": "au"}
SIGNS = {"ా": "aa", "ి": "i", "ీ": "ee", "ు": "u", "ూ": "oo", "ృ": "ru", "ె": "e", "ే": "e", "ై": "ai", "ొ": "o", "ో": "o", "ౌ": "au", "్": "", "ఁ": ""}
CODAS = {"ం": "m", "ః": "h"}

TELUGU = r"[\x{0C00}-\x{0C7F}]"
_INHERENT = "\u0001"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def short_code(code: Column, strict_reference: bool = False) -> Column:
    """Two-letter code of a language name or locale code, else the part before the hyphen.

    Locale codes match in any case; ``strict_reference`` leaves them to the hyphen
    rule, so that od-IN gives od.
    """
    known = {k: v for k, v in SHORT_CODES.items() if not (strict_reference and "-" in k)}
    return F.coalesce(F.try_element_at(_map(known), F.lower(code)), F.lower(F.split_part(code, F.lit("-"), F.lit(1))))


def script_rank(text: Column) -> Column:
    """Place in SCRIPTS of the first script, in order of preference, that the text has a character of; else null."""
    out = None
    for rank, (_, first) in enumerate(SCRIPTS):
        has = text.rlike(rf"[\x{{{first:04X}}}-\x{{{first + 0x7F:04X}}}]")
        out = F.when(has, rank) if out is None else out.when(has, rank)
    return out


def script_locale(text: Column) -> Column:
    """Locale of that script."""
    return F.get(F.array(*[F.lit(locale) for locale, _ in SCRIPTS]), script_rank(text))


def resolve_script(code: Column, rank: Column) -> Column:
    """A code with a hyphen as it is, a short code by its locale, else the locale of the script at this rank."""
    by_script = F.get(F.array(*[F.lit(locale) for locale, _ in SCRIPTS]), rank)
    return F.coalesce(F.when(F.contains(code, F.lit("-")), code), F.try_element_at(_map(LOCALES), code), by_script)


def resolve_language(code: Column, text: Column) -> Column:
    """The same for a whole text."""
    return resolve_script(code, script_rank(text))


def romanize_telugu(word: Column, keep: str = r"[a-zA-Z0-9\s.,!?'-]") -> Column:
    """Telugu letters in Latin ones: a consonant without a sign after it takes an ``a``.

    Other characters stay if they match ``keep`` (``[\\x00-\\x7F]`` keeps all ASCII), else go.
    """
    marked = F.regexp_replace(word, f"([{''.join(CONSONANTS)}])(?![{''.join(SIGNS)}])", "$1" + _INHERENT)
    letters = _map(CONSONANTS | VOWELS | SIGNS | CODAS | {_INHERENT: "a"})
    one = lambda c: F.coalesce(F.try_element_at(letters, c), F.when(c.rlike(keep), c), F.lit(""))
    return F.lower(F.array_join(F.transform(F.split(marked, ""), one), ""))


def roman_word(word: Column, locale: Column) -> Column:
    """Romanized word for Telugu transcripts, null for other languages or if nothing is left."""
    bare = F.btrim(word)
    latin = F.when(bare.rlike("[a-zA-Z]"), F.lower(bare))
    telugu = F.nullif(F.btrim(F.translate(romanize_telugu(bare), DROPPED_MARKS, "")), F.lit(""))
    return F.when(locale.isin("te-IN", "te"), F.when(bare.rlike(TELUGU), telugu).otherwise(latin))


def display_with_script(word: Column, roman: Column) -> Column:
    """The romanized word if there is one, else Telugu romanized on the fly (all ASCII kept), else the word."""
    own = F.when(word.rlike(TELUGU), romanize_telugu(word, r"[\x00-\x7F]")).otherwise(F.coalesce(word, F.lit("")))
    return F.coalesce(F.nullif(roman, F.lit("")), own)
