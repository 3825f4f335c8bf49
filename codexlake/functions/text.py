"""Text functions: folding, names, slugs, cleaning, quality heuristics, chunks.

All take and return columns; a null text gives null unless stated otherwise.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Name particles, umlaut spellings, characters stripped from tokens, abbreviation signs.
PARTICLES = ("von", "van", "de", "di", "da", "der", "zu", "zer", "im", "am", "the", "of", "und")
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ß": "ss"}
TERM_STRIP = ".,;:'\"§$%()[]{}–—"
ABBREVIATIONS_FROM, ABBREVIATIONS_TO = "āēīōūĀĒĪŌŪʒÇçıſ", "aeiouAEIOUzCcis"
#: Thresholds of the repetition-collapse test.
DOMINANT, MIN_ALPHABET, SINGLE_CHAR_LINES, MIN_DISTINCT_WORDS, MIN_LENGTH = 0.60, 12, 0.70, 0.15, 30


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case."""

    def one(s):
        if s is None:
            return None
        return s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()

    return text.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def fold_marks(text: pd.Series) -> pd.Series:
    """As search fields are folded: canonical decomposition without the combining diacritical marks, lower case; ligatures and the like stay."""

    def one(s):
        return s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFD", s) if not "\u0300" <= c <= "\u036f").lower()

    return text.map(one, na_action="ignore")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: long CASE chains neither repeat it nor grow with it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def transliterate(text: Column) -> Column:
    """Umlauts by their two-letter spellings."""
    for a, b in UMLAUTS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slug(name: Column) -> Column:
    """Umlauts spelled out, folded, all else than a-z and 0-9 as single hyphens."""
    return F.btrim(F.regexp_replace(fold(transliterate(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def _without_particles(tokens: Column) -> Column:
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(*PARTICLES)), " ")


def index_name(name: Column) -> Column:
    """Key of the entity index: folded, split at white space, without particles."""
    return _without_particles(F.split(fold(name), r"(?U)\s+"))


def person_name(name: Column) -> Column:
    """Key of person matching: folded, punctuation dropped, without particles."""
    return _without_particles(F.split(fold(name), r"(?U)[^\w]+"))


def match_keys(name: Column) -> Column:
    """The folded name and its umlaut spelling, without blanks."""
    return F.filter(F.array_distinct(F.array(index_name(name), index_name(transliterate(name)))), lambda k: k != "")


def fold_abbreviations(text: Column) -> Column:
    return F.replace(F.translate(text, ABBREVIATIONS_FROM, ABBREVIATIONS_TO), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_tokens(text: Column) -> Column:
    """Lower case, single blanks, punctuation stripped from both ends of each token."""
    return F.array_join(F.transform(F.split(collapse(F.lower(text)), " "), lambda t: F.btrim(t, F.lit(string.punctuation))), " ")


def tokens(text: Column) -> Column:
    """White-space tokens; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Lower-cased tokens without outer punctuation, longer than two characters, not all digits."""
    cleaned = F.transform(tokens(text), lambda t: F.btrim(F.lower(t), F.lit(TERM_STRIP)))
    return F.filter(cleaned, lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$"))


def _let(value: Column, body) -> Column:
    """body(value), with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def is_degenerate(text: Column) -> Column:
    """Signs of repetition collapse: one character dominates, few distinct ones, one-character lines, few distinct words. Null and blank: false."""
    text = F.coalesce(text, F.lit(""))
    solid = F.regexp_replace(text, r"(?U)\s+", "")
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: collapse(x)), lambda x: x != "")
    same = lambda x: x.rlike(r"^(.)\1*$")

    def by_chars(t: Column) -> Column:
        """Each distinct character is counted by what its removal takes away."""
        alphabet = F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)))
        most = lambda a: F.array_max(F.transform(a, lambda c: F.length(t) - F.length(F.replace(t, c, F.lit("")))))
        return _let(alphabet, lambda a: F.when(F.size(a) < MIN_ALPHABET, True).otherwise(most(a) > DOMINANT * F.length(t)))

    by_lines = _let(lines, lambda x: F.size(F.filter(x, same)) > SINGLE_CHAR_LINES * F.size(x))
    by_words = _let(tokens(text), lambda w: F.size(F.array_distinct(w)) < MIN_DISTINCT_WORDS * F.size(w))
    return _let(solid, lambda t: F.when(t == "", False).otherwise(by_chars(t) | by_lines | (F.length(text) >= MIN_LENGTH) & by_words))


def quality_score(text: Column, with_degenerate: bool = True, degenerate: Column | None = None) -> Column:
    """0 blank, 0.2 hardly any letters, 0.3 under 20 characters, 0.1 degenerate, else 0.8. The flag can be given if it is known."""

    def score(t: Column) -> Column:
        out = F.when(t == "", 0.0).when(F.regexp_count(t, F.lit(r"\p{L}")) < 0.1 * F.length(t), 0.2).when(F.length(t) < 20, 0.3)
        if with_degenerate:
            out = out.when(is_degenerate(t) if degenerate is None else degenerate, 0.1)
        return out.otherwise(0.8)

    return _let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), score)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (nth, start, chunk): windows of ``size`` characters that overlap, one from every step inside the text; a short text is one chunk."""
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.floor((n - 1) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("nth"), (i * step).alias("start"), F.substr(text, i * step + 1, F.lit(size)).alias("chunk")))


def head_and_tail(text: Column, head: int = 3000, tail: int = 3000) -> Column:
    """The whole text, or its first and last characters around a mark."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("\n[…]\n"), F.right(text, F.lit(tail))))


def unwrap(value: Column) -> Column:
    """A VARIANT that is a plain value or an object with ``wert`` or ``value``."""
    pick = lambda path: F.try_variant_get(value, path, "string")
    return F.coalesce(pick("$.wert"), pick("$.value"), F.when(~F.schema_of_variant(value).startswith("OBJECT"), pick("$")))


def strip_header(text: Column) -> Column:
    """Without the leading block of # lines that transcription files carry."""
    return F.regexp_replace(text, r"(?s)\A#.*?\n\n", "")


SCRIPTS_OF = {"de": "Latin", "la": "Latin", "fr": "Latin", "it": "Latin", "es": "Latin", "en": "Latin", "nl": "Latin", "cs": "Latin", "pl": "Latin", "hu": "Latin", "el": "Greek", "he": "Hebrew", "ar": "Arabic", "ur": "Arabic", "syr": "Syriac", "cop": "Coptic", "hi": "Devanagari", "sa": "Devanagari"}


def script_share(text: Column, script: str) -> Column:
    """Share of the letters that belong to a Unicode script. Letters are counted by what their removal takes away, run by run."""
    count = lambda letters: F.length(text) - F.length(F.regexp_replace(text, f"{letters}+", ""))
    return F.coalesce(F.try_divide(count(rf"\p{{Is{script}}}"), count(r"\p{L}")), F.lit(1.0))


#: Scripts told apart by dominant_script, in the order that decides ties; the last three are one answer.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Syriac", "Coptic", "Devanagari", "Hangul", "Han", "Hiragana", "Katakana")


def dominant_script(text: Column) -> Column:
    """The script that most letters belong to (CJK for Han and Japanese syllables); empty without a letter of a known script."""
    n = lambda *names: F.regexp_count(text, F.lit("[" + "".join(rf"\p{{Is{x}}}" for x in names) + "]"))
    counts = [F.struct(n(x).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("s")) for i, x in enumerate(SCRIPTS[:-3])]
    best = F.array_max(F.array(*counts, F.struct(n(*SCRIPTS[-3:]).alias("n"), F.lit(-len(SCRIPTS)).alias("i"), F.lit("CJK").alias("s"))))
    return F.when(best["n"] > 0, best["s"]).otherwise("")


def script_implausible(text: Column, lang: Column, least: float = 0.5) -> Column:
    """True if under half the letters belong to the script that the language is written in; false for other languages."""
    out = F.lit(False)
    for script in sorted(set(SCRIPTS_OF.values())):
        langs = [k for k, v in SCRIPTS_OF.items() if v == script]
        out = F.when(lang.isin(*langs), script_share(text, script) < least).otherwise(out)
    return out
