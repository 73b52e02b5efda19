"""Text normalisation as Column expressions; all of it runs inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.config import PREVIEW_CHARS
from caseloom.functions import normal_form
from caseloom.functions.words import (
    CODES,
    CONTRACTIONS,
    STOPWORDS,
    STOPWORDS_KEEPING_NEGATION,
    WHITESPACE,
)

ColumnOrName = Column | str

# White space that Java's \s does not know, and as many blanks.
_RARE_SPACES = "".join(c for c in WHITESPACE if c not in " \t\n\x0b\f\r")
_BLANKS = " " * len(_RARE_SPACES)


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result several times in ``then``.

    A Column repeated in an expression is evaluated at every place it stands; a lambda's
    argument is not.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: ColumnOrName) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes only blanks)."""
    return F.btrim(_col(text), F.lit(WHITESPACE))


def nfkc(text: ColumnOrName) -> Column:
    """Unicode NFKC, deterministic, so that filters written after it reach the scan. Pure-ASCII rows are returned as they are."""
    return _bind(_col(text), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), normal_form.nfkc(t)).otherwise(t))


def nfkc_apart(text: ColumnOrName) -> Column:
    """The same by a call of the Unicode library, which Spark takes as non-deterministic and so evaluates in a projection of its own.

    Spark does not send a function in Python an argument that holds nested lambdas; what it reads has to be computed apart.
    """
    def compose(t: Column) -> Column:
        composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
        return F.when(t.rlike(r"[^\x00-\x7F]"), composed).otherwise(t)

    return _bind(_col(text), compose)


def strip_codes(text: ColumnOrName) -> Column:
    """Replace transcription codes by a blank; rows without a ``*`` skip the pattern."""
    return _bind(
        _col(text), lambda t: F.when(F.contains(t, F.lit("*")), F.regexp_replace(t, "(?U)" + CODES, " ")).otherwise(t)
    )


def expand_contractions(text: ColumnOrName, lower_case: bool = False) -> Column:
    """Write contractions out in full, keeping negation as the word "not".

    Rows without an apostrophe are left alone; in the others only the words holding one
    meet the patterns. ``lower_case`` says the text is already lower case, which halves
    the number of patterns.
    """

    def expand_word(word: Column) -> Column:
        for pattern, written in CONTRACTIONS:
            if not lower_case:
                word = F.regexp_replace(word, _shout(pattern), written.upper())
                pattern = "(?i)" + pattern
            word = F.regexp_replace(word, pattern, written)
        return word

    def expand(t: Column) -> Column:
        words = F.split(F.translate(t, "’", "'"), " ")
        written_out = F.transform(words, lambda w: F.when(F.contains(w, F.lit("'")), expand_word(w)).otherwise(w))
        return F.when(t.rlike("['’]"), F.array_join(written_out, " ")).otherwise(t)

    return _bind(_col(text), expand)


def _shout(pattern: str) -> str:
    """The upper-case twin of a pattern, leaving escapes such as ``\\b`` alone."""
    return re.sub(r"\\.|[a-z]", lambda m: m[0] if m[0].startswith("\\") else m[0].upper(), pattern)


def plain_spaces(text: ColumnOrName) -> Column:
    """Turn white space outside Java's ``\\s`` into blanks, so the short class can be used.

    A character class listing all of it is several times slower.
    """
    return F.translate(_col(text), _RARE_SPACES, _BLANKS)


def letters_only(text: ColumnOrName, keep_digits: bool = False) -> Column:
    """Replace everything but lower-case letters (and digits) and white space by a blank."""
    return F.regexp_replace(plain_spaces(text), r"[^a-z0-9\s]" if keep_digits else r"[^a-z\s]", " ")


def collapse_spaces(text: ColumnOrName) -> Column:
    """Turn each run of white space into one blank and strip both ends."""
    return F.btrim(F.regexp_replace(plain_spaces(text), r"\s+", " "))


def remove_words(tokens: ColumnOrName, words: tuple[str, ...] = STOPWORDS_KEEPING_NEGATION) -> Column:
    """Drop listed words and empty strings from a token array.

    A constant list becomes a hash-set test, unlike ``array_contains``.
    """
    return F.filter(_col(tokens), lambda t: (t != "") & ~t.isin(*words))


def classical_tokens(text: ColumnOrName, keep_digits: bool = False, apart: bool = False) -> Column:
    """Tokens of the full cleaner, before lemmas; ``apart`` if a function in Python reads them without a table in between.

    Order: NFKC, codes, contractions, lower case, letters only, white space, stopwords.
    Replacing non-letters by a blank and then splitting at white space is the same as
    splitting at every run of non-letters, which needs one pass over the text.
    """
    lowered = F.lower(strip_codes(nfkc_apart(text) if apart else nfkc(text)))
    expanded = expand_contractions(lowered, lower_case=True)
    parts = F.split(expanded, "[^a-z0-9]+" if keep_digits else "[^a-z]+")
    return F.coalesce(remove_words(parts), F.array().cast("array<string>"))


def classical_clean(text: ColumnOrName, keep_digits: bool = False) -> Column:
    """``classical_tokens`` as one string; null gives an empty string."""
    return F.array_join(classical_tokens(text, keep_digits), " ")


def light_clean(text: ColumnOrName) -> Column:
    """NFKC, codes, contractions and white space only; null gives an empty string."""
    return F.coalesce(collapse_spaces(expand_contractions(strip_codes(nfkc(text)))), F.lit(""))


def legacy_tokens(text: ColumnOrName) -> Column:
    """The older cleaner: non-letters are deleted, negations go with the stopwords.

    Kept for comparison; it turns "doesn't" into "doesnt".
    """
    letters = F.regexp_replace(plain_spaces(F.lower(_col(text))), r"[^a-z\s]", "")
    return remove_words(F.split(letters, r"\s+"), STOPWORDS)


def legacy_clean(text: ColumnOrName) -> Column:
    return F.array_join(legacy_tokens(text), " ")


def content_words(text: ColumnOrName) -> Column:
    """Lower-case words of three or more characters that are not stopwords."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def preview(text: ColumnOrName, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(_col(text), 1, chars)


def text_identity(text: ColumnOrName) -> Column:
    """192 bits standing for an exact text where texts are only counted, not kept.

    Grouping on it shuffles 40 bytes per row instead of the text.
    """
    return F.struct(F.xxhash64(_col(text)).alias("h"), F.md5(_col(text)).alias("m"))
