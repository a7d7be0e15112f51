"""Column expressions for text: cleaning, tokenising, scalar features.

All are built-in Spark expressions (regexp_replace, split, higher-order array
functions), so they stay inside whole-stage code generation; no Python UDF.
Each function takes and returns a ``Column`` so it composes in one ``select``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c, lowercase: bool = True) -> Column:
    """Ordered rewrite: lower, brackets, URLs, tags, punctuation, newlines,
    words containing a digit.  Null stays null."""
    x = _col(c)
    if lowercase:
        x = F.lower(x)
    x = F.regexp_replace(x, K.RE_BRACKETS, "")
    x = F.regexp_replace(x, K.RE_URL, "")
    x = F.regexp_replace(x, K.RE_TAGS, "")
    x = F.regexp_replace(x, K.RE_PUNCT, "")
    x = F.regexp_replace(x, K.RE_NEWLINE, "")
    x = F.regexp_replace(x, K.RE_DIGIT_WORD_FAST, "")
    return x


_WS_OTHER = K.WS_CHARS.replace(" ", "")


def tokenize_ws(c) -> Column:
    """Python ``str.split()``: split on runs of Unicode whitespace, no empties.

    Every whitespace character is first mapped to ' ' with ``translate`` (a
    character map, no regex), then split on the single space."""
    spaced = F.translate(_col(c), _WS_OTHER, " " * len(_WS_OTHER))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def explode_tokens(df, keep, arr, name: str = "token", pos: str | None = None):
    """One row per array element, keeping ``keep`` columns.

    Uses the outer generator plus a null filter: a plain ``explode`` makes
    Catalyst infer ``size(arr) > 0`` and push it below the projection, which
    evaluates an expensive token expression twice per row.
    """
    a = _col(arr)
    gen = F.posexplode_outer(a).alias(pos, name) if pos else F.explode_outer(a).alias(name)
    return df.select(*[_col(k) for k in keep], gen).where(F.col(name).isNotNull())


def sw_array(stopwords: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in stopwords])


def remove_stopwords(c, stopwords: Iterable[str]) -> Column:
    """Whitespace split, drop listed words (case-sensitive), join by one space."""
    sw = sw_array(stopwords)
    return F.array_join(F.filter(tokenize_ws(c), lambda t: ~F.array_contains(sw, t)), " ")


def tokenize_keras(c) -> Column:
    """Keras text_to_word_sequence: lower, filter characters to ' ', split on ' '."""
    filt = "".join("\\" + ch if ch in "\\^-[]" else ch for ch in K.KERAS_FILTERS)
    spaced = F.regexp_replace(F.lower(_col(c)), "[" + filt + "]", " ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def tokenize_sklearn(c) -> Column:
    """sklearn default analyzer: lower, tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("(" + K.RE_SKLEARN_TOKEN + ")"), 1)


def tokenize_cloud(c) -> Column:
    """Words of a word cloud: a word character, then word characters or apostrophes."""
    return F.regexp_extract_all(_col(c), F.lit("(" + K.RE_CLOUD_WORD + ")"), 1)


def ngrams_1_2(tokens) -> Column:
    """Unigrams followed by bigrams (joined by one space), sklearn order.

    Bigrams pair two shifted slices with ``zip_with``; the token array is
    referenced a fixed number of times, never once per element.
    """
    t = _col(tokens)
    n = F.size(t)
    bigrams = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(1))), F.slice(t, 2, F.greatest(n - 1, F.lit(1))),
                         lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n < 2, t).otherwise(F.concat(t, bigrams))


def literal_count(c, needle: str) -> Column:
    """Non-overlapping count of a literal substring (Python ``str.count``)."""
    x = _col(c)
    return F.when(x.isNull(), None).otherwise(
        (F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)
    ).cast("long")


# --- the eight text meta features --------------------------------------------

def f_num_words(c) -> Column:
    return F.size(tokenize_ws(c)).cast("long")


def f_mentions(c) -> Column:
    return literal_count(c, "[USERNAME]") + literal_count(c, "username")


def f_hashtags(c) -> Column:
    return literal_count(c, "#")


def f_punct_count(c) -> Column:
    x = _col(c)
    return (F.length(x) - F.length(F.regexp_replace(x, K.RE_PUNCT, ""))).cast("long")


def f_char_count(c) -> Column:
    return F.length(_col(c)).cast("long")


def f_unique_words(c) -> Column:
    return F.size(F.array_distinct(tokenize_ws(c))).cast("long")


def f_url_count(c) -> Column:
    return literal_count(F.lower(_col(c)), "url")


def f_stopword_count(c, stopwords: Iterable[str]) -> Column:
    sw = sw_array(stopwords)
    return F.size(F.filter(tokenize_ws(F.lower(_col(c))), lambda t: F.array_contains(sw, t))).cast("long")


META_FEATURES = ["num_words", "mentions", "hashtags", "punct_count", "char_count",
                 "unique_words", "url_count", "stopword_count"]


def meta_feature_columns(c, stopwords: Iterable[str], tokens=None) -> list[Column]:
    """All eight features, aliased, for one ``select``.

    ``tokens`` may name an already computed ``tokenize_ws(c)`` column so the
    split runs once; lower-casing commutes with whitespace splitting, so the
    stop-word count lower-cases the tokens instead of re-splitting.
    """
    sw = list(stopwords)
    tok = _col(tokens) if tokens is not None else tokenize_ws(c)
    return [
        F.size(tok).cast("long").alias("num_words"),
        f_mentions(c).alias("mentions"),
        f_hashtags(c).alias("hashtags"),
        f_punct_count(c).alias("punct_count"),
        f_char_count(c).alias("char_count"),
        F.size(F.array_distinct(tok)).cast("long").alias("unique_words"),
        f_url_count(c).alias("url_count"),
        F.size(F.filter(tok, lambda t: F.lower(t).isin(sw))).cast("long").alias("stopword_count"),
    ]
