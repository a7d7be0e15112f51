"""DuckDB SQL fragments for the oracle side of each registered query.

These build plain SQL strings that mirror the Spark column expressions of
``textlab.functions`` (same regexes; RE2 lacks look-behind so the plain
digit-word pattern is used).  They are only used to write ``oracle_sql()``.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import constants as K


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean_text(x: str, lowercase: bool = True) -> str:
    e = f"lower({x})" if lowercase else x
    for pat in (K.RE_BRACKETS, K.RE_URL, K.RE_TAGS, K.RE_PUNCT, K.RE_NEWLINE, K.RE_DIGIT_WORD):
        e = f"regexp_replace({e}, {q(pat)}, '', 'g')"
    return e


def tokenize_ws(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(K.WS + '+')}), lambda t: t <> '')"


def sw_list(stopwords: Iterable[str]) -> str:
    return "[" + ", ".join(q(w) for w in stopwords) + "]"


def remove_stopwords(x: str, stopwords: Iterable[str]) -> str:
    return (f"array_to_string(list_filter({tokenize_ws(x)}, "
            f"lambda t: NOT list_contains({sw_list(stopwords)}, t)), ' ')")


def literal_count(x: str, needle: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {q(needle)}, ''))) // {len(needle)} AS BIGINT)"


def tokenize_sklearn(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q('(' + K.RE_SKLEARN_TOKEN + ')')}, 1)"


def tokenize_cloud(x: str) -> str:
    return f"regexp_extract_all({x}, {q('(' + K.RE_CLOUD_WORD + ')')}, 1)"


def tokenize_keras(x: str) -> str:
    filt = "".join("\\" + ch if ch in "\\^-[]" else ch for ch in K.KERAS_FILTERS)
    return (f"list_filter(string_split(regexp_replace(lower({x}), {q('[' + filt + ']')}, ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def meta_features(x: str, stopwords: Iterable[str]) -> str:
    sw = sw_list(stopwords)
    cols = [
        f"CAST(len({tokenize_ws(x)}) AS BIGINT) AS num_words",
        f"{literal_count(x, '[USERNAME]')} + {literal_count(x, 'username')} AS mentions",
        f"{literal_count(x, '#')} AS hashtags",
        f"CAST(length({x}) - length(regexp_replace({x}, {q(K.RE_PUNCT)}, '', 'g')) AS BIGINT) AS punct_count",
        f"CAST(length({x}) AS BIGINT) AS char_count",
        f"CAST(len(list_distinct({tokenize_ws(x)})) AS BIGINT) AS unique_words",
        f"{literal_count(f'lower({x})', 'url')} AS url_count",
        f"CAST(len(list_filter({tokenize_ws(f'lower({x})')}, lambda t: list_contains({sw}, t))) AS BIGINT)"
        f" AS stopword_count",
    ]
    return ",\n       ".join(cols)


def hash_uniform(seed, *parts: str) -> str:
    inner = " || ':' || ".join([q(str(seed))] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(('0x' || substr(md5({inner}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def hash_key(seed, *parts: str) -> str:
    inner = " || ':' || ".join([q(str(seed))] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({inner})"
