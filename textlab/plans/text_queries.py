"""Registered queries: cleaning, tokenising, scalar text features.

``documents`` is the labelled text table: ``lang`` plays the label and
``text`` the tweet.  Every query runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..operators import profile as P
from ..sources.tables import read_spread
from . import duck as D
from .registry import register

SW = K.TEST_STOPWORDS


def _docs(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents")


# --- flagship: documents -> clean -> meta features -> mean by label ----------

FLAGSHIP_COLS = P_COLS = TX.META_FEATURES + ["clean_words"]


def flagship(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", "text", TX.tokenize_ws("text").alias("tok"),
                                    TX.clean_text("text").alias("clean"))
    feats = d.select("lang", *TX.meta_feature_columns("text", SW, tokens="tok"),
                     TX.f_num_words("clean").alias("clean_words"))
    return P.mean_by_label(feats, "lang", FLAGSHIP_COLS)


register("mean_by_label", f"""
SELECT lang, {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in FLAGSHIP_COLS)}
FROM (SELECT lang, {D.meta_features("text", SW)},
             CAST(len({D.tokenize_ws(D.clean_text("text"))}) AS BIGINT) AS clean_words
      FROM documents) t
GROUP BY lang
""")(flagship)


@register("clean_text", f"SELECT doc_id, {D.clean_text('text')} AS clean FROM documents")
def q_clean_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", TX.clean_text("text").alias("clean"))


@register("clean_text_cased", f"SELECT doc_id, {D.clean_text('text', lowercase=False)} AS clean FROM documents")
def q_clean_text_cased(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", TX.clean_text("text", lowercase=False).alias("clean"))


@register("clean_text_sw", f"SELECT doc_id, {D.remove_stopwords(D.clean_text('text'), SW)} AS clean FROM documents")
def q_clean_text_sw(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", TX.remove_stopwords(TX.clean_text("text"), SW).alias("clean"))


@register("remove_stopwords", f"SELECT doc_id, {D.remove_stopwords('text', SW)} AS text_nosw FROM documents")
def q_remove_stopwords(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", TX.remove_stopwords("text", SW).alias("text_nosw"))


@register("clean_pages", f"SELECT page_id, {D.clean_text('html')} AS clean FROM pages")
def q_clean_pages(spark, sf_dir):
    """clean_text on raw HTML pages: exercises the tag and URL steps."""
    p = read_spread(spark, sf_dir, "pages")
    return p.select("page_id", TX.clean_text("html").alias("clean"))


@register("text_meta_features", f"SELECT doc_id, lang, {D.meta_features('text', SW)} FROM documents")
def q_text_meta_features(spark, sf_dir):
    return P.text_meta_features(_docs(spark, sf_dir), "text", SW, keep=("doc_id", "lang"))


# one query per scalar feature, each a single projection over documents
_FEATURE_SQL = {
    "f_num_words": f"CAST(len({D.tokenize_ws('text')}) AS BIGINT)",
    "f_mentions": f"{D.literal_count('text', '[USERNAME]')} + {D.literal_count('text', 'username')}",
    "f_hashtags": D.literal_count("text", "#"),
    "f_punct_count": f"CAST(length(text) - length(regexp_replace(text, {D.q(K.RE_PUNCT)}, '', 'g')) AS BIGINT)",
    "f_char_count": "CAST(length(text) AS BIGINT)",
    "f_unique_words": f"CAST(len(list_distinct({D.tokenize_ws('text')})) AS BIGINT)",
    "f_url_count": D.literal_count("lower(text)", "url"),
    "f_stopword_count": (f"CAST(len(list_filter({D.tokenize_ws('lower(text)')}, "
                         f"lambda t: list_contains({D.sw_list(SW)}, t))) AS BIGINT)"),
}
_FEATURE_COL = {
    "f_num_words": TX.f_num_words, "f_mentions": TX.f_mentions, "f_hashtags": TX.f_hashtags,
    "f_punct_count": TX.f_punct_count, "f_char_count": TX.f_char_count,
    "f_unique_words": TX.f_unique_words, "f_url_count": TX.f_url_count,
    "f_stopword_count": lambda c: TX.f_stopword_count(c, SW),
}


def _feature_query(fn):
    def run(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", fn("text").alias("value"))
    return run


for _name, _sql in _FEATURE_SQL.items():
    register(_name, f"SELECT doc_id, {_sql} AS value FROM documents")(_feature_query(_FEATURE_COL[_name]))


# --- tokenisers: long form (doc_id, pos, token) -------------------------------

def _long_sql(list_expr: str, key: str = "doc_id", table: str = "documents") -> str:
    return (f"SELECT {key}, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS token "
            f"FROM (SELECT {key}, {list_expr} AS l FROM {table}) s")


def _long(df, key, arr):
    return TX.explode_tokens(df, [key], arr, "token", pos="pos").withColumn("pos", F.col("pos").cast("long"))


@register("tokenize_ws", _long_sql(D.tokenize_ws("text")))
def q_tokenize_ws(spark, sf_dir):
    return _long(_docs(spark, sf_dir), "doc_id", TX.tokenize_ws("text"))


@register("tokenize_keras", _long_sql(D.tokenize_keras("text")))
def q_tokenize_keras(spark, sf_dir):
    return _long(_docs(spark, sf_dir), "doc_id", TX.tokenize_keras("text"))


@register("tokenize_sklearn", _long_sql(D.tokenize_sklearn("text")))
def q_tokenize_sklearn(spark, sf_dir):
    return _long(_docs(spark, sf_dir), "doc_id", TX.tokenize_sklearn("text"))


_BIGRAM_SQL = (f"list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))")


@register("ngrams_1_2", f"""
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS token
FROM (SELECT doc_id, {_BIGRAM_SQL} AS l
      FROM (SELECT doc_id, {D.tokenize_sklearn('text')} AS tk FROM documents) a) s
""")
def q_ngrams_1_2(spark, sf_dir):
    return _long(_docs(spark, sf_dir), "doc_id", TX.ngrams_1_2(TX.tokenize_sklearn("text")))


_STOP_LIST = list(dict.fromkeys(SW + K.STOPWORD_EXTRAS + K.STOPWORD_EXTRAS_AUG))


@register("stopword_list", f"""
WITH sw AS (SELECT unnest({D.sw_list(_STOP_LIST)}) AS word),
c AS (SELECT t AS word, count(*) AS n FROM (SELECT unnest({D.tokenize_ws('lower(text)')}) AS t FROM documents) a
      WHERE t IN (SELECT word FROM sw) GROUP BY t)
SELECT sw.word, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sw LEFT JOIN c USING (word)""")
def q_stopword_list(spark, sf_dir):
    """Base list + domain words (union, distinct) as a small table, with each
    word's frequency among the lower-cased tokens of documents."""
    from ..operators import joins as J
    base = spark.createDataFrame([(w,) for w in SW], "word string")
    extra = spark.createDataFrame([(w,) for w in K.STOPWORD_EXTRAS + K.STOPWORD_EXTRAS_AUG], "word string")
    words = J.union_all(base, extra).distinct()
    toks = TX.explode_tokens(_docs(spark, sf_dir), [], TX.tokenize_ws(F.lower("text")), "word")
    counts = toks.join(F.broadcast(words), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
