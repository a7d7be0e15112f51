"""Registered queries: labels, profiling, joins / set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..functions.numeric import rround
from ..operators import joins as J
from ..operators import labels as L
from ..operators import profile as P
from ..operators import splits as S
from ..sources.tables import read_spread, read_table
from . import duck as D
from .registry import register

SW = K.TEST_STOPWORDS
LANG_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.TEST_LANG_LABELS.items()) + " END"


def _docs(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents")


# --- 2.2 labels ------------------------------------------------------------------

@register("map_label", f"SELECT doc_id, lang, CAST({LANG_CASE} AS BIGINT) AS label_idx FROM documents")
def q_map_label(spark, sf_dir):
    d = L.map_label(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", K.TEST_LANG_LABELS)
    return d.withColumn("label_idx", F.col("label_idx").cast("long"))


_UNMAP_CASE = "CASE label_idx " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in K.TEST_LANG_LABELS.items()) + " END"


@register("unmap_label", f"""
SELECT doc_id, CAST(label_idx AS BIGINT) AS label_idx, {_UNMAP_CASE} AS label_name
FROM (SELECT doc_id, {LANG_CASE} AS label_idx FROM documents) t""")
def q_unmap_label(spark, sf_dir):
    d = L.map_label(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", K.TEST_LANG_LABELS)
    d = L.unmap_label(d, "label_idx", K.TEST_LANG_LABELS)
    return d.select("doc_id", F.col("label_idx").cast("long").alias("label_idx"), "label_name")


@register("encode_label_alpha",
          "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label_idx FROM documents")
def q_encode_label_alpha(spark, sf_dir):
    d = L.encode_label_alpha(_docs(spark, sf_dir).select("doc_id", "lang"), "lang")
    return d.withColumn("label_idx", F.col("label_idx").cast("long"))


@register("one_hot", """
SELECT doc_id, array_to_string(list_transform(range(4), lambda i: CAST(i = idx AS INTEGER)), ',') AS one_hot
FROM (SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS idx FROM documents) t""")
def q_one_hot(spark, sf_dir):
    d = L.encode_label_alpha(_docs(spark, sf_dir).select("doc_id", "lang"), "lang")
    return d.select("doc_id", F.array_join(L.one_hot("label_idx", 4), ",").alias("one_hot"))


_MODEL_NAME = "concat_ws('_', CASE WHEN quality = 1 THEN 'IndoBERTweet' WHEN toxic = 1 THEN 'IndoBERT-Base' ELSE 'model' END, CAST(doc_id AS STRING), 'best.pt')"


@register("detect_base_model", f"""
SELECT doc_id, model_name,
       CASE WHEN contains(lower(model_name), 'tweet') THEN '{K.BASE_MODEL_RULES[0][1]}'
            WHEN contains(lower(model_name), 'base') THEN '{K.BASE_MODEL_RULES[1][1]}'
            ELSE '{K.BASE_MODEL_DEFAULT}' END AS base_model
FROM (SELECT doc_id, {_MODEL_NAME} AS model_name FROM labels) t""")
def q_detect_base_model(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    names = lab.select("doc_id", F.expr(_MODEL_NAME).alias("model_name"))
    return names.withColumn("base_model", L.detect_base_model("model_name"))


@register("filter_label", "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'")
def q_filter_label(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("lang") == "fr").select("doc_id", "n_chars")


@register("drop_nulls", f"""
SELECT doc_id, CAST(label_idx AS BIGINT) AS label_idx
FROM (SELECT doc_id, {LANG_CASE} AS label_idx FROM documents) t WHERE label_idx IS NOT NULL""")
def q_drop_nulls(spark, sf_dir):
    d = L.map_label(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", K.TEST_LANG_LABELS)
    return J.drop_nulls(d.select("doc_id", F.col("label_idx").cast("long").alias("label_idx")))


_NUMERIC_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax"]


@register("select_numeric", f"SELECT {', '.join(_NUMERIC_LINEITEM)} FROM lineitem")
def q_select_numeric(spark, sf_dir):
    return P.select_numeric(read_table(spark, sf_dir, "lineitem"))


@register("scan_validated", f"""
SELECT doc_id, lang, label_idx, md5(cleaned) AS cleaned_md5
FROM (SELECT doc_id, lower(trim(lang)) AS lang, CAST({LANG_CASE.replace('CASE lang', 'CASE lower(trim(lang))')} AS BIGINT) AS label_idx,
             {D.remove_stopwords("coalesce(text, '')", SW)} AS cleaned
      FROM documents) c
WHERE cleaned <> '' AND lang IN ({', '.join(D.q(k) for k in K.TEST_LANG_LABELS)})""")
def q_scan_validated(spark, sf_dir):
    d = L.scan_validated(_docs(spark, sf_dir).select("doc_id", "text", "lang"), "text", "lang",
                         K.TEST_LANG_LABELS, SW)
    return d.select("doc_id", "lang", F.col("label_idx").cast("long").alias("label_idx"), F.md5("text").alias("cleaned_md5"))


# --- 2.6 profiling ----------------------------------------------------------------

_DOC_TYPES = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
              ("n_chars", "bigint")]


@register("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count({c}) AS BIGINT) AS non_null, "
    f"'{t}' AS dtype FROM documents" for c, t in _DOC_TYPES))
def q_null_profile(spark, sf_dir):
    return P.null_profile(_docs(spark, sf_dir))


@register("head_rows", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_head_rows(spark, sf_dir):
    return P.head_rows(_docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), "doc_id", 5)


@register("distinct_labels", "SELECT DISTINCT lang FROM documents")
def q_distinct_labels(spark, sf_dir):
    return P.distinct_labels(_docs(spark, sf_dir), "lang")


@register("label_distribution", """
SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share
FROM documents GROUP BY lang""")
def q_label_distribution(spark, sf_dir):
    return P.label_distribution(_docs(spark, sf_dir), "lang")


_NW = f"CAST(len({D.tokenize_ws('text')}) AS BIGINT)"


@register("hist_by_label", f"""
WITH f AS (SELECT lang, {_NW} AS num_words FROM documents),
r AS (SELECT lang, CASE WHEN min(num_words) = max(num_words) THEN min(num_words) - 0.5 ELSE min(num_words) END AS lo,
             CASE WHEN min(num_words) = max(num_words) THEN max(num_words) + 0.5 ELSE max(num_words) END AS hi
      FROM f GROUP BY lang),
b AS (SELECT f.lang, CAST(least(floor((num_words - lo) * 10 / (hi - lo)), 9) AS BIGINT) AS bin, count(*) AS n
      FROM f JOIN r USING (lang) GROUP BY 1, 2),
e AS (SELECT lang, lo, hi, CAST(unnest(range(10)) AS BIGINT) AS bin FROM r)
SELECT e.lang, e.bin, CAST(coalesce(b.n, 0) AS BIGINT) AS n, round(lo + e.bin * (hi - lo) / 10, 6) AS bin_lo
FROM e LEFT JOIN b ON b.lang = e.lang AND b.bin = e.bin""")
def q_hist_by_label(spark, sf_dir):
    f = _docs(spark, sf_dir).select("lang", TX.f_num_words("text").alias("num_words"))
    return P.hist_by_label(f, "lang", "num_words")


@register("describe_by_label", """
SELECT event_type, CAST(count(value) AS BIGINT) AS value_count, round(avg(value), 6) AS value_mean,
       round(stddev_samp(value), 6) AS value_std, round(min(value), 6) AS value_min,
       round(quantile_cont(value, 0.25), 6) AS value_p25, round(quantile_cont(value, 0.5), 6) AS value_p50,
       round(quantile_cont(value, 0.75), 6) AS value_p75, round(max(value), 6) AS value_max
FROM events GROUP BY event_type""")
def q_describe_by_label(spark, sf_dir):
    return P.describe_by_label(read_table(spark, sf_dir, "events"), "event_type", ["value"])


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a in _CORR_COLS for b in _CORR_COLS))
def q_corr_matrix(spark, sf_dir):
    return P.corr_matrix(read_table(spark, sf_dir, "lineitem"), _CORR_COLS)


@register("top_words_by_label", f"""
SELECT lang, word, n, rank FROM (
  SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS BIGINT) AS rank
  FROM (SELECT lang, word, count(*) AS n
        FROM (SELECT lang, unnest(list_filter({D.tokenize_cloud('lower(text)')},
                                              lambda t: NOT list_contains({D.sw_list(SW)}, t))) AS word
              FROM documents) w
        GROUP BY lang, word) c) r
WHERE rank <= 200""")
def q_top_words_by_label(spark, sf_dir):
    return P.top_words_by_label(_docs(spark, sf_dir), "lang", "text", SW, 200)


_BOX_SQL = """
WITH box AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
b AS (SELECT e.*, q1, median, q3, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
      FROM events e JOIN box USING (event_type))
"""


@register("grouped_boxplot", _BOX_SQL + """
SELECT event_type, round(min(value), 6) AS vmin, round(min(CASE WHEN inside THEN value END), 6) AS whisker_lo,
       round(first(q1), 6) AS q1, round(first(median), 6) AS median, round(first(q3), 6) AS q3,
       round(max(CASE WHEN inside THEN value END), 6) AS whisker_hi, round(max(value), 6) AS vmax,
       CAST(count(CASE WHEN NOT inside THEN 1 END) AS BIGINT) AS n_outliers
FROM b GROUP BY event_type""")
def q_grouped_boxplot(spark, sf_dir):
    return P.grouped_boxplot(read_table(spark, sf_dir, "events"), "event_type", "value")


@register("boxplot_outliers", _BOX_SQL + "SELECT event_type, event_id, round(value, 6) AS value FROM b WHERE NOT inside")
def q_boxplot_outliers(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return P.boxplot_outliers(e, "event_type", "value").withColumn("value", rround("value", 6))


@register("vocab_stats", f"""
SELECT count(DISTINCT t) AS vocab_size, CAST(max(s) AS BIGINT) AS max_len
FROM (SELECT len(l) AS s, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS t
      FROM (SELECT {D.tokenize_sklearn('text')} AS l FROM documents) a) b""")
def q_vocab_stats(spark, sf_dir):
    tok = _docs(spark, sf_dir).select(TX.tokenize_sklearn("text").alias("tokens"))
    return P.vocab_stats(tok, "tokens")


# --- 2.7 / 2.8 joins and set operations ---------------------------------------

_SAMPLE20 = ("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS r "
             "FROM documents) x WHERE r <= round_even((SELECT count(*) FROM documents) * CAST(0.2 AS DOUBLE), 0)")


@register("anti_join_natural", f"""
SELECT d.doc_id, d.lang, md5(d.text) AS text_md5
FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id IN ({_SAMPLE20})
                  AND s.text IS NOT DISTINCT FROM d.text AND s.lang IS NOT DISTINCT FROM d.lang)""")
def q_anti_join_natural(spark, sf_dir):
    d = _docs(spark, sf_dir)
    full = d.select("doc_id", "text", "lang")
    sample = S.sample_frac(full, "doc_id", 0.2, seed=7).select("text", "lang")
    out = J.anti_join_natural(full, sample)
    return out.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@register("anti_join_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_anti_join_key(spark, sf_dir):
    return J.anti_join_key(_docs(spark, sf_dir).select("doc_id"), read_table(spark, sf_dir, "labels"), "doc_id")


@register("lookup_join", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_lookup_join(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "lang")
    return J.lookup_join(d, read_table(spark, sf_dir, "labels"), "doc_id", "left")


@register("align_columns", """
SELECT u.conv_id, u.turn, md5(u.text) AS prompt_md5, md5(a.text) AS reply_md5
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user'""")
def q_align_columns(spark, sf_dir):
    """Attach the next turn to each user turn by explicit key, never by position."""
    c = read_table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.md5("text").alias("prompt_md5"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("reply_md5"))
    return u.join(a, ["conv_id", "turn"])


@register("union_all", """
SELECT 'documents' AS corpus, doc_id AS id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
UNION ALL SELECT 'benchmark', item_id, CAST(length(text) AS BIGINT) FROM benchmark""")
def q_union_all(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"),
                                    F.length("text").cast("long").alias("n_chars"))
    b = read_table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"),
                                                      F.length("text").cast("long").alias("n_chars"))
    return J.union_all(d, b)


@register("dedup_rows", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def q_dedup_rows(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.md5("text").alias("text_md5"), "lang")
    return J.dedup_rows(d)


@register("pair_explode", f"""
SELECT doc_id AS pair_id, lang, CAST(p - 1 AS BIGINT) AS variant_pos,
       CASE WHEN p = 1 THEN 'original' ELSE 'cleaned' END AS variant,
       CASE WHEN p = 1 THEN text ELSE {D.clean_text('text')} END AS text
FROM documents, range(1, 3) AS g(p)""")
def q_pair_explode(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), "lang", "text",
                                    TX.clean_text("text").alias("cleaned"))
    return J.pair_explode(d, "pair_id", ["text", "cleaned"], "lang", ["original", "cleaned"])


@register("unpivot_metrics", f"""
UNPIVOT (SELECT doc_id, CAST(len({D.tokenize_ws('text')}) AS BIGINT) AS num_words,
                CAST(len(list_distinct({D.tokenize_ws('text')})) AS BIGINT) AS unique_words,
                CAST(length(text) AS BIGINT) AS char_count FROM documents)
ON num_words, unique_words, char_count INTO NAME metric VALUE value""")
def q_unpivot_metrics(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", TX.f_num_words("text").alias("num_words"),
                                    TX.f_unique_words("text").alias("unique_words"),
                                    TX.f_char_count("text").alias("char_count"))
    return d.unpivot("doc_id", ["num_words", "unique_words", "char_count"], "metric", "value")
