"""Registered queries: vocabulary, sequences, embeddings.

Tokens are Keras-style tokens of stop-word-free ``documents.text``; the id cap
is the analysed experiments' NB_WORDS = 20000.  ``embeddings`` rows act as
pre-trained vectors for vocabulary ids vec_id + 1.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..functions.numeric import rround
from ..operators import features as FE
from ..operators import vocab as V
from ..sources.files import scratch_path
from ..sources.tables import read_spread, read_table
from . import duck as D
from .feature_queries import TOPK
from .registry import ORACLE, register

SW = K.TEST_STOPWORDS
NB_WORDS = 20000     # FIXED VALUE: vocabulary cap of the analysed experiments
MAX_LEN = 128        # FIXED VALUE: fixed sequence length of the analysed experiments
BATCH = 64           # FIXED VALUE: batch size of the analysed experiments
DIM = 64             # dimension of the ``embeddings`` test vectors


def _tokens(spark, sf_dir):
    d = read_spread(spark, sf_dir, "documents")
    return d.select("doc_id", TX.tokenize_keras(TX.remove_stopwords("text", SW)).alias("tokens"))


def _vocab(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t, V.build_vocab(t, "doc_id", "tokens")


def _seq(spark, sf_dir):
    t, v = _vocab(spark, sf_dir)
    return V.texts_to_sequences(t, "doc_id", "tokens", v, NB_WORDS)


_TOK_SQL = f"""tok AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token
            FROM (SELECT doc_id, {D.tokenize_keras(D.remove_stopwords('text', SW))} AS l FROM documents) a)"""
_VOCAB_SQL = f"""{_TOK_SQL},
first AS (SELECT token, doc_id AS first_key, pos AS first_pos
          FROM (SELECT token, doc_id, pos, row_number() OVER (PARTITION BY token ORDER BY doc_id, pos) AS rn FROM tok) x
          WHERE rn = 1),
cnt AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
vocab AS (SELECT token, CAST(n AS BIGINT) AS n,
                 CAST(row_number() OVER (ORDER BY n DESC, first_key, first_pos) AS BIGINT) AS idx
          FROM cnt JOIN first USING (token))"""
_SEQ_SQL = f"""{_VOCAB_SQL},
seq AS (SELECT d.doc_id, coalesce(s.ids, []) AS ids FROM documents d LEFT JOIN
        (SELECT doc_id, list(idx ORDER BY pos) AS ids FROM tok JOIN vocab USING (token)
         WHERE idx < {NB_WORDS} GROUP BY doc_id) s USING (doc_id))"""


@register("build_vocab", f"WITH {_VOCAB_SQL} SELECT token, n, idx FROM vocab")
def q_build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)[1]


@register("texts_to_sequences", f"WITH {_SEQ_SQL} SELECT doc_id, array_to_string(ids, ' ') AS seq FROM seq")
def q_texts_to_sequences(spark, sf_dir):
    return _seq(spark, sf_dir).select("doc_id", F.array_join("seq", " ").alias("seq"))


@register("custom_tokenizer", f"""WITH {_VOCAB_SQL}
SELECT d.doc_id, coalesce(s.kept, '') AS kept FROM documents d LEFT JOIN
  (SELECT doc_id, array_to_string(list(token ORDER BY pos), ' ') AS kept
   FROM tok JOIN vocab USING (token) WHERE idx < {NB_WORDS} GROUP BY doc_id) s USING (doc_id)""")
def q_custom_tokenizer(spark, sf_dir):
    t, v = _vocab(spark, sf_dir)
    return V.custom_tokenizer(t, "doc_id", "tokens", v, NB_WORDS).select("doc_id", F.array_join("kept", " ").alias("kept"))


_ENCODE_SQL = f"""WITH {_SEQ_SQL}
SELECT doc_id,
       array_to_string(list_concat(ids[1:{MAX_LEN}], list_transform(range(greatest({MAX_LEN} - len(ids), 0)), lambda i: 0)), ' ') AS input_ids,
       array_to_string(list_transform(range(1, {MAX_LEN} + 1), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ' ') AS attention_mask
FROM seq"""


# --- the same results from a token table bucketed by document ---

def _saved(spark, sf_dir, tokens):
    """The tokens of documents as a saved table (a fresh one for each call)."""
    path = scratch_path(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return V.save_tokens(tokens, "doc_id", "tokens", "tokens_" + path.rsplit("-", 1)[1], path, n)


def _saved_keras(spark, sf_dir):
    t = _saved(spark, sf_dir, _tokens(spark, sf_dir))
    return t, V.vocab_of(t.where(F.col("token").isNotNull()), "doc_id")


def _saved_sklearn(spark, sf_dir):
    return _saved(spark, sf_dir, read_spread(spark, sf_dir, "documents").select("doc_id", TX.tokenize_sklearn("text").alias("tokens")))


@register("saved_tf_count", ORACLE["tf_count"])
def q_saved_tf_count(spark, sf_dir):
    return V.saved_tf(_saved_sklearn(spark, sf_dir), "doc_id")


@register("saved_tfidf_topk", ORACLE["tfidf_topk"])
def q_saved_tfidf_topk(spark, sf_dir):
    t = _saved_sklearn(spark, sf_dir)
    n = F.lit(t.agg(F.count_distinct("doc_id")).scalar())
    return FE.tfidf_topk_of(V.saved_tf(t, "doc_id"), "doc_id", TOPK, n, digits=6)


@register("saved_sequences", f"WITH {_SEQ_SQL} SELECT doc_id, array_to_string(ids, ' ') AS seq FROM seq")
def q_saved_sequences(spark, sf_dir):
    t, v = _saved_keras(spark, sf_dir)
    return V.saved_sequences(t, "doc_id", v, NB_WORDS).select("doc_id", F.array_join("seq", " ").alias("seq"))


@register("saved_encode_fixed", _ENCODE_SQL)
def q_saved_encode_fixed(spark, sf_dir):
    t, v = _saved_keras(spark, sf_dir)
    s = V.encode_fixed(V.saved_sequences(t, "doc_id", v, NB_WORDS), "seq", MAX_LEN)
    return s.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("attention_mask", " ").alias("attention_mask"))


@register("pad_pre", f"""WITH {_SEQ_SQL}, m AS (SELECT max(len(ids)) AS L FROM seq)
SELECT doc_id, array_to_string(list_concat(list_transform(range(L - len(ids)), lambda i: 0), ids), ' ') AS padded
FROM seq, m""")
def q_pad_pre(spark, sf_dir):
    """Two passes are inherent (the corpus maximum, then padding): the
    sequences are materialised once with a reliable checkpoint instead of
    recomputing tokens, vocabulary and joins inside the max subquery.  The ids
    become strings before they are padded: a text is padded to the longest of the
    corpus, and a zero of the padding is then one shared string, not a number that is
    written out each time."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    s = _seq(spark, sf_dir).checkpoint(eager=True)
    s = V.pad_pre(s.withColumn("seq", F.col("seq").cast("array<string>")), "seq")
    return s.select("doc_id", F.array_join("padded", " ").alias("padded"))


@register("encode_fixed", _ENCODE_SQL)
def q_encode_fixed(spark, sf_dir):
    s = V.encode_fixed(_seq(spark, sf_dir), "seq", MAX_LEN)
    return s.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"))


_HR = "row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)"


@register("batch_rows", f"SELECT doc_id, CAST(({_HR} - 1) // {BATCH} AS BIGINT) AS batch FROM documents")
def q_batch_rows(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return V.batch_rows(d, "doc_id", BATCH, seed=42)


@register("pad_dynamic", f"""WITH {_SEQ_SQL},
b AS (SELECT doc_id, ids, ({_HR} - 1) // {BATCH} AS batch FROM seq)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(max(len(ids)) OVER (PARTITION BY batch) AS BIGINT) AS padded_len FROM b""")
def q_pad_dynamic(spark, sf_dir):
    return V.pad_dynamic(_seq(spark, sf_dir), "doc_id", "seq", BATCH, seed=42).select("doc_id", "batch", "padded_len")


@register("embedding_lookup", f"""WITH {_VOCAB_SQL}
SELECT v.token, v.idx, CAST(e.embedding IS NOT NULL AS INTEGER) AS has_vector,
       round(coalesce(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 0.0), 6) AS vec_sum
FROM vocab v LEFT JOIN embeddings e ON e.vec_id + 1 = v.idx
WHERE v.idx < {NB_WORDS}""")
def q_embedding_lookup(spark, sf_dir):
    _, v = _vocab(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("idx"), "embedding")
    out = V.embedding_lookup(v, e, "idx", "embedding", DIM, NB_WORDS)
    return out.select("token", "idx", "has_vector",
                      rround(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vec_sum"))


@register("pool_max", """
SELECT label, CAST(dim AS BIGINT) AS dim, round(CAST(max(x) AS DOUBLE), 6) AS value
FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM embeddings) e
GROUP BY label, dim""")
def q_pool_max(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    p = V.pool_max(e, "label", "embedding")
    return p.select("label", F.posexplode("embedding").alias("dim", "x")) \
            .select("label", F.col("dim").cast("long").alias("dim"), rround(F.col("x").cast("double"), 6).alias("value"))


@register("pool_first", """
SELECT label, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim, round(CAST(unnest(v) AS DOUBLE), 6) AS value
FROM (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) f""")
def q_pool_first(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    p = V.pool_first(e, "label", "vec_id", "embedding")
    return p.select("label", F.posexplode("embedding").alias("dim", "x")) \
            .select("label", F.col("dim").cast("long").alias("dim"), rround(F.col("x").cast("double"), 6).alias("value"))


@register("synonym_lookup", f"""
WITH syn AS (SELECT DISTINCT lower(t) AS synset, t AS lemma FROM (SELECT unnest({D.tokenize_ws('text')}) AS t FROM documents) a),
w AS (SELECT DISTINCT unnest({D.tokenize_ws('text')}) AS word FROM benchmark),
m AS (SELECT synset, list(DISTINCT lemma) AS members FROM syn GROUP BY synset)
SELECT w.word, array_to_string(list_sort(list_distinct(flatten(list(m.members)))), '|') AS synonyms
FROM w JOIN syn s ON s.lemma = w.word JOIN m USING (synset) GROUP BY w.word""")
def q_synonym_lookup(spark, sf_dir):
    """Case-variant synonym table derived from documents (synset = lower-cased
    word, lemma = surface form); looked up for the words of ``benchmark``."""
    d = read_spread(spark, sf_dir, "documents")
    syn = TX.explode_tokens(d, [], TX.tokenize_ws("text"), "lemma") \
           .select(F.lower("lemma").alias("synset"), "lemma").distinct()
    words = TX.explode_tokens(read_table(spark, sf_dir, "benchmark"), [], TX.tokenize_ws("text"), "word")
    out = V.synonym_lookup(words, "word", syn)
    return out.select("word", F.array_join("synonyms", "|").alias("synonyms"))
