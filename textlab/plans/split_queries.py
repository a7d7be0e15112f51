"""Registered queries: sampling and splitting over ``documents``.

Key ``doc_id``; shuffled order is md5('seed:doc_id'), doc_id - identical in
Spark and DuckDB, so the oracle is a plain ``row_number()``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..operators import splits as S
from ..sources.tables import read_spread
from . import duck as D
from .registry import register

N = "(SELECT count(*) FROM documents)"


def _hr(seed, key="doc_id", part=""):
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key})"


def _docs(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents")


@register("shuffle", f"SELECT doc_id, CAST({_hr(42)} AS BIGINT) AS rank FROM documents")
def q_shuffle(spark, sf_dir):
    return S.shuffle(_docs(spark, sf_dir).select("doc_id"), "doc_id", 42)


@register("sample_frac", f"""
SELECT doc_id FROM (SELECT doc_id, {_hr(42)} AS r FROM documents) t WHERE r <= round_even({N} * CAST(0.1 AS DOUBLE), 0)""")
def q_sample_frac(spark, sf_dir):
    return S.sample_frac(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.1, 42)


@register("holdout_split", f"""
SELECT doc_id, CASE WHEN r <= floor({N} * CAST(0.05 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, {_hr(42)} AS r FROM documents) t""")
def q_holdout_split(spark, sf_dir):
    return S.holdout_split(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.05, 42)


@register("split_frac", f"""
SELECT doc_id, CASE WHEN r <= floor({N} * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, {_hr(42)} AS r FROM documents) t""")
def q_split_frac(spark, sf_dir):
    return S.split_frac(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.8, 42)


@register("split_ceil", f"""
SELECT doc_id, CASE WHEN r <= ceil({N} * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, {_hr(42)} AS r FROM documents) t""")
def q_split_ceil(spark, sf_dir):
    return S.split_ceil(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.2, 42)


@register("split_70_15_15", f"""
WITH c AS (SELECT round_even({N} * CAST(0.7 AS DOUBLE), 0) AS nt),
     v AS (SELECT nt, round_even(({N} - nt) * CAST(0.5 AS DOUBLE), 0) AS nv FROM c)
SELECT doc_id, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nv THEN 'valid' ELSE 'test' END AS split
FROM (SELECT doc_id, {_hr(42)} AS r FROM documents) t, v""")
def q_split_70_15_15(spark, sf_dir):
    return S.split_70_15_15(_docs(spark, sf_dir).select("doc_id"), "doc_id", 42)


@register("split_tail", f"""
SELECT doc_id, CASE WHEN r <= floor({N} * CAST(1.0 - 0.2 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) t""")
def q_split_tail(spark, sf_dir):
    return S.split_tail(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.2)


@register("split_halves", f"""
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
h AS (SELECT doc_id, CASE WHEN r <= {N} // 2 THEN 0 ELSE 1 END AS half,
             CASE WHEN r <= {N} // 2 THEN r ELSE r - {N} // 2 END AS pos FROM k),
hr AS (SELECT doc_id, half, {_hr(42, 'pos', 'half')} AS r2, count(*) OVER (PARTITION BY half) AS nh FROM h)
SELECT doc_id, CASE WHEN r2 <= ceil(nh * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM hr""")
def q_split_halves(spark, sf_dir):
    return S.split_halves(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.2, 42)


@register("split_pairs", f"""
WITH pr AS (SELECT doc_id AS pair_id, {_hr(42)} AS r FROM documents)
SELECT pair_id, CAST(p - 1 AS BIGINT) AS variant_pos,
       CASE WHEN r <= ceil({N} * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM pr, range(1, 3) AS g(p)""")
def q_split_pairs(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"),
                                    F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("variant_pos"))
    return S.split_pairs(d, "pair_id", 0.2, 42).select("pair_id", "variant_pos", "split")


@register("stratified_split", f"""
SELECT doc_id, lang, CASE WHEN r <= ceil(nl * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, {_hr(42, 'doc_id', 'lang')} AS r, count(*) OVER (PARTITION BY lang) AS nl
      FROM documents) t""")
def q_stratified_split(spark, sf_dir):
    return S.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "lang", 0.2, 42)


@register("kfold_contiguous", f"""
WITH p AS (SELECT {N} // 10 AS q, {N} % 10 AS m)
SELECT doc_id, CAST(CASE WHEN r0 < m * (q + 1) THEN r0 // (q + 1) ELSE m + (r0 - m * (q + 1)) // q END AS BIGINT) AS fold
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r0 FROM documents) t, p""")
def q_kfold_contiguous(spark, sf_dir):
    return S.kfold_contiguous(_docs(spark, sf_dir).select("doc_id"), "doc_id", 10)


@register("bootstrap_oob", f"""
WITH ranked AS (SELECT doc_id, {_hr('bootstrap-order')} AS r FROM documents),
draws AS (SELECT id // {N} AS round, id % {N} AS j FROM range(10 * {N}) t(id)),
drawn AS (SELECT round, CAST(floor({D.hash_uniform('draw', 'round', 'j')} * {N}) + 1 AS BIGINT) AS r, count(*) AS c
          FROM draws GROUP BY ALL)
SELECT g.round, k.doc_id, CAST(coalesce(d.c, 0) AS BIGINT) AS times_drawn
FROM ranked k CROSS JOIN range(0, 10) g(round) LEFT JOIN drawn d ON d.round = g.round AND d.r = k.r""")
def q_bootstrap_oob(spark, sf_dir):
    return S.bootstrap_oob(_docs(spark, sf_dir).select("doc_id"), "doc_id", rounds=10)


@register("bootstrap_draws", f"""
WITH ranked AS (SELECT doc_id, {_hr('bootstrap-order')} AS r FROM documents),
draws AS (SELECT id // {N} AS round, id % {N} AS j FROM range(10 * {N}) t(id)),
drawn AS (SELECT round, CAST(floor({D.hash_uniform('draw', 'round', 'j')} * {N}) + 1 AS BIGINT) AS r, count(*) AS c
          FROM draws GROUP BY ALL)
SELECT d.round, k.doc_id, CAST(d.c AS BIGINT) AS times_drawn FROM drawn d JOIN ranked k USING (r)""")
def q_bootstrap_draws(spark, sf_dir):
    """The rows each of ten rounds drew, with their number; what is missing is out of bag."""
    return S.bootstrap_draws(_docs(spark, sf_dir).select("doc_id"), "doc_id", rounds=10)


@register("leak_check", f"""
WITH s AS (SELECT doc_id, text, CASE WHEN {_hr(42)} <= floor({N} * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
           FROM documents)
SELECT v.doc_id FROM s v
WHERE v.split = 'val' AND md5({D.clean_text('v.text')}) IN
      (SELECT md5({D.clean_text('t.text')}) FROM s t WHERE t.split = 'train')""")
def q_leak_check(spark, sf_dir):
    s = S.holdout_split(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", 0.2, 42)
    return S.leaked_rows(s, "doc_id", "text", TX.clean_text)


_SIZES = list(range(200, 2601, 200))
_GRID_SPLITS = list(range(1, 6))
_GRID_ITERS = list(range(0, 10))


@register("size_grid", f"""
WITH rep AS (SELECT doc_id, lang, s AS split_no, i AS iteration,
                    CAST(s AS VARCHAR) || '-' || CAST(i AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR) AS k
             FROM documents, range(1, 6) a(s), range(0, 10) b(i)),
rk AS (SELECT *, row_number() OVER (PARTITION BY split_no, iteration ORDER BY md5('grid:' || k), k) AS r FROM rep),
sizes AS (SELECT unnest({_SIZES}) AS size),
labels AS (SELECT DISTINCT split_no, iteration, lang FROM rk WHERE r <= {_SIZES[-1]})
SELECT CAST(l.split_no AS INTEGER) AS split_no, CAST(l.iteration AS INTEGER) AS iteration,
       CAST(z.size AS INTEGER) AS size, l.lang,
       CAST((SELECT count(*) FROM rk WHERE rk.split_no = l.split_no AND rk.iteration = l.iteration
             AND rk.lang = l.lang AND rk.r <= z.size) AS BIGINT) AS n
FROM labels l, sizes z""")
def q_size_grid(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "lang")
    return S.size_grid_counts(d, "doc_id", "lang", _SIZES, _GRID_SPLITS, _GRID_ITERS)


_UPPER_CASE_MAP = {k.upper(): v for k, v in K.TEST_LANG_LABELS.items()}


@register("cross_corpus", f"""
WITH s AS (SELECT doc_id, lang, CASE WHEN {_hr(42)} <= floor({N} * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
           FROM documents)
SELECT CASE WHEN split = 'train' THEN 'corpus_a' ELSE 'corpus_b' END AS corpus, doc_id,
       CAST(CASE WHEN split = 'train' THEN (CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.TEST_LANG_LABELS.items())} END)
            ELSE (CASE upper(lang) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _UPPER_CASE_MAP.items())} END) END AS BIGINT) AS label_idx
FROM s""")
def q_cross_corpus(spark, sf_dir):
    """Train on corpus A, test on corpus B whose labels are spelled differently
    (upper-case here); both label dictionaries map to one index."""
    from ..operators import labels as L
    s = S.holdout_split(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", 0.2, 42)
    a = L.map_label(s.where(F.col("split") == "train"), "lang", K.TEST_LANG_LABELS) \
         .select(F.lit("corpus_a").alias("corpus"), "doc_id", "label_idx")
    b = s.where(F.col("split") == "val").withColumn("lang", F.upper("lang"))
    b = L.map_label(b, "lang", _UPPER_CASE_MAP).select(F.lit("corpus_b").alias("corpus"), "doc_id", "label_idx")
    return a.unionByName(b).withColumn("label_idx", F.col("label_idx").cast("long"))
