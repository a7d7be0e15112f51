"""Registered queries: classifiers, scoring, cross-validation, bootstrap, styles,
learning curves, runs (SURVEY 2.11).

Trained models have no SQL twin, so these are rows-only (their folds, draws and
training sets have one); tests check them against MLlib's own estimators and
evaluator, better-than-majority accuracy and support.  The label is
``documents.lang`` (alphabetical index) and the split is the exact seeded
``split_ceil`` (20 % test).
"""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..operators import augment as A
from ..operators import experiments as E
from ..operators import features as FE
from ..operators import labels as L
from ..operators import models as M
from ..operators import profile as P
from ..operators import splits as S
from ..operators import evaluate as EV
from ..sources import files as FS
from ..sources.tables import read_spread, read_table
from .registry import register

LSA_TERMS, LSA_K = 5000, 100   # FIXED VALUES: columns and components of the analysed LSA experiment
META = list(TX.META_FEATURES)


def _labelled(spark, sf_dir):
    d = read_spread(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    d = L.encode_label_alpha(d, "lang", "label").withColumn("label", F.col("label").cast("double"))
    return S.split_ceil(d, "doc_id", 0.2, 42)


def _pred(df):
    return df.select("doc_id", "split", F.col("label").cast("int").alias("y"),
                     F.col("prediction").cast("int").alias("pred"))


def _n_classes(df):
    """From the fitted label index, so another language is another class."""
    return int(df.agg(F.max("label")).first()[0]) + 1


def _vectors(spark, sf_dir, width, with_meta=False):
    """Hashed TF-IDF over all terms, fitted on the training split; with the eight
    standardised meta features behind it."""
    s = _labelled(spark, sf_dir)
    count, *weigh = M.hashed_tfidf("tokens", "tfidf", width)
    s = count.transform(s.withColumn("tokens", TX.tokenize_sklearn("text")))
    s = P.text_meta_features(s, "text", K.TEST_STOPWORDS, keep=["doc_id", "split", "label", "__tf"]) if with_meta else s.select("doc_id", "split", "label", "__tf")
    s = E.stored(s, "vectors")   # terms and meta features are counted once
    train = F.col("split") == "train"
    vec = Pipeline(stages=weigh).fit(s.where(train)).transform(s).drop("__tf", "__tfidf")
    if not with_meta:
        return vec.withColumnRenamed("tfidf", "features")
    meta = FE.standard_scale(vec, META, fit_on=s.where(train))
    return FE.assemble_features(meta, ["tfidf"] + [c + "_z" for c in META])


def _fit_score(df, est):
    model = est.fit(df.where(F.col("split") == "train"))
    return _pred(model.transform(df.select("doc_id", "split", "label", "features")))


@register("clf_tfidf_boost")
def q_clf_tfidf_boost(spark, sf_dir):
    return _fit_score(_vectors(spark, sf_dir, M.DENSE_WIDTH), M.ovr_gbt())


@register("clf_meta_boost")
def q_clf_meta_boost(spark, sf_dir):
    return _fit_score(_vectors(spark, sf_dir, M.DENSE_WIDTH, with_meta=True), M.ovr_gbt())


@register("clf_lsa_boost")
def q_clf_lsa_boost(spark, sf_dir):
    """TF-IDF over words and word pairs and its SVD, both fitted on the training rows."""
    s, train = _labelled(spark, sf_dir).withColumn("tokens", TX.tokenize_sklearn("text")), F.col("split") == "train"
    rows = FE.tfidf_rows(s, "doc_id", "tokens", LSA_TERMS, fit_on=train, pairs=True, keep=["split", "label"])
    out, _ = FE.lsa(rows, "doc_id", LSA_K, fit_on=train)
    return _fit_score(out.withColumn("features", array_to_vector("lsa")).drop("lsa"), M.ovr_gbt())


@register("clf_mlp_meta")
def q_clf_mlp_meta(spark, sf_dir):
    v = _vectors(spark, sf_dir, M.DENSE_WIDTH, with_meta=True)
    return _fit_score(v, M.mlp(M.DENSE_WIDTH + len(META), [128], _n_classes(v)))


@register("clf_mlp_text")
def q_clf_mlp_text(spark, sf_dir):
    v = _vectors(spark, sf_dir, M.DENSE_WIDTH)
    return _fit_score(v, M.mlp(M.DENSE_WIDTH, [256, 128], _n_classes(v)))


@register("clf_pooled_head")
def q_clf_pooled_head(spark, sf_dir):
    """Multinomial logistic head on frozen pooled vectors (``embeddings``)."""
    e = read_table(spark, sf_dir, "embeddings")
    e = S.split_ceil(e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("double").alias("label"),
                              array_to_vector("embedding").alias("features")), "doc_id", 0.2, 42)
    return _fit_score(e, M.logreg())


def _counts(spark, sf_dir):
    """(doc_id, split, label, tf), stored: cleaned, tokenised, hashed and split once."""
    s = _labelled(spark, sf_dir).withColumn("tokens", TX.tokenize_sklearn(TX.clean_text("text")))
    return E.stored(E.hashed_counts(s, "tokens").select("doc_id", "split", "label", "tf"), "counts")


@register("features_fit_predict")
def q_features_fit_predict(spark, sf_dir):
    """The fit/predict chain on stored counts: idf, norm and classifier as one ML
    Pipeline, fitted on the training rows."""
    s = _counts(spark, sf_dir)
    chain = Pipeline(stages=[M.SmoothIdf(inputCol="tf", outputCol="tfidf"), Normalizer(p=2.0, inputCol="tfidf", outputCol="features"), M.logreg()])
    return _pred(chain.fit(s.where(F.col("split") == "train")).transform(s))


@register("batch_score")
def q_batch_score(spark, sf_dir):
    """Fit, save the PipelineModel, load it back and score the whole table."""
    s = _labelled(spark, sf_dir)
    model = M.text_pipeline(M.logreg()).fit(s.where(F.col("split") == "train"))
    path = FS.scratch_path(spark, "model")
    model.write().overwrite().save(path)
    return _pred(M.batch_score(PipelineModel.load(path), s))


FOLDS = 10


def _folded(rows):
    """Stored rows with their fold."""
    return S.kfold_contiguous(rows, "doc_id", FOLDS).withColumn("fold", F.col("fold").cast("int"))


@register("cv_experiment")
def q_cv_experiment(spark, sf_dir):
    """Ten contiguous folds and two settings: a report for every fold.  Terms are counted
    once; a fold's idf comes from the other folds' counts, so no fold sees its own terms."""
    s = _counts(spark, sf_dir).where(F.col("split") == "train")
    table = E.stored(_folded(E.stored(s.select("doc_id", "label", "tf"), "train")).select("label", "fold", "tf"), "folds")
    lr = M.logreg(max_iter=20)
    grid = M.param_runs(lr, {lr.regParam: [0.0, 0.01]})
    report = EV.class_report(E.cross_validate(table, lr, grid), ["setting", "fold"])
    reg = F.element_at(F.array(*[F.lit(float(g[lr.regParam])) for g in grid]), F.col("setting") + 1)
    return report.withColumn("reg_param", reg)


_HOLD = """row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= ceil((SELECT count(*) FROM documents) * CAST(0.2 AS DOUBLE))"""


@register("cv_folds", f"""
WITH s AS (SELECT doc_id, lang, {_HOLD} AS test FROM documents),
t AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS r0 FROM s WHERE NOT test),
p AS (SELECT count(*) // {FOLDS} AS q, count(*) % {FOLDS} AS m FROM t),
f AS (SELECT lang, CAST(CASE WHEN r0 < m * (q + 1) THEN r0 // (q + 1) ELSE m + (r0 - m * (q + 1)) // q END AS INTEGER) AS fold FROM t, p),
c AS (SELECT fold, lang, count(*) AS n FROM f GROUP BY fold, lang),
a AS (SELECT lang, count(*) AS total FROM f GROUP BY lang)
SELECT CAST(g.fold AS INTEGER) AS fold, a.lang, coalesce(c.n, 0) AS n_test, a.total - coalesce(c.n, 0) AS n_train
FROM a CROSS JOIN range(0, {FOLDS}) g(fold) LEFT JOIN c ON c.fold = g.fold AND c.lang = a.lang""")
def q_cv_folds(spark, sf_dir):
    """The folds of ``cv_experiment``: rows of each label tested and trained on."""
    train = _labelled(spark, sf_dir).where(F.col("split") == "train")
    return E.fold_counts(_folded(E.stored(train.select("doc_id", "lang"), "train-keys")), "lang", FOLDS)


@register("bootstrap_report")
def q_bootstrap_report(spark, sf_dir):
    """Ten bootstrap rounds: fitted on the rows drawn (weighted by how often), reported on
    the rows never drawn."""
    s = _labelled(spark, sf_dir).withColumn("tokens", TX.tokenize_sklearn(TX.clean_text("text")))
    counts = E.hashed_counts(s, "tokens").select("doc_id", "label", "tf")
    draws = S.bootstrap_draws(s.select("doc_id"), "doc_id", rounds=10)
    table = E.stored(E.with_draws(counts, draws, "doc_id"), "rounds")
    return EV.class_report(E.bootstrap_fits(table, M.logreg(max_iter=20), range(10)), ["round"])


@register("style_experiment")
def q_style_experiment(spark, sf_dir):
    """Every training style fitted on its own training rows and applied to the shared
    validation originals: accuracy and F1 per style."""
    from .augment_queries import parallel_texts
    par = L.encode_label_alpha(parallel_texts(spark, sf_dir), "lang", "label").withColumn("label", F.col("label").cast("double"))
    v = A.variants(par, "doc_id", "label").select("split", "variant", "label", TX.tokenize_sklearn("text").alias("tokens"))
    table = E.stored(E.hashed_counts(v, "tokens").select("split", "variant", "label", "tf"), "variants")   # counted once, tokens are not stored
    found = EV.summary(E.style_fits(table, M.logreg(max_iter=20), A.STYLE_VARIANTS), ["style"])
    return found.select("style", "n", "accuracy", "f1_macro", "f1_weighted")


@register("augment_experiment")
def q_augment_experiment(spark, sf_dir):
    """Training rows enlarged by random edits, TF-IDF fitted on them, applied to the raw
    texts of a 5 % test split: a class report with and without the enlargement."""
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    same = docs.select("*", F.lit(None).cast("string").alias("bt1"), F.lit(None).cast("string").alias("bt2"))
    v = A.variants(same, "doc_id", "lang", val_frac=0.05, aug_frac=1.0).where(F.col("variant").isin("original", "augmented"))
    v = L.encode_label_alpha(E.stored(v.select("split", "variant", "lang", TX.tokenize_sklearn("text").alias("tokens")), "augmented-tokens"), "lang", "label")
    table = E.stored(E.hashed_counts(v, "tokens").select("split", "variant", F.col("label").cast("double").alias("label"), "tf"), "augmented")
    styles = {s: A.STYLE_VARIANTS[s] for s in ("natural", "augment")}
    return EV.class_report(E.style_fits(table, M.logreg(max_iter=20), styles), ["style"])


CURVE_SIZES, CURVE_SPLITS, CURVE_ROUNDS = range(200, 2601, 200), range(1, 6), range(10)


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    """A report for every size, split and iteration: models on nested training prefixes,
    each split with its own 20 % test rows."""
    d = read_spread(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    d = L.encode_label_alpha(d, "lang", "label").withColumn("label", F.col("label").cast("int"))
    counts = E.sparse_counts(d.select("doc_id", TX.tokenize_sklearn("text").alias("tokens")), "doc_id", "tokens", M.DENSE_WIDTH)
    table = E.stored(d.select("doc_id", "label").join(counts, "doc_id"), "curve-counts")
    table = E.stored(S.split_many(table, "doc_id", 0.2, {f"split_{s}": f"split-{s}" for s in CURVE_SPLITS}), "curve")
    classes = int(table.agg(F.max("label")).first()[0] or 0) + 1
    cells = {f"{s}-{i}": (F.col(f"split_{s}") == "train", F.col(f"split_{s}") == "test") for s in CURVE_SPLITS for i in CURVE_ROUNDS}
    found = E.learning_curve(table, "doc_id", cells, list(CURVE_SIZES), classes, M.DENSE_WIDTH)
    part = F.split("cell", "-")
    counts = found.select(part[0].cast("int").alias("split_no"), part[1].cast("int").alias("iteration"), "size", "y", "pred", "n")
    return EV.class_report(E.stored(counts, "curve-pairs"), ["split_no", "iteration", "size"])


@register("param_runs")
def q_param_runs(spark, sf_dir):
    """A parameter grid, each setting fitted and scored: one row per run, with the rows
    scored and the seconds of its fit."""
    s = _counts(spark, sf_dir)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    idf = E.smooth_idf(*E.document_frequencies(train.withColumn("all", F.lit(0)), "all")[0])
    fitted, scored = E.stored(E.tfidf(train, idf), "train"), E.tfidf(test, idf)
    lr = M.logreg()

    def run(setting):
        began = time.time()
        model = lr.fit(fitted, setting)
        return round(time.time() - began, 3), E.pair_rows(model.transform(scored))

    grid = M.param_runs(lr, {lr.regParam: [0.0, 0.01], lr.maxIter: [20, 50]})
    found = E.fit_each(spark, {i: (lambda g=g: run(g)) for i, g in enumerate(grid)})
    counts = spark.createDataFrame([(i, *r) for i, (_, rows) in found.items() for r in rows], "run_id int, y int, pred int, n long")
    seconds = F.element_at(F.array(*[F.lit(found[i][0]) for i in range(len(grid))]), F.col("run_id") + 1)
    return EV.summary(counts, ["run_id"]).select("run_id", "n", "accuracy", "f1_macro", "f1_weighted", seconds.alias("seconds"))


@register("run_time")
def q_run_time(spark, sf_dir):
    """The run table of the parameter grid: seconds of each fit and the rows it scored."""
    return q_param_runs(spark, sf_dir).select("run_id", F.col("n").alias("n_scored"), "seconds")
