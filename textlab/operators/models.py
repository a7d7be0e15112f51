"""Classifiers on MLlib: fit, score, parameter grids.

Training is distributed: logistic regression by MLlib itself (gradients with
``treeAggregate``), boosted trees and perceptrons, whose rows MLlib makes dense, by passes
over sparse rows (``trees``, ``perceptron``).  Nothing here collects training data.  Features are TF-IDF
over all terms (hashed into a documented width), scaled meta blocks, LSA, or pooled
embeddings.

Text preparation is packaged as ML stages (``SklearnTokenizer``, ``SmoothIdf``) so a
whole chain is one ``pyspark.ml.Pipeline`` that can be fitted, saved and re-applied
(``batch_score``).  Experiments with many fits are in ``experiments``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from .perceptron import Perceptron
from .trees import OneVsRestTrees


class SklearnTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """ML stage: optional cleaning, then sklearn's default token pattern."""

    clean = Param(Params._dummy(), "clean", "apply clean_text first", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="tokens", clean=False):
        super().__init__()
        self._setDefault(clean=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.getInputCol())
        if self.getOrDefault(self.clean):
            x = TX.clean_text(x)
        return df.withColumn(self.getOutputCol(), TX.tokenize_sklearn(x))


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """ML stage: term counts times ``ln((1 + n) / (1 + df)) + 1``.

    MLlib's ``IDF`` has the logarithm; its one aggregation over sparse counts gives
    a vector as wide as the features (a documented width), to which 1 is added."""

    @keyword_only
    def __init__(self, inputCol="tf", outputCol="tfidf"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.getInputCol(), outputCol="__idf").fit(df).idf.toArray() + 1.0
        return ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def hashed_tfidf(tokens: str, out: str, width: int) -> list:
    """Stages for TF-IDF over all terms, hashed into ``width`` columns: no term is
    left out and no vocabulary passes through the driver; terms that share a
    column add up."""
    return [HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=width),
            SmoothIdf(inputCol="__tf", outputCol="__tfidf"),
            Normalizer(p=2.0, inputCol="__tfidf", outputCol=out)]


def ovr_gbt(features: str = "features", label: str = "label", max_iter: int = 20, max_depth: int = 3, seed: int = 42) -> OneVsRestTrees:
    """Multi-class boosted trees, one-vs-rest: MLlib's trees, grown for all classes in the same passes."""
    return OneVsRestTrees(features, label, max_iter, max_depth, seed)


def mlp(n_in: int, hidden: Sequence[int], n_classes: int, features: str = "features", label: str = "label",
        max_iter: int = 50, seed: int = 42) -> Perceptron:
    """MLlib's perceptron, fitted in passes over sparse rows."""
    return Perceptron([n_in, *hidden, n_classes], features, label, max_iter, seed, block=128)


def logreg(features: str = "features", label: str = "label", max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter)


def batch_score(model: PipelineModel | Model, df: DataFrame) -> DataFrame:
    """Apply a fitted model (or saved PipelineModel) to a table."""
    return model.transform(df)


#: Columns that all terms are hashed into: for linear models, and for trees and perceptrons.
LINEAR_WIDTH, DENSE_WIDTH = 1 << 16, 1 << 12


def text_pipeline(classifier, width: int = LINEAR_WIDTH, clean: bool = True) -> Pipeline:
    """tokens -> hashed TF-IDF over all terms -> classifier, as one fit/predict chain."""
    return Pipeline(stages=[SklearnTokenizer(inputCol="text", outputCol="tokens", clean=clean),
                            *hashed_tfidf("tokens", "features", width), classifier])


def accuracy_evaluator(label: str = "label", metric: str = "accuracy") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)


def param_runs(estimator, params: dict) -> list:
    """All combinations of the given parameter values (a ParamGridBuilder grid)."""
    b = ParamGridBuilder()
    for p, values in params.items():
        b = b.addGrid(p, list(values))
    return b.build()
