"""MLlib estimators of the studies.

All expect a vector column ``x``, a double ``label`` (position in the sorted class
list) and a ``weight``.  Penalties follow a total-loss objective with inverse
strength ``C``, so MLlib's mean-loss penalty is ``1 / (C * sum of weights)``; with
balanced weights that sum is the number of training rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import threading
import uuid

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprstudy.constants import CLASSICAL_MODELS, DEFAULT_SEED

MODEL_NAMES = (*CLASSICAL_MODELS, "boosted_trees")
# the driver's LAPACK and ARPACK in Java keep state in static fields, so one decomposition runs at a time
_DECOMPOSING = threading.Lock()
WITH_PROBABILITY = ("logistic_l2", "elastic_net", "pca_logistic", "boosted_trees")


def logistic(n_train: int, l1_ratio: float, max_iter: int, C: float = 1.0) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="x",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (C * n_train),
        elasticNetParam=l1_ratio,
        standardization=False,
        maxIter=max_iter,
    )


def pca_components(requested: int, n_features: int, training_sizes: Sequence[int]) -> int:
    """Centred rows of the smallest training set span one dimension less than they are; at least one is kept."""
    return max(1, min(requested, n_features, min(training_sizes) - 1))


def estimator(name: str, n_train: int, n_classes: int, seed: int = DEFAULT_SEED, **params) -> Estimator:
    """The estimator of one linear model name; ``params`` override its defaults."""
    if name == "logistic_l2":
        return logistic(n_train, 0.0, params.get("max_iter", 2_000), params.get("C", 1.0))
    if name == "elastic_net":
        return logistic(n_train, params.get("l1_ratio", 0.5), params.get("max_iter", 5_000), params.get("C", 1.0))
    if name == "linear_svm":
        binary = LinearSVC(
            featuresCol="x",
            labelCol="label",
            weightCol="weight",
            regParam=1.0 / (params.get("C", 1.0) * n_train),
            standardization=False,
            maxIter=params.get("max_iter", 10_000),
        )
    else:
        raise ValueError(f"unknown model {name!r}; choose from {MODEL_NAMES}")
    if n_classes == 2:
        return binary
    return OneVsRest(
        classifier=binary, featuresCol="x", labelCol="label", weightCol="weight", parallelism=params.get("ovr_parallelism", 4)
    )


def as_vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", array_to_vector("x"))


def scores_of(fitted: Model, predicted: DataFrame) -> Column:
    """Class scores in label order: probabilities where the model has them, else raw margins."""
    for name in ("probability", "rawPrediction"):
        if name in predicted.columns:
            return vector_to_array(name)
    return F.lit(None).cast("array<double>")


def margin_scores(predicted: DataFrame) -> Column:
    """Raw decision values of a two-class model as one score that points to the second class."""
    return F.array(F.get(vector_to_array("rawPrediction"), F.lit(1)))


def _parts(fitted: Model) -> list[Model]:
    if isinstance(fitted, PipelineModel):
        return [fitted.stages[-1]]
    return list(getattr(fitted, "models", [fitted]))


def coefficient_matrix(fitted: Model, n_classes: int) -> np.ndarray | None:
    """Classes by features.  A two-class model's single row is mirrored for the first class."""
    parts = _parts(fitted)
    if hasattr(parts[0], "coefficientMatrix"):
        found = parts[0].coefficientMatrix.toArray()
    elif hasattr(parts[0], "coefficients"):
        found = np.vstack([part.coefficients.toArray() for part in parts])
    else:
        return None
    return np.vstack([-found[0], found[0]]) if found.shape[0] == 1 and n_classes == 2 else found


def principal_axes(train: DataFrame, components: int) -> list[Model]:
    """Stages that centre ``x`` and project it onto the principal axes of ``train``, as ``pc``.

    The truncated SVD runs over the distributed rows, whatever their width; only the
    ``d x components`` axes come back.
    """
    centre = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="centred").fit(train)
    rows = MLUtils.convertVectorColumnsFromML(centre.transform(train).select("centred"), "centred")
    matrix = RowMatrix(rows)
    with _DECOMPOSING:
        svd = matrix.computeSVD(components)
    axes, spread = svd.V.toArray(), svd.s.toArray() ** 2
    jvm = train.sparkSession.sparkContext._jvm
    arguments = DenseMatrix(*axes.shape, axes.ravel(order="F")), DenseVector(spread / max(spread.sum(), 1e-300))
    java = jvm.org.apache.spark.ml.feature.PCAModel(f"PCA_{uuid.uuid4().hex[:12]}", *[_py2java(train.sparkSession.sparkContext, a) for a in arguments])
    return [centre, PCAModel(java)._set(k=axes.shape[1], inputCol="centred", outputCol="pc")]


def wide_projection(train: DataFrame, components: int):
    """A function DataFrame -> DataFrame that adds ``pc``, the row on the principal axes of ``train``."""
    return PipelineModel(principal_axes(train, components)).transform


def pca_logistic(train: DataFrame, n_train: int, components: int, max_iter: int = 2_000) -> PipelineModel:
    """Centring, principal axes and the classifier as one model, which is saved and loaded whole."""
    stages = principal_axes(train, components)
    projected = PipelineModel(stages).transform(train)
    return PipelineModel([*stages, logistic(n_train, 0.0, max_iter).setFeaturesCol("pc").fit(projected)])
