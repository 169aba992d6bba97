"""log2(x + 1) as a column, an array expression and an ML transformer."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATIVE_POLICIES = ("error", "clip")


def _check_policy(policy: str) -> None:
    if policy not in NEGATIVE_POLICIES:
        raise ValueError("negative_policy must be 'error' or 'clip'")


def log2p1(value: Column, negative_policy: str = "error") -> Column:
    """FLOAT ``log2(x + 1)``; NaN stays NaN, infinities become NaN.

    Finite negatives fail the job (``error``) or count as zero (``clip``).
    """
    _check_policy(negative_policy)
    single = value.cast("float")
    usable = F.when(F.abs(single) == float("inf"), F.lit(float("nan")).cast("float")).otherwise(single)
    if negative_policy == "clip":
        usable = F.when(usable < 0, F.lit(0.0).cast("float")).otherwise(usable)
    else:
        message = F.concat(F.lit("negative value before log2p1: "), usable.cast("string"))
        usable = F.when(usable < 0, F.raise_error(message).cast("float")).otherwise(usable)
    return F.log2((usable + F.lit(1.0).cast("float")).cast("double")).cast("float")


def log2p1_array(features: Column, negative_policy: str = "error") -> Column:
    _check_policy(negative_policy)
    return F.transform(features, lambda v: log2p1(v, negative_policy))


def negative_policy_report(matrix: DataFrame) -> DataFrame:
    """One row ``(n_negative, minimum_negative)`` over finite values: what ``error`` would refuse."""
    negatives = F.filter("features", lambda v: (v < 0) & (v != float("-inf")))
    return matrix.select(negatives.alias("found")).agg(
        F.coalesce(F.sum(F.size("found")), F.lit(0)).cast("bigint").alias("n_negative"),
        F.min(F.array_min("found")).cast("double").alias("minimum_negative"),
    )


class Log2p1(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``log2(x + 1)`` over an array column, usable in a saved ML workflow."""

    negativePolicy = Param(Params._dummy(), "negativePolicy", "error or clip", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "logged", negativePolicy: str = "error"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="logged", negativePolicy="error")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        policy = self.getOrDefault(self.negativePolicy)
        logged = log2p1_array(F.col(self.getInputCol()), policy)
        return dataset.withColumn(self.getOutputCol(), logged)
