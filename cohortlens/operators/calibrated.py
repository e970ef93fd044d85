"""Calibrated models as one saved pipeline: filling and scaling, learner, calibration.

The calibration steps are Spark ML Transformers of column expressions with their parameters written beside them, so a registry holds a really
calibrated ``PipelineModel`` and loading it needs nothing but its folder.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantile_dict
from .encode import fit_standard
from .train import fit_isotonic, fit_platt, make_learner


def _chance(df: DataFrame, column: str):
    """The chance of label 1 in a probability vector, or the column itself."""
    return F.col(column) if df.schema[column].dataType.typeName() == "double" else vector_to_array(column)[1]


class PlattCalibrator(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 / (1 + exp(-(slope p + offset)))."""

    slope = Param(Params._dummy(), "slope", "slope", TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "offset", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="probability", outputCol="calibrated", slope=1.0, offset=0.0):
        super().__init__()
        self._setDefault(inputCol="probability", outputCol="calibrated", slope=1.0, offset=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = _chance(df, self.getInputCol()) * self.getOrDefault("slope") + self.getOrDefault("offset")
        return df.withColumn(self.getOutputCol(), 1.0 / (1.0 + F.exp(-z)))


class IsotonicCalibrator(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A rising line through (boundary, value) points, level outside of them; the step is found by binary search in the JVM."""

    boundaries = Param(Params._dummy(), "boundaries", "scores, rising", TypeConverters.toListFloat)
    values = Param(Params._dummy(), "values", "calibrated scores", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol="probability", outputCol="calibrated", boundaries=None, values=None):
        super().__init__()
        self._setDefault(inputCol="probability", outputCol="calibrated")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        at, to = self.getOrDefault("boundaries"), self.getOrDefault("values")
        points = sorted(dict(zip(at, to)).items())
        xs, ys = [float(x) for x, _ in points], [float(y) for _, y in points]
        df = df.withColumn("__p", _chance(df, self.getInputCol()))
        found = Bucketizer(splits=[float("-inf"), *xs, float("inf")], inputCol="__p", outputCol="__step", handleInvalid="keep").transform(df)
        step, x, y = F.col("__step").cast("int"), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
        low, high = F.get(x, step - 1), F.get(x, step)
        line = F.get(y, step - 1) + (F.get(y, step) - F.get(y, step - 1)) * (F.col("__p") - low) / (high - low)
        out = F.when(step == 0, F.lit(ys[0])).when(step >= len(xs), F.lit(ys[-1])).otherwise(line)
        return found.withColumn(self.getOutputCol(), F.when(F.col("__p").isNull(), F.lit(None)).otherwise(out)).drop("__p", "__step")


def medians(df: DataFrame, features: list[str]) -> dict:
    """Exact median per column, 0 for a column without values: what a null is filled with."""
    found = quantile_dict(df, features, [0.5])
    return {c: float(v) if (v := found.get((c, 0.5))) is not None else 0.0 for c in features}


def serving_pipeline(train: DataFrame, features: list[str], kind: str, label: str, fills: dict, calibrate: DataFrame | None = None,
                     method: str = "platt", **kw) -> PipelineModel:
    """Nulls filled by ``fills``, features standardised by ``train``, the learner, and, with rows to ``calibrate`` on, a calibration step.  The model
    reads raw rows: everything it needs is inside."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c, 0.0)))) for c in features}
    params = fit_standard(train.select(*[e.alias(c) for c, e in filled.items()]), features)
    terms = [f"(coalesce(CAST(`{c}` AS DOUBLE), {float(fills.get(c, 0.0))!r}D) - {float(params[c][0])!r}D) / {float(params[c][1] or 1.0)!r}D AS `z_{c}`" for c in features]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__"),
              VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features")]

    def so_far(df):
        return PipelineModel(stages).transform(df)

    stages.append(make_learner(kind, label, **kw).fit(so_far(train)))
    if calibrate is not None:
        scored = so_far(calibrate).select(vector_to_array("probability")[1].alias("score"), F.col(label).alias("label"))
        if method == "platt":
            a, b = fit_platt(scored)
            stages.append(PlattCalibrator(slope=a, offset=b))
        else:
            made = fit_isotonic(scored)
            stages.append(IsotonicCalibrator(boundaries=[float(x) for x in made.boundaries], values=[float(x) for x in made.predictions]))
    return PipelineModel(stages)


def serve(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The columns of ``df`` with ``score``, calibrated where the model is, and ``pred``."""
    out = model.transform(df)
    score = F.col("calibrated") if "calibrated" in out.columns and "calibrated" not in df.columns else vector_to_array("probability")[1]
    return out.select(*[F.col(c) for c in df.columns if c not in ("score", "pred")], score.alias("score"), (score > 0.5).cast("int").alias("pred"))
