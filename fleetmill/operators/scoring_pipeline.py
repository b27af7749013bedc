"""Scoring as a saved pipeline: features, checks with reasons, and a model's predictions, each a transformer with its own parameters.

The pipeline is fitted elsewhere; what it needs (envelope, weights, least history) are parameters, so that it is saved
and loaded like any other and scores a batch without seeing training rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket, by_cycle, clip, slope, trailing

#: Why a row isn't scored; of several reasons the first counts.
MISSING, OUTSIDE, SHORT = "missing value", "outside the envelope", "short history"


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose parameters are given by name."""

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._set(**self._input_kwargs)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))


class Trailing(_Stage):
    """level, slope, n_cycles_used: trailing mean and slope of a sensor, and how many cycles the unit has had."""

    sensor = Param(Params._dummy(), "sensor", "column", TypeConverters.toString)
    window = Param(Params._dummy(), "window", "cycles", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        x, w = F.col(self.value("sensor")), trailing(self.value("window"))
        return df.withColumns({"level": F.avg(x).over(w), "slope": F.coalesce(slope(x, "cycle", w), F.lit(0.0)), "n_cycles_used": F.row_number().over(by_cycle())})


class Check(_Stage):
    """reject: why a row can't be scored, or null. Sensors come with lower and upper limits, in the same order."""

    sensors = Param(Params._dummy(), "sensors", "columns", TypeConverters.toListString)
    lower = Param(Params._dummy(), "lower", "least values", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "greatest values", TypeConverters.toListFloat)
    least = Param(Params._dummy(), "least", "least history", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [F.col(c) for c in self.value("sensors")]
        absent = reduce(lambda a, c: a | c.isNull() | F.isnan(c), cols, F.lit(False))
        beyond = [F.when((c < lo) | (c > hi), n) for c, n, lo, hi in zip(cols, self.value("sensors"), self.value("lower"), self.value("upper"), strict=True)]
        where = F.concat_ws(", ", *beyond)
        reason = F.when(absent, MISSING).when(where != "", F.concat(F.lit(f"{OUTSIDE}: "), where)).when(F.col("n_cycles_used") < self.value("least"), SHORT)
        return df.withColumn("reject", reason)


class Linear(_Stage):
    """predicted_rul: an intercept and weighted columns, clipped; null where a row is rejected."""

    columns = Param(Params._dummy(), "columns", "columns", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "a weight for each column", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)
    cap = Param(Params._dummy(), "cap", "greatest prediction", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        total = reduce(lambda a, x: a + F.col(x[0]) * x[1], zip(self.value("columns"), self.value("weights"), strict=True), F.lit(self.value("intercept")))
        pred: Column = clip(total, self.value("cap"))
        return df.withColumn("predicted_rul", F.when(F.col("reject").isNull(), pred)).withColumn("rul_at_cap", F.col("predicted_rul") >= self.value("cap"))


def envelope(train: DataFrame, sensors: list[str], margin: float = 0.0) -> tuple[list[float], list[float]]:
    """(lower, upper) limits of the sensors: their range in the training rows, wider by a share of it."""
    one = train.agg(*[f(c).cast("double") for c in sensors for f in (F.min, F.max)]).first()  # a single row
    lo, hi = list(one[::2]), list(one[1::2])
    return [a - margin * (z - a) for a, z in zip(lo, hi, strict=True)], [z + margin * (z - a) for a, z in zip(lo, hi, strict=True)]


def pipeline(sensor: str, window: int, sensors: list[str], limits: tuple[list[float], list[float]], least: int, weights: tuple[float, float, float], cap: float) -> PipelineModel:
    """weights: intercept, of the level, of the slope."""
    return PipelineModel([Trailing(sensor=sensor, window=window), Check(sensors=sensors, lower=limits[0], upper=limits[1], least=least),
                          Linear(columns=["level", "slope"], weights=list(weights[1:]), intercept=weights[0], cap=float(cap))])


def score(model: PipelineModel, cycles: DataFrame, buckets: list) -> tuple[DataFrame, DataFrame]:
    """(scores, rejects) of a batch: every row is in one of them; a reject comes with its reason."""
    out = model.transform(cycles)
    scores = out.where("reject is null").withColumn("bucket", bucket("predicted_rul", buckets)).drop("reject")
    return scores, out.where("reject is not null").select("dataset", "unit", "cycle", "n_cycles_used", "reject")
