"""Min-max and robust scaling of plain columns as pipeline stages."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from resaleworth.operators.ranking import exact_percentiles


class ColumnScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - center) * factor + base per column; nothing is clipped."""

    centers = Param(Params._dummy(), "centers", "value that maps to the base", TypeConverters.toListFloat)
    factors = Param(Params._dummy(), "factors", "multiplier per column", TypeConverters.toListFloat)
    base = Param(Params._dummy(), "base", "value of the center after scaling", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, centers=None, factors=None, base=None):
        super().__init__()
        self._setDefault(base=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base = self.getOrDefault(self.base)
        fitted = zip(self.getInputCols(), self.getOrDefault(self.centers), self.getOrDefault(self.factors))
        return dataset.withColumns({name: (F.col(name) - center) * factor + base for name, center, factor in fitted})


class ColumnScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """``minmax`` maps the fitted range to [low, high]; ``robust`` centers on the median and divides by the IQR.

    A constant column keeps its spread of 1, so it maps to ``low`` (or 0).
    """

    method = Param(Params._dummy(), "method", "minmax or robust", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "lower end of the target range", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper end of the target range", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, method=None, low=None, high=None):
        super().__init__()
        if method not in (None, "minmax", "robust"):
            raise ValueError(f"unknown scaling method {method!r}")
        self._setDefault(method="minmax", low=0.0, high=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ColumnScalerModel:
        columns = self.getInputCols()
        if self.getOrDefault(self.method) == "robust":
            found = exact_percentiles(dataset, columns, (0.25, 0.5, 0.75))
            quartiles = [found[name] for name in columns]
            centers = [_number(middle) for _, middle, _ in quartiles]
            factors = [1 / _spread(lower, upper) for lower, _, upper in quartiles]
            return ColumnScalerModel(inputCols=columns, centers=centers, factors=factors, base=0.0)
        low, high = self.getOrDefault(self.low), self.getOrDefault(self.high)
        ends = dataset.agg(*[f(F.col(name).cast("double")) for name in columns for f in (F.min, F.max)]).first()
        centers = [_number(value) for value in ends[::2]]
        factors = [(high - low) / _spread(*pair) for pair in zip(ends[::2], ends[1::2])]
        return ColumnScalerModel(inputCols=columns, centers=centers, factors=factors, base=low)


def _number(value: float | None) -> float:
    return 0.0 if value is None else float(value)


def _spread(lower: float | None, upper: float | None) -> float:
    """Width of the fitted range, 1 if the column is constant or empty."""
    return (_number(upper) - _number(lower)) or 1.0
