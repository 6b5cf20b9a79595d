"""MLlib ``Transformer`` wrappers (U3) so the feature steps compose in a
``pyspark.ml.Pipeline`` and persist with it. Each stage only delegates to
the DataFrame function of the same step; ``df.transform(f)`` chains are
the lighter alternative.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from gridcast.functions.transforms import log_transform
from gridcast.operators.features import drop_nulls, lag_features, moving_average, time_features
from gridcast.operators.resample import resample


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def setParams(self, **kwargs):
        return self._set(**{k: v for k, v in kwargs.items() if v is not None})


class ResampleStage(_Stage):
    granularity = Param(Params._dummy(), "granularity", "granularity name",
                        typeConverter=TypeConverters.toString)
    to_date = Param(Params._dummy(), "to_date", "last tick (inclusive)",
                    typeConverter=TypeConverters.toString)
    fill = Param(Params._dummy(), "fill", "value of missing ticks",
                 typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, granularity="one_hour", to_date=None, fill=0.1):
        super().__init__()
        self._setDefault(granularity="one_hour", fill=0.1)
        self.setParams(**self._input_kwargs)

    def _transform(self, df):
        to_date = self.getOrDefault(self.to_date) if self.isDefined(self.to_date) else None
        return resample(df, self.getOrDefault(self.granularity), to_date=to_date,
                        fill=self.getOrDefault(self.fill))


class TimeInfoStage(_Stage):
    info = Param(Params._dummy(), "info", "subset of ['hour', 'weekend']",
                 typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, info=None):
        super().__init__()
        self._setDefault(info=["hour", "weekend"])
        self.setParams(**self._input_kwargs)

    def _transform(self, df):
        info = self.getOrDefault(self.info)
        return time_features(df, hour="hour" in info, weekend="weekend" in info)


class LagStage(_Stage):
    lags = Param(Params._dummy(), "lags", "number of lags", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, lags=24):
        super().__init__()
        self._setDefault(lags=24)
        self.setParams(**self._input_kwargs)

    def _transform(self, df):
        return lag_features(df, self.getOrDefault(self.lags))


class MovingAverageStage(_Stage):
    n = Param(Params._dummy(), "n", "previous rows averaged", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, n=12):
        super().__init__()
        self._setDefault(n=12)
        self.setParams(**self._input_kwargs)

    def _transform(self, df):
        return moving_average(df, self.getOrDefault(self.n))


class LogStage(_Stage):
    kind = Param(Params._dummy(), "kind", "log1p or log", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, kind="log1p"):
        super().__init__()
        self._setDefault(kind="log1p")
        self.setParams(**self._input_kwargs)

    def _transform(self, df):
        return log_transform(df, self.getOrDefault(self.kind))


class DropNullsStage(_Stage):
    cols = Param(Params._dummy(), "cols", "columns checked (empty = all)",
                 typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, cols=None):
        super().__init__()
        self._setDefault(cols=[])
        self.setParams(**self._input_kwargs)

    def _transform(self, df):
        return drop_nulls(df, self.getOrDefault(self.cols) or None)
