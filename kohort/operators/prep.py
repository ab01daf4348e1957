"""Preprocessing estimators on exact statistics. A fitted model is one projection of literals.

Learned values live in params, so the models save, load and stream like the built-in ones.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from kohort import fixed_values as fv
from kohort.functions import scalars as S
from kohort.operators.impute import fitted_medians
from kohort.operators.quantiles import fitted_quantiles


def corrected_skewness(col: str) -> Column:
    """Bias-corrected sample skewness (the built-in one is the population form); 0 when constant, NULL below 3 rows."""
    n = F.count(col).cast("double")
    raw = F.skewness(col)
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.when(F.min(col) == F.max(col), F.lit(0.0)).otherwise(raw * factor))


class _Columns(Params):
    cols = Param(Params._dummy(), "cols", "columns to work on", TypeConverters.toListString)


class _Learner(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    pass


class _Fitted(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    def _values(self, param) -> dict[str, float]:
        return dict(zip(self.getOrDefault("cols"), self.getOrDefault(param)))

    def _each(self, df: DataFrame, expr) -> DataFrame:
        return df.withColumns({c: expr(c) for c in self.getOrDefault("cols")})


class MedianImputer(_Learner):
    @keyword_only
    def __init__(self, *, cols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("cols")
        medians = fitted_medians(df, cols)
        if empty := [c for c in cols if medians.get(c) is None]:
            raise ValueError(f"Columns without a single value have no median: {empty}")
        return MedianImputerModel(cols=cols, medians=[medians[c] for c in cols])


class MedianImputerModel(_Fitted):
    medians = Param(Params._dummy(), "medians", "learned medians", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, cols=None, medians=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        m = self._values("medians")
        return self._each(df, lambda c: F.coalesce(F.col(c).cast("double"), F.lit(m[c])))


class Winsorizer(_Learner):
    """Clips to quantile bounds learned by linear interpolation."""

    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, cols=None, lower=0.01, upper=0.99):
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("cols")
        lo, hi = self.getOrDefault("lower"), self.getOrDefault("upper")
        q = fitted_quantiles(df, cols, [lo, hi])
        return WinsorizerModel(cols=cols, lows=[q[(c, lo)] for c in cols], highs=[q[(c, hi)] for c in cols])


class WinsorizerModel(_Fitted):
    lows = Param(Params._dummy(), "lows", "learned lower bounds", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "learned upper bounds", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, cols=None, lows=None, highs=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        lo, hi = self._values("lows"), self._values("highs")
        return self._each(df, lambda c: S.clip(F.col(c), lo[c], hi[c]))


class SkewCorrector(_Learner):
    """log1p on non-negative columns whose corrected skewness exceeds the threshold."""

    threshold = Param(Params._dummy(), "threshold", "skewness limit", TypeConverters.toFloat)
    signed = Param(Params._dummy(), "signed", "only positive skewness counts", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, cols=None, threshold=0.75, signed=False):
        super().__init__()
        self._setDefault(threshold=0.75, signed=False)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("cols")
        row = df.agg(
            *[F.struct(corrected_skewness(c).alias("skew"), F.min(c).alias("low")).alias(f"c{i}") for i, c in enumerate(cols)]
        ).first()
        limit, signed = self.getOrDefault("threshold"), self.getOrDefault("signed")

        def skewed(v):
            return v["skew"] is not None and (v["skew"] if signed else abs(v["skew"])) > limit and v["low"] >= 0

        return SkewCorrectorModel(cols=cols, logged=[c for i, c in enumerate(cols) if skewed(row[f"c{i}"])])


class SkewCorrectorModel(_Fitted):
    logged = Param(Params._dummy(), "logged", "columns to transform", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, cols=None, logged=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        logged = self.getOrDefault("logged")
        return df.withColumns({c: S.log1p_floor(F.col(c)) for c in logged}) if logged else df


class PopulationScaler(_Learner):
    """Mean 0 and population standard deviation 1; a constant column is only centred."""

    @keyword_only
    def __init__(self, *, cols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("cols")
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        return LinearScalerModel(
            cols=cols,
            centres=[row[f"m{i}"] for i in range(len(cols))],
            spreads=[row[f"s{i}"] or 1.0 for i in range(len(cols))],
        )


class LinearScalerModel(_Fitted):
    centres = Param(Params._dummy(), "centres", "learned centres", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "learned spreads", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, cols=None, centres=None, spreads=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        m, s = self._values("centres"), self._values("spreads")
        return self._each(df, lambda c: (F.col(c) - F.lit(m[c])) / F.lit(s[c]))


class RobustPrep(_Learner):
    """Floor at 0, log1p, clip to the 1st/99th percentile, then (x - median) / IQR."""

    @keyword_only
    def __init__(self, *, cols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getOrDefault("cols")
        logged = df.select(*[S.log1p_floor(F.col(c).cast("double")).alias(c) for c in cols])
        q = fitted_quantiles(logged, cols, [0.01, 0.25, 0.5, 0.75, 0.99])
        lows, highs = [q[(c, 0.01)] for c in cols], [q[(c, 0.99)] for c in cols]
        # clipping outside the quartiles moves neither them nor the median, except where interpolated ranks of a
        # short column reach the bounds; clipping the learned values covers that as well
        bound = lambda i, v: min(max(v, lows[i]), highs[i])
        centre = [bound(i, q[(c, 0.5)]) for i, c in enumerate(cols)]
        spread = [bound(i, q[(c, 0.75)]) - bound(i, q[(c, 0.25)]) for i, c in enumerate(cols)]
        return RobustPrepModel(cols=cols, lows=lows, highs=highs, centres=centre, spreads=[s or 1.0 for s in spread])


class RobustPrepModel(_Fitted):
    lows = Param(Params._dummy(), "lows", "learned lower bounds", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "learned upper bounds", TypeConverters.toListFloat)
    centres = Param(Params._dummy(), "centres", "learned medians", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "learned interquartile ranges", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, cols=None, lows=None, highs=None, centres=None, spreads=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        lo, hi = self._values("lows"), self._values("highs")
        m, s = self._values("centres"), self._values("spreads")
        return self._each(
            df, lambda c: (S.clip(S.log1p_floor(F.col(c).cast("double")), lo[c], hi[c]) - F.lit(m[c])) / F.lit(s[c])
        )


def customer_prep(cols: list[str], rules: dict = fv.RULES) -> Pipeline:
    """Impute, winsorise, de-skew, scale, in that order."""
    return Pipeline(
        stages=[
            MedianImputer(cols=cols),
            Winsorizer(cols=cols, lower=rules["winsor_lower"], upper=rules["winsor_upper"]),
            SkewCorrector(cols=cols, threshold=rules["skew_threshold"]),
            PopulationScaler(cols=cols),
        ]
    )


def skewness_report(before: DataFrame, fitted: PipelineModel, cols: list[str]) -> DataFrame:
    """(feature, skew_before, skew_after, log_transformed); the last stage (scaling) is left out."""
    after = before.select(*cols)
    logged: list[str] = []
    for stage in fitted.stages[:-1]:
        after = stage.transform(after)
        if isinstance(stage, SkewCorrectorModel):
            logged = stage.getOrDefault("logged")
    return skew_table(before, after, cols, logged)


def skew_table(before: DataFrame, after: DataFrame, cols: list[str], logged: list[str]) -> DataFrame:
    def one(df, name):
        wide = df.agg(*[F.bround(corrected_skewness(c), 2).alias(c) for c in cols])
        return wide.unpivot([], cols, "feature", name)

    return (
        one(before, "skew_before")
        .join(one(after, "skew_after"), "feature")
        .withColumn("log_transformed", F.col("feature").isin(*logged) if logged else F.lit(False))
    )
