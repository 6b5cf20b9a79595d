"""Tree regressors on lag / mean / calendar features (M1-M3).

By default one MLlib model is fitted on the training rows of all series
(pooled), on request with the series as a categorical feature
(``key_feature``), or one model for each series of a given list
(``per_series``): the caller's list bounds the number of fits. MLlib trees
train distributedly (binned split statistics aggregated across partitions),
so each fit scales with rows, not with one machine. Errors are computed in the
same plan as the predictions (no collect, no positional pairing).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators.features import assemble
from gridcast.functions.transforms import inverse_transform
from gridcast.operators.metrics import regression_metrics
from gridcast.operators.series import select_series
from gridcast.operators.split import split_by_rank, train_test
from gridcast.schema import KEYS
from gridcast.session import ensure_checkpoint_dir

TREE_MODELS = ("decision_tree", "gbt")


def tree_estimator(kind: str, features_col: str = "features", label_col: str = "y",
                   seed: int = 42, **params):
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
    if kind == "decision_tree":
        return DecisionTreeRegressor(featuresCol=features_col, labelCol=label_col,
                                     seed=seed, **params)
    if kind == "gbt":
        return GBTRegressor(featuresCol=features_col, labelCol=label_col, seed=seed, **params)
    raise ValueError(f"unknown tree model {kind!r}; expected one of {TREE_MODELS}")


def fit_tree(train: DataFrame, kind: str = "decision_tree", features_col: str = "features",
             label_col: str = "y", **params):
    return tree_estimator(kind, features_col, label_col, **params).fit(train)


def _with_key_index(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """``key_index``, the series as a category, and the number of series."""
    from pyspark.ml.feature import StringIndexer
    tagged = df.withColumn("_key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    indexer = StringIndexer(inputCol="_key", outputCol="key_index", stringOrderType="alphabetAsc").fit(tagged)
    return indexer.transform(tagged).drop("_key"), len(indexer.labels)


def evaluate_holdout(features: DataFrame, feature_cols: Sequence[str], kind: str = "decision_tree",
                     train_pct: float = 80, log: bool = False, keys: Sequence[str] = KEYS,
                     checkpoint: bool = True, key_feature: bool = False,
                     per_series: Sequence[Mapping[str, object]] | None = None,
                     **params) -> tuple[DataFrame, DataFrame]:
    """Percent-rank split per series, fit on train, predict test.

    Returns (predictions: keys, ds, y, prediction; metrics per series). With
    ``log=True`` the label was log1p-transformed and both y and the
    prediction are mapped back with expm1 before the errors.

    With ``checkpoint`` (default) the assembled feature table is written
    once to the shared checkpoint folder before fitting: the fit's passes
    and the test predictions read it instead of recomputing rollup, grid
    and windows, and a lost executor recomputes from the checkpoint, not
    from the raw table.
    """
    df, cols = split_by_rank(features, train_pct, keys), list(feature_cols)
    if key_feature:
        df, n = _with_key_index(df, keys)
        cols, params = [*cols, "key_index"], {"maxBins": max(32, n), **params}
    df = assemble(df, cols)
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)

    def predicted(rows: DataFrame) -> DataFrame:
        train, test = train_test(rows)
        return fit_tree(train, kind, **params).transform(test).select(*keys, "ds", "y", "prediction")

    parts = [select_series(df, key) for key in per_series] if per_series else [df]
    pred = reduce(DataFrame.unionByName, map(predicted, parts))
    if log:
        pred = inverse_transform(pred, "log1p")
    return pred, regression_metrics(pred, "y", "prediction", by=keys)
