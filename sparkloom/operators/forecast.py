"""Gradient-boosted forecasts on the log of sales."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..functions.metrics import clip0, evaluate, feature_medians, impute
from .backtest import align_to_template, assign_folds, blend, holdout, out_of_fold
from .features import drop_incomplete

LOSSES = {"absolute": "model_a", "squared": "model_b"}
WEIGHTS = [0.6, 0.4]


def fit_gbt(train: DataFrame, cols: list[str], loss: str = "squared", target: str = "sales", rounds: int = 20, depth: int = 5, validation: str | None = None, seed: int = 42) -> PipelineModel:
    """Boosted trees on log1p of the target. ``validation`` names a boolean column whose rows stop the boosting early."""
    gbt = GBTRegressor(featuresCol="features", labelCol="_y", predictionCol=f"_log_{loss}", lossType=loss, maxIter=rounds, maxDepth=depth, stepSize=0.05 if rounds > 50 else 0.2, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=128, seed=seed, cacheNodeIds=True, checkpointInterval=10)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    assembler = VectorAssembler(inputCols=cols, outputCol="features")
    rows = train.withColumn("_y", F.log1p(clip0(F.col(target))))
    return PipelineModel([assembler, gbt.fit(assembler.transform(rows))])


def predict(model: PipelineModel, df: DataFrame, loss: str, name: str) -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, F.expm1(f"_log_{loss}")).drop("features", "rawPrediction", f"_log_{loss}")


def fit_blend(train: DataFrame, score: DataFrame, cols: list[str], **options) -> DataFrame:
    """``score`` with the two models' predictions and their 0.6/0.4 blend, never negative."""
    for loss, name in LOSSES.items():
        score = predict(fit_gbt(train, cols, loss, **options), score, loss, name)
    return score.withColumn("predicted", blend(list(LOSSES.values()), WEIGHTS))


def backtest(df: DataFrame, folds: DataFrame, cols: list[str], n_folds: int = 3, **options) -> DataFrame:
    """Validation rows of all folds with predictions. The loop is over fold numbers; every fit is distributed. Missing folds are empty."""
    dealt = stored(assign_folds(drop_incomplete(df, [*cols, "sales"]), folds))
    parts = []
    for i in range(n_folds):
        fold = dealt.filter(F.col("fold_id") == i)
        train = fold.filter("role = 'train'")
        if train.isEmpty():
            continue
        parts.append(fit_blend(train, fold.filter("role = 'val'"), cols, **options))
    if not parts:  # no fold has a complete row to learn from
        empty = dealt.limit(0).withColumns({c: F.lit(None).cast("double") for c in [*LOSSES.values(), "predicted"]})
        return empty
    return out_of_fold(parts)


def backtest_errors(predictions: DataFrame) -> DataFrame:
    return evaluate(predictions, ["fold_id"])


def forecast(df: DataFrame, test: DataFrame, cols: list[str], days: int = 16, on_missing: str = "median", **options) -> DataFrame:
    """(id, sales) for the test rows: fitted on all complete rows, the last days stopping the boosting; test gaps filled or dropped."""
    full = drop_incomplete(df, [*cols, "sales"])
    marked = holdout(full, days)
    ready = impute(test, feature_medians(full, cols), cols) if on_missing == "median" else drop_incomplete(test, cols)
    return align_to_template(test, fit_blend(marked, ready, cols, validation="is_val", **options), "predicted")


def feature_importance(model: PipelineModel, cols: list[str], n: int = 30) -> DataFrame:
    """(feature, importance) of the ``n`` most important features."""
    from pyspark.sql import SparkSession

    rows = [(c, float(v)) for c, v in zip(cols, model.stages[-1].featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)
