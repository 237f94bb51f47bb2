"""Learned models with their fallbacks."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators import boosting


def feature_values(df: DataFrame, features: list[str]) -> list[Column]:
    """These features; a missing column or value is 0."""
    return [F.coalesce(X.finite(F.col(c).cast("double")), X.double(0)) if c in df.columns else X.double(0) for c in features]


def align_features(df: DataFrame, features: list[str]) -> DataFrame:
    cols = feature_values(df, features)
    out = df.withColumns({f"__v_{i}": c for i, c in enumerate(cols)})
    return VectorAssembler(inputCols=[f"__v_{i}" for i in range(len(features))], outputCol="__features").transform(out).drop(*[f"__v_{i}" for i in range(len(features))])


@dataclass
class Model:
    """A fitted model, or a constant where the data didn't allow one."""

    features: list[str]
    constant: float
    fitted: object = None

    def apply(self, df: DataFrame, into: str) -> DataFrame:
        if self.fitted is None:
            return df.withColumn(into, X.double(self.constant))
        if isinstance(self.fitted, LogisticRegressionModel):  # a plain expression: no vectors, and no model in the tasks
            z = X.double(float(self.fitted.intercept))
            for w, v in zip(self.fitted.coefficients, feature_values(df, self.features)):
                z = z + X.double(float(w)) * v
            return df.withColumn(into, X.double(1) / (X.double(1) + F.exp(-z)))
        return df.withColumn(into, self.fitted.score(feature_values(df, self.features)))

    def save(self, path: str, spark) -> None:
        spark.createDataFrame([(json.dumps({"features": self.features, "constant": self.constant, "fitted": self.fitted is not None, "boosted": self.fitted.dumps() if isinstance(self.fitted, boosting.Boosted) else None}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        if isinstance(self.fitted, LogisticRegressionModel):
            PipelineModel([self.fitted]).write().overwrite().save(f"{path}/model")


def load_model(path: str, spark) -> Model | None:
    """None if there is none; a model that is there and can't be read is an error."""
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if about.get("boosted"):
        return Model(about["features"], about["constant"], boosting.Boosted.loads(about["boosted"]))
    return Model(about["features"], about["constant"], PipelineModel.load(f"{path}/model").stages[0] if about["fitted"] else None)


def fit_logistic(df: DataFrame, features: list[str], label: str, max_iter: int = 500) -> Model:
    """Balanced L2 logistic regression; no rows give 0.5, one class gives its share."""
    n, pos = df.agg(F.count(label), F.coalesce(F.sum(label), F.lit(0))).first()
    if not n or pos in (0, n):
        return Model(features, 0.5 if not n else pos / n)
    weight = F.when(F.col(label) == 1, X.double(n / (2 * pos))).otherwise(X.double(n / (2 * (n - pos))))
    rows = align_features(df, features).withColumn("__w", weight)
    lr = LogisticRegression(featuresCol="__features", labelCol=label, weightCol="__w", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=max_iter, probabilityCol="probability__", rawPredictionCol="rawPrediction__", predictionCol="prediction__")
    return Model(features, pos / n, lr.fit(rows))


def fit_boosted(df: DataFrame, features: list[str], label: str, rounds: int = 300, least: int = 100, growth: boosting.Growth = boosting.Growth()) -> Model:
    """Boosted trees; no finite label gives 0; fewer than ``least``, or no feature, give their mean."""
    rows = df.withColumn(label, X.finite(F.col(label))).where(F.col(label).isNotNull())
    n, mean = rows.agg(F.count("*"), F.avg(label)).first()
    if n < least or not features:
        return Model(features, mean if n else 0.0)
    return Model(features, mean, boosting.fit(rows, feature_values(rows, features), F.col(label), mean, replace(growth, rounds=rounds)))


def predict(df: DataFrame, up: Model | None, ret: Model | None) -> DataFrame:
    """pred_up_prob, pred_ret_mean, pred_ev; absent models mean 0.5 and 0."""
    out = (up or Model([], 0.5)).apply(df, "pred_up_prob")
    out = (ret or Model([], 0.0)).apply(out, "pred_ret_mean")
    return out.withColumn("pred_ev", F.col("pred_up_prob") * F.col("pred_ret_mean"))
