"""Supervised scoring: boosted trees (``boost``), and with pyspark.ml logistic curves and isotonic calibration; out-of-fold stacking. Null features get a flag and a value."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import cut
from . import boost


def filled(df: DataFrame, features: list[str], value: float = -1.0) -> tuple[DataFrame, list[str]]:
    """Trees here refuse missing values: a null becomes ``value`` and a flag."""
    out = df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(value)).alias(f"f_{c}") for c in features), *(F.col(c).isNull().cast("double").alias(f"null_{c}") for c in features))
    return out, [*(f"f_{c}" for c in features), *(f"null_{c}" for c in features)]


def fit(df: DataFrame, features: list[str], label: str = "label", kind: str = "gbt", group: str = "qi", **params) -> PipelineModel | boost.Boosted:
    """kind: gbt (which stops early on the queries with group % 10 == 0) or logistic.

    A fit reads df many times, and each job's tasks carry its plan: df should be a stored table (``stored.cut``)."""
    if kind == "gbt":
        return boost.fit(df, features, label, group, **params)[0]
    data, columns = filled(df, features)
    data = data.withColumn(label, F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=columns, outputCol="_features")
    model = LogisticRegression(featuresCol="_features", labelCol=label, **({"regParam": 0.01} | params))
    return Pipeline(stages=[assembler, model]).fit(data)


def predict(model: PipelineModel | boost.Boosted, df: DataFrame, features: list[str], p: str = "p", keep: list[str] | None = None) -> DataFrame:
    """df, or its columns ``keep``, and the probability of a match."""
    if isinstance(model, boost.Boosted):
        return boost.predict([model], df, p, keep=keep)
    scored = model.transform(filled(df, features)[0]).withColumn(p, vector_to_array("probability")[1])
    return scored.select(*(c for c in df.columns if c != p and (keep is None or c in keep)), p)


def out_of_fold(df: DataFrame, features: list[str], fold: str = "fold", n: int = 5, p: str = "p", kind: str = "gbt", keep: list[str] | None = None, **params) -> DataFrame:
    """df, or its columns ``keep``, scored by models that did not see the row's fold. n fits over the same input, which is stored once; n is small and fixed.

    Boosted trees are fitted by the same tasks, which get the rows once."""
    df = cut(df)
    if kind == "gbt":
        return boost.predict(boost.fit(df, features, fold=fold, n=n, **params), df, p, fold, keep)
    parts = [predict(fit(df.where(F.col(fold) != i), features, kind=kind, **params), df.where(F.col(fold) == i), features, p, keep) for i in range(n)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def calibrate(df: DataFrame, p: str = "p", label: str = "label", fold: str = "fold", n: int = 5) -> DataFrame:
    """Isotonic calibration of p, out of fold, as p_cal."""
    out = None
    for i in range(n):
        model = IsotonicRegression(featuresCol=p, labelCol="_y", predictionCol="p_cal").fit(df.where(F.col(fold) != i).withColumn("_y", F.col(label).cast("double")))
        part = model.transform(df.where(F.col(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out


def importances(model: PipelineModel | boost.Boosted, features: list[str]) -> list[tuple[str, float]]:
    """Share of each feature (with its flag), from large to small."""
    x = model.importances if isinstance(model, boost.Boosted) else model.stages[-1].featureImportances.toArray()
    n = len(features)
    return sorted(((c, float(x[i] + x[n + i])) for i, c in enumerate(features)), key=lambda t: (-t[1], t[0]))
