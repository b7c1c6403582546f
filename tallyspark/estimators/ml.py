"""Built-in MLlib estimators wrapped to return coefficient or metric tables (ES8, ES16-ES18)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .linear import COEF_SCHEMA


def logit(df: DataFrame, y: str, xs: list[str], name: str = "logit") -> DataFrame:
    """ES8: binomial GLM with logit link; coefficients and standard errors as a coefficient table."""
    d = VectorAssembler(inputCols=xs, outputCol="__f").transform(df.select(y, *xs).dropna())
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__f", labelCol=y,
                                    maxIter=200).fit(d)
    if m.summary.numIterations >= 200:
        raise RuntimeError("the logit model did not converge in 200 iterations")
    se = m.summary.coefficientStandardErrors  # coefficients then intercept
    rows = [(name, "(Intercept)", float(m.intercept), float(se[-1]))]
    rows += [(name, x, float(b), float(s)) for x, b, s in zip(xs, m.coefficients, se[:-1])]
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA)


def pca(df: DataFrame, vec_col: str, k: int, key: str | None = None, n_ratio: int = 30):
    """ES16: PCA on centred vectors; returns (explained-variance table, component scores).

    MLlib's PCA does not centre on transform, so the mean is removed first; each
    component's sign is fixed so its largest absolute loading is positive.
    """
    d = df.select(*([key] if key else []), array_to_vector(F.col(vec_col)).alias("__v"))
    sc = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(d)
    c = sc.transform(d)
    kk = max(k, n_ratio)
    model = PCA(k=kk, inputCol="__c", outputCol="__s").fit(c)
    pcs = model.pc.toArray()
    signs = np.sign(pcs[np.abs(pcs).argmax(axis=0), range(pcs.shape[1])])
    signs[signs == 0] = 1
    ratios = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())][:n_ratio]
    ev = df.sparkSession.createDataFrame(ratios, "component int, explained_variance_ratio double")
    scores = model.transform(c).select(*([key] if key else []), vector_to_array("__s").alias("__a"))
    scores = scores.select(*([key] if key else []),
                           *[(F.col("__a")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
    return ev, scores


#: Rows of a partition that make a level of a tree worth a task of its own.
ROWS_A_TASK = 20_000


def few_partitions(df: DataFrame) -> DataFrame:
    """All rows in as many partitions as their number is worth: a fit of hundreds of trees runs thousands of jobs over the
    same rows, so on small input the tasks' start would be most of its time."""
    wanted = -(-df.count() // ROWS_A_TASK)
    return df.coalesce(max(1, wanted)) if wanted < df.rdd.getNumPartitions() else df


def boosted_trees(df: DataFrame, y: str, xs: list[str], *, n_trees: int = 500, depth: int = 6,
                  rate: float = 0.05, subsample: float = 0.8, colsample: float = 0.8, seed: int = 42):
    """ES17 (and ES18 baseline): in-sample RMSE and R² of boosted trees and of a linear model,
    and the trees' feature importances.  ``subsample`` rows a tree and ``colsample`` of the columns a split."""
    ensure_checkpoint_dir(df.sparkSession)  # hundreds of trees: the fit cuts its lineage there
    d = few_partitions(VectorAssembler(inputCols=xs, outputCol="__f").transform(df.select(y, *xs).dropna())).cache()
    gbt = GBTRegressor(featuresCol="__f", labelCol=y, maxIter=n_trees, maxDepth=depth, stepSize=rate,
                       subsamplingRate=subsample,
                       featureSubsetStrategy=str(colsample) if colsample < 1 else "all", seed=seed).fit(d)
    lin = LinearRegression(featuresCol="__f", labelCol=y).fit(d)
    spark = df.sparkSession

    def metrics(model, label):
        p = model.transform(d)
        my = p.agg(F.avg(y).alias("my")).first()["my"]
        r = p.agg(F.sqrt(F.avg((F.col("prediction") - F.col(y)) ** 2)).alias("rmse"),
                  (1 - F.sum((F.col("prediction") - F.col(y)) ** 2)
                   / F.sum((F.col(y) - F.lit(my)) ** 2)).alias("r2")).first()
        return [(label, "rmse", float(r["rmse"])), (label, "r2", float(r["r2"]))]

    rows = metrics(gbt, "boosted_trees") + metrics(lin, "linear")
    rows += [("boosted_trees", f"importance_{x}", float(v)) for x, v in zip(xs, gbt.featureImportances.toArray())]
    return spark.createDataFrame(rows, "model string, metric string, value double")

