"""Ranking metrics and losses of predictions (topic, prediction, ground_truth), by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, by: Sequence[str], value: Column, name: str, tie: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie)))


def precision_at(df: DataFrame, k: int, by: Sequence[str] = (), tie: str = "topic") -> DataFrame:
    """by, precision: the share of the k first predictions with a positive truth."""
    top = _ranked(df, by, F.round("prediction", 9), "_r", tie).filter(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.avg((F.col("ground_truth") > 0).cast("double")).alias("precision"))


def ndcg_at(df: DataFrame, k: int, by: Sequence[str] = (), tie: str = "topic") -> DataFrame:
    """by, ndcg with relevance log1p(truth), linear gain and discount 1 / log2(rank + 1); 0 without relevance."""
    gained = df.withColumn("_g", F.log1p(F.col("ground_truth").cast("double")))
    both = _ranked(_ranked(gained, by, F.round("prediction", 9), "_p", tie), by, F.col("_g"), "_i", tie)
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("_g") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    summed = both.groupBy(*by).agg(part("_p").alias("_dcg"), part("_i").alias("_ideal"))
    return summed.select(*by, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def signed_error(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction_error", F.round(F.col("prediction") - F.col("ground_truth"), 4))


def losses(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, mse, mae, rmse of the counts, and bce of predictions taken as probabilities."""
    e = F.col("prediction") - F.col("ground_truth")
    q = F.least(F.greatest(F.col("prediction"), F.lit(1e-7)), F.lit(1 - 1e-7))
    hit = (F.col("ground_truth") > 0).cast("double")
    return df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(-(hit * F.log(q) + (1 - hit) * F.log(1 - q))).alias("bce"))
