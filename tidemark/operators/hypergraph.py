"""Hypergraph convolution as message passing over the incidence table: two joins, two sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(year, topic, dv) and (year, row_id, de) of distinct incidences."""
    once = links.select("year", "topic", "row_id").distinct()
    return once.groupBy("year", "topic").agg(F.count("*").alias("dv")), once.groupBy("year", "row_id").agg(F.count("*").alias("de"))


def projected(features: DataFrame, theta: Sequence[Sequence[float]], bias: Sequence[float]) -> DataFrame:
    """year, topic, k, x: features f_log_prev, f_growth, f_const times theta plus bias, in long form."""
    names = ("f_log_prev", "f_growth", "f_const")
    columns = [sum((F.col(n) * float(theta[i][k]) for i, n in enumerate(names)), F.lit(float(bias[k]))) for k in range(len(bias))]
    return features.select("year", "topic", F.posexplode(F.array(*columns)).alias("k", "x"))


def convolve(x: DataFrame, links: DataFrame) -> DataFrame:
    """year, topic, k, y = Dv^-1/2 H De^-1 H' Dv^-1/2 x, year by year; degrees are 1 at least. Years without
    papers pass through."""
    once = links.select("year", "topic", "row_id").distinct()
    dv, de = degrees(links)
    scaled = x.join(dv, ["year", "topic"], "left").withColumn("s", 1 / F.sqrt(F.greatest(F.coalesce("dv", F.lit(0)), F.lit(1)).cast("double")))
    edges = once.join(scaled.select("year", "topic", "k", (F.col("x") * F.col("s")).alias("m")), ["year", "topic"]).groupBy("year", "row_id", "k").agg(F.sum("m").alias("m"))
    weighed = edges.join(de, ["year", "row_id"]).select("year", "row_id", "k", (F.col("m") / F.greatest("de", F.lit(1))).alias("m"))
    back = once.join(weighed, ["year", "row_id"]).groupBy("year", "topic", "k").agg(F.sum("m").alias("m"))
    joined = scaled.join(back, ["year", "topic", "k"], "left").join(once.select("year").distinct().withColumn("_some", F.lit(True)), "year", "left")
    return joined.select("year", "topic", "k", F.when(F.col("_some"), F.coalesce("m", F.lit(0.0)) * F.col("s")).otherwise(F.col("x")).alias("y"))


def topic_projection(links: DataFrame) -> DataFrame:
    """year, topic, other, a: the entries of Dv^-1/2 H De^-1 H' Dv^-1/2, by pairs of topics within each paper."""
    dv, de = degrees(links)
    held = links.select("year", "topic", "row_id").distinct().join(de, ["year", "row_id"]).groupBy("year", "row_id", "de").agg(F.collect_list("topic").alias("ts"))
    pairs = held.select("year", "de", F.explode("ts").alias("topic"), "ts").select("year", "topic", F.explode("ts").alias("other"), (1 / F.col("de")).alias("w"))
    summed = pairs.groupBy("year", "topic", "other").agg(F.sum("w").alias("w"))
    degree = lambda t, d: dv.select("year", F.col("topic").alias(t), F.col("dv").alias(d))
    both = summed.join(degree("topic", "d1"), ["year", "topic"]).join(degree("other", "d2"), ["year", "other"])
    return both.select("year", "topic", "other", (F.col("w") / F.sqrt(F.col("d1").cast("double") * F.col("d2"))).alias("a"))
