"""Yearly topic counts, features and training windows; the hypergraph stays a table of (year, topic, paper)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _by_topic():
    return Window.partitionBy("topic").orderBy("year")


def topic_incidence(papers: DataFrame) -> DataFrame:
    """row_id, year, topic, citation_count: a row for each topic of a paper, repeated ones too."""
    return papers.select("row_id", "year", "citation_count", F.explode("topics").alias("topic"))


def topic_vocabulary(papers: DataFrame) -> DataFrame:
    """topic, topic_index in order of the name, over all years."""
    topics = papers.select(F.explode("topics").alias("topic")).distinct()
    return topics.withColumn("topic_index", F.row_number().over(Window.orderBy("topic")) - 1)  # a row for each topic


def yearly_counts(papers: DataFrame) -> DataFrame:
    """year, topic, count, citation_sum (of log1p) for every observed year and topic."""
    links = topic_incidence(papers)
    counted = links.groupBy("year", "topic").agg(F.count("*").alias("count"), F.sum(F.log1p(F.greatest("citation_count", F.lit(0.0)))).alias("citation_sum"))
    years = counted.agg(F.sort_array(F.collect_set("year")).alias("ys")).scalar()
    grid = counted.select("topic").distinct().select("topic", F.explode(years).alias("year"))
    return grid.join(counted, ["year", "topic"], "left").select("year", "topic", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("citation_sum", F.lit(0.0)).alias("citation_sum"))


def snapshots(papers: DataFrame) -> DataFrame:
    """yearly_counts with prev_count (of the observed year before), cumulative, f_log_prev, f_growth, f_const."""
    counted = yearly_counts(papers).withColumn("prev_count", F.lag("count", 1, 0).over(_by_topic()))
    running = F.sum("count").over(_by_topic().rowsBetween(Window.unboundedPreceding, 0))
    log = lambda c: F.log1p(F.col(c).cast("double"))
    return counted.withColumn("cumulative", running).withColumn("f_log_prev", log("prev_count")).withColumn("f_growth", log("count") - log("prev_count")).withColumn("f_const", F.lit(1.0))


def target(count, mode: str = "count"):
    if mode == "count":
        return F.log1p(count.cast("double"))
    if mode == "binary":
        return (count > 0).cast("double")
    raise ValueError("target_mode is count or binary")


def window_samples(shots: DataFrame, window: int, mode: str = "count", with_future: bool = False) -> DataFrame:
    """target_year, topic, features (array of year, f1, f2, f3), truth, y: `window` calendar years in a row and the
    year after. with_future: also the year after the last one, whose truth is null."""
    past = _by_topic().rowsBetween(-window, -1)
    f = F.struct("year", F.col("f_log_prev").alias("f1"), F.col("f_growth").alias("f2"), F.col("f_const").alias("f3"))
    rows = shots.select("topic", "year", f.alias("f"), F.col("count").alias("truth"))
    if with_future:
        # max and struct alike take the last year's row; its features go into the frame of the next
        last = rows.groupBy("topic").agg((F.max("year") + 1).alias("year")).select("topic", "year", F.lit(None).cast(rows.schema["f"].dataType).alias("f"), F.lit(None).cast("long").alias("truth"))
        rows = rows.unionByName(last)
    seen = rows.withColumn("features", F.collect_list("f").over(past)).filter(F.size("features") == window)
    whole = (F.element_at("features", 1)["year"] == F.col("year") - window) & (F.element_at("features", -1)["year"] == F.col("year") - 1)
    return seen.filter(whole).select(F.col("year").alias("target_year"), "topic", "features", "truth", target(F.col("truth"), mode).alias("y"))


def split(samples: DataFrame, predict_year: int) -> DataFrame:
    """samples with part: train, validation (the last year before predict_year) or predict."""
    last = samples.filter(F.col("target_year") < predict_year).agg(F.max("target_year").alias("m")).scalar()
    part = F.when(F.col("target_year") == predict_year, "predict").when(F.col("target_year") == last, "validation").when(F.col("target_year") < predict_year, "train")
    return samples.withColumn("part", part).filter("part IS NOT NULL")
