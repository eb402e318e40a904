"""Reports that join the results of the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .keywords import top_per_topic


def interpret(predictions: DataFrame, scores: DataFrame, topics: int = 5, keywords: int = 5) -> DataFrame:
    """rank, topic, prediction, ground_truth, prediction_error, keyword_rank, keyword, influence_score, ...: the
    likeliest topics with the keywords that speak for them."""
    top = predictions.orderBy(F.desc(F.round("prediction", 9)), "topic").limit(topics)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("prediction", 9)), "topic")))  # `topics` rows
    words = top_per_topic(scores, keywords).withColumnRenamed("rank", "keyword_rank")
    columns = ["keyword", "influence_score", "raw_strength", "topic_specificity", "continuity", "trend_ratio", F.col("topic_window_papers").alias("window_papers"), F.col("topic_target_papers").alias("target_papers")]
    error = F.round(F.col("prediction") - F.col("ground_truth"), 4).alias("prediction_error")
    return ranked.join(words, "topic").select("rank", "topic", "prediction", "ground_truth", error, "keyword_rank", *columns)


def nested_interpretation(rows: DataFrame) -> DataFrame:
    """A record for each topic with its keywords in a list."""
    words = F.struct(*[c for c in rows.columns if c not in ("rank", "topic", "prediction", "ground_truth", "prediction_error")])
    return rows.groupBy("rank", "topic", "prediction", "ground_truth", "prediction_error").agg(F.sort_array(F.collect_list(words)).alias("keywords"))


def keyword_sets(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """keyword, part: in both, or in the first or the second alone."""
    a, b = ours.select("keyword").distinct(), theirs.select("keyword").distinct()
    tagged = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "keyword", "full_outer")
    return tagged.select("keyword", F.when(F.col("y").isNull(), "topic_only").when(F.col("x").isNull(), "itemset_only").otherwise("both").alias("part"))


def overlap_counts(sets: DataFrame) -> DataFrame:
    n = lambda part: F.sum((F.col("part") == part).cast("long"))
    return sets.agg(*[F.coalesce(n(p), F.lit(0)).cast("long").alias(c) for p, c in (("both", "intersection_count"), ("topic_only", "topic_only_count"), ("itemset_only", "itemset_only_count"))], F.count("*").alias("total_unique_keywords"))


def compare_methods(topics: DataFrame, itemsets: DataFrame) -> DataFrame:
    """rank with the topic and the itemset of that rank, side by side."""
    return topics.select("rank", "topic", "prediction").join(itemsets.select("rank", F.array_join("items", " + ").alias("itemset"), "score"), "rank", "full_outer")


# Names in the itemset document, by column of a ranking.
TREND_NAMES = {"trend_score": "trend_score", "exp_k": "exp_growth_rate_k", "logistic_k": "logistic_growth_rate_k", "linear_slope": "linear_slope", "model_fit": "best_fit_model"}
RESIDUAL_NAMES = {"predicted_residual": "predicted_residual"}


def itemset_entries(rows: list[dict], method: str) -> list[dict]:
    """The document's entries of a ranking by "trend" or "residual", in its order; numbers to six digits."""
    names = TREND_NAMES if method == "trend" else RESIDUAL_NAMES
    told = lambda v: round(v, 6) if isinstance(v, float) else v
    return [{"rank": i, "itemset": {"keywords": r["items"], "size": r["size"]}} | {name: told(r[c]) for c, name in names.items()} for i, r in enumerate(rows, 1)]


def mismatches(papers: DataFrame, keywords: DataFrame, indicators: dict[str, list[str]] | None = None) -> DataFrame:
    """row_id, suggested_addition, matching_keywords: keywords that point to a topic which the paper lacks."""
    pairs = [(k, t) for t, ks in (rules.INDICATORS if indicators is None else indicators).items() for k in ks]
    table = papers.sparkSession.createDataFrame(pairs, "keyword string, suggested_addition string")
    hits = keywords.select("row_id", "keyword").distinct().join(F.broadcast(table), "keyword")  # a parameter: a row for each indicator
    lacking = hits.join(papers.select("row_id", "topics"), "row_id").filter(~F.array_contains("topics", F.col("suggested_addition")))
    return lacking.groupBy("row_id", "suggested_addition").agg(F.sort_array(F.collect_set("keyword")).alias("matching_keywords"))


def corpus_profile(papers: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """section, key, n: papers, citation edges and papers by year."""
    total = papers.agg(F.lit("nodes").alias("section"), F.lit("all").alias("key"), F.count("*").alias("n"))
    by_year = papers.groupBy("year").agg(F.count("*").alias("n")).select(F.lit("year").alias("section"), F.col("year").cast("string").alias("key"), "n")
    out = total.unionByName(by_year)
    if edges is not None:
        out = out.unionByName(edges.agg(F.lit("edges").alias("section"), F.lit("all").alias("key"), F.count("*").alias("n")))
    return out


def citation_degrees(edges: DataFrame) -> DataFrame:
    """node, cites, cited of directed edges (src, dst)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("cites"), F.sum("i").alias("cited"))


def keyword_lines(top: DataFrame) -> DataFrame:
    """line: every topic with its papers, and below it its keywords with their scores; top is top_per_topic's table. In order."""
    papers = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("string")
    heads = top.groupBy("topic").agg(F.concat(F.lit("\n"), F.col("topic"), F.lit(" | window papers="), papers("topic_window_papers"), F.lit(" | target papers="), papers("topic_target_papers")).alias("line")).select("topic", F.lit(0).alias("rank"), "line")
    scores = F.format_string(" - %s: influence=%.3f, strength=%.3f, specificity=%.3f, continuity=%.3f, trend=%.3f", "keyword", "influence_score", "raw_strength", "topic_specificity", "continuity", "trend_ratio")
    return heads.unionByName(top.select("topic", "rank", scores.alias("line"))).orderBy("topic", "rank").select("line")
