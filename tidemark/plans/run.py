"""The plans from papers to reports. Each takes and gives DataFrames; main() reads and writes files.

    python -m tidemark.plans.run tag|keywords|itemsets|forecast --input PATH [options]
"""

from __future__ import annotations

import argparse
import dataclasses
import typing
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TREND_MODELS, ForecastConfig, ItemsetConfig, KeywordConfig, TaggerConfig
from ..functions import rules
from ..operators import forecast, hypergraph, itemsets, keywords, metrics, reports, snapshots, tagging, trends
from ..schema import PAPERS_CSV, PAPERS_WITH_KEYWORDS_CSV, PAPERS_WITH_TOPICS_CSV
from ..sinks import writers
from ..sources import papers as sources
from ..storage import cut


def tag(papers: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """papers_with_topics, topic_nodes, topic_paper_incidence, paper_hyperedges and metadata."""
    sources.require_columns(papers, ("paper_id", "title"))
    taxonomy = rules.default_taxonomy() if taxonomy is None else taxonomy
    tagged = cut(tagging.tag_papers(papers, taxonomy))  # read by each result, matched once
    links = tagging.incidence(tagged)
    return {
        "papers_with_topics": tagged,
        "topic_nodes": tagging.topic_nodes(links, list(taxonomy)).orderBy(F.desc("paper_count"), "topic_name"),
        "topic_paper_incidence": links,
        "paper_hyperedges": tagging.hyperedges(tagged),
        "metadata": tagging.hypergraph_stats(tagged, len(taxonomy)),
    }


def extract_keywords(papers: DataFrame, p: KeywordConfig) -> dict[str, DataFrame]:
    """papers_with_keywords, keyword_topic_scores, top_keywords_per_topic, topic_keyword_summary."""
    if p.warns:
        warnings.warn("target_year is not the year after the window", stacklevel=2)
    loaded = cut(sources.load_for_keywords(papers))  # written once: its row_ids are joined by
    weights = keywords.tfidf(loaded, p.min_df, p.max_features, p.ngrams)
    words = cut(keywords.top_keywords(weights, p.top_keywords_per_paper, drop_empty=p.drop_empty_keywords))  # read by each result
    scores = cut(keywords.influence(loaded, words, p))
    with_words = loaded.drop("extracted_keywords", "extracted_keyword_scores").join(keywords.keyword_columns(words), "row_id", "left").withColumn("extracted_keywords", F.coalesce("extracted_keywords", F.array().cast("array<string>")))
    return {
        "papers_with_keywords": with_words,
        "keyword_topic_scores": scores.orderBy("topic", F.desc("influence_score"), "keyword"),
        "top_keywords_per_topic": keywords.top_per_topic(scores, p.top_keywords_per_topic),
        "topic_keyword_summary": keywords.topic_summary(scores).orderBy("topic"),
    }


def mine_itemsets(papers: DataFrame, p: ItemsetConfig) -> dict[str, typing.Any]:
    """metrics, series, residuals, ranking, and the method that ranked."""
    loaded = cut(sources.load_for_itemsets(papers, p.min_year, p.max_year))  # written once: its row_ids are joined by
    tx = cut(itemsets.transactions(loaded, itemsets.df_band(loaded, p.df_min_count, p.df_max_frac)))  # read by each count
    found = cut(itemsets.yearly_metrics(tx, p))
    z = trends.series(found, tx)
    residual = trends.residuals(z, p.baseline, p.window)
    method, ranking = trends.rank_itemsets(z, residual, p)
    return {"metrics": found, "series": z, "residuals": residual, "ranking": ranking, "method": method}


def backtest_itemsets(papers: DataFrame, p: ItemsetConfig) -> DataFrame:
    """precision at top_m and eval_k of the residual forecast for max_year, made without max_year: an itemset is a hit if its
    support rose over its baseline in that year."""
    past = dataclasses.replace(p, max_year=p.max_year - 1, forecast_year=p.max_year)
    before = mine_itemsets(papers, past)
    now = trends.residuals(mine_itemsets(papers, p)["series"], p.baseline, p.window).filter(F.col("year") == p.max_year)
    forecasts = trends.residual_forecast(before["residuals"], p.max_year, p.window)
    joined = forecasts.join(now.select("items", "residual"), "items", "left").select(F.array_join("items", " + ").alias("topic"), F.col("predicted_residual").alias("prediction"), (F.coalesce("residual", F.lit(0.0)) > 0).cast("double").alias("ground_truth"))
    at = lambda k: metrics.precision_at(joined, k).select(F.lit(k).alias("k"), "precision")
    return at(p.top_m).unionByName(at(p.eval_k))


def forecast_topics(papers: DataFrame, p: ForecastConfig, future: bool = False) -> dict[str, typing.Any]:
    """predictions, evaluation, model. future: predict_year may be the year after the last, without truth."""
    loaded = sources.load_for_forecast(papers)
    shots = snapshots.snapshots(loaded)
    samples = snapshots.window_samples(shots, p.window_size, p.target_mode, with_future=future)
    chosen = samples.filter(F.col("target_year") == p.predict_year)
    if chosen.isEmpty():
        raise ValueError("no window of years before predict_year")
    projection = forecast.gather_projection(hypergraph.topic_projection(snapshots.topic_incidence(loaded))) if p.structure == "incidence" else None
    model = forecast.train(samples, p, projection)
    predictions = forecast.predict(model, chosen, projection).orderBy(F.desc("prediction"), "topic")
    ranked = [metrics.precision_at(predictions, 5).select(F.lit("precision_at_5").alias("metric"), F.col("precision").alias("value")), metrics.precision_at(predictions, 10).select(F.lit("precision_at_10").alias("metric"), F.col("precision").alias("value")), metrics.ndcg_at(predictions, 10).select(F.lit("ndcg_at_10").alias("metric"), F.col("ndcg").alias("value"))]
    return {"predictions": predictions, "evaluation": ranked[0].unionByName(ranked[1]).unionByName(ranked[2]), "model": model}


def combined(predictions: DataFrame, scores: DataFrame, ranking: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """Both methods side by side, the topics' keywords, and how the keyword sets meet."""
    told = reports.interpret(predictions, scores, top, top)
    topics = told.select("rank", "topic", "prediction").distinct()
    score = "trend_score" if "trend_score" in ranking.columns else "predicted_residual"
    by_residual = Window.orderBy(F.desc(F.round("predicted_residual", 9)), "size", "items")  # a report's rows
    numbered = ranking if "rank" in ranking.columns else ranking.withColumn("rank", F.row_number().over(by_residual))
    sets = reports.keyword_sets(told, ranking.select(F.explode("items").alias("keyword")))
    return {"interpretation": told, "comparison": reports.compare_methods(topics, numbered.withColumn("score", F.col(score))), "keyword_sets": sets, "overlap": reports.overlap_counts(sets)}


# ---- command line


def _options(parser: argparse.ArgumentParser, config: type) -> None:
    for f in dataclasses.fields(config):
        many = "tuple" in str(f.type)
        kind = {"int": int, "float": float}.get(str(f.type), str)
        name = "--" + f.name.replace("_", "-")
        if str(f.type) == "bool":
            parser.add_argument(name, action="store_true", default=f.default)
        elif f.default is dataclasses.MISSING:
            parser.add_argument(name, type=kind, required=True)
        elif many:
            parser.add_argument(name, type=lambda s, d=f.default: tuple(type(d[0])(x) for x in s.split(",")), default=f.default)
        else:
            parser.add_argument(name, type=kind, default=f.default)


PLANS = {"tag": (TaggerConfig, PAPERS_CSV), "keywords": (KeywordConfig, PAPERS_WITH_TOPICS_CSV), "itemsets": (ItemsetConfig, PAPERS_WITH_KEYWORDS_CSV), "forecast": (ForecastConfig, PAPERS_WITH_TOPICS_CSV)}


def parse(argv: list[str] | None = None) -> tuple[str, str, str | None, typing.Any]:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="plan", required=True)
    for name, (config, _) in PLANS.items():
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--taxonomy", help="JSON file of pattern lists by topic") if name == "tag" else None
        _options(p, config)
        p.set_defaults(trend_models=TREND_MODELS) if name == "itemsets" else None
    args = vars(parser.parse_args(argv))
    plan, path, taxonomy = args.pop("plan"), args.pop("input"), args.pop("taxonomy", None)
    return plan, path, taxonomy, PLANS[plan][0](**args)


def main(argv: list[str] | None = None) -> None:
    plan, path, taxonomy, p = parse(argv)
    spark = SparkSession.builder.appName(f"tidemark {plan}").getOrCreate()
    papers = sources.read_parquet(spark, path) if path.endswith(".parquet") else sources.read_csv(spark, path, PLANS[plan][1])
    if plan == "tag":
        found = tag(papers, rules.taxonomy_from_json(writers.read_text(spark, taxonomy)) if taxonomy else None)
        facts = found.pop("metadata").first().asDict()
        for name, df in found.items():
            writers.write_csv(df, f"{p.outdir}/{name}.csv")
        writers.write_json_lines(found["paper_hyperedges"], f"{p.outdir}/hyperedges.json")
        nodes = writers.records(found["topic_nodes"].orderBy("topic_name"))  # a row for each topic of the taxonomy
        writers.write_json(spark, f"{p.outdir}/hypergraph.json", {"nodes": nodes, "hyperedges": "hyperedges.json", "metadata": facts}, ascii_only=False)
        writers.write_text(spark, f"{p.outdir}/summary.txt", writers.summary("Topic hypergraph", facts, writers.records(found["topic_nodes"], p.top), ("topic_name", "paper_count")))
    elif plan == "keywords":
        found = extract_keywords(papers, p)
        for name, df in found.items():
            writers.write_csv(df, f"{p.outdir}/{name}.csv")
        writers.write_json(spark, f"{p.outdir}/run_config.json", dataclasses.asdict(p))
        facts = spark.createDataFrame([(writers.summary("Keywords by topic", dataclasses.asdict(p), [], ()).rstrip("\n"),)], "line string").coalesce(1)
        facts.union(reports.keyword_lines(found["top_keywords_per_topic"])).write.mode("overwrite").text(f"{p.outdir}/summary.txt")  # parts in order, all topics
    elif plan == "itemsets":
        found = mine_itemsets(papers, p)
        rows = writers.records(found["ranking"], p.top_m)
        sizes = {r["size"]: r["count"] for r in found["metrics"].select("items", "size").distinct().groupBy("size").count().collect()}  # two rows
        facts = {"method": found["method"], "forecast_year": p.forecast_year, "baseline": p.baseline, "min_lift": p.min_lift, "num_pairs": sizes.get(2, 0), "num_triples": sizes.get(3, 0), "total_itemsets": sum(sizes.values())}
        writers.write_parquet(found["residuals"], f"{p.outdir}/residuals.parquet")
        writers.write_json(spark, f"{p.outdir}/itemsets_predictions.json", {"metadata": facts, "itemsets": rows, "top_trending_itemsets": reports.itemset_entries(rows, found["method"])})
        writers.write_text(spark, f"{p.outdir}/itemsets_summary.txt", writers.summary("Itemsets", facts, rows, ("items", "trend_score" if found["method"] == "trend" else "predicted_residual")))
    else:
        last = sources.load_for_forecast(papers).agg(F.max("year")).first()[0]
        found = forecast_topics(papers, p, future=last is not None and p.predict_year > last)  # a year without data has no truth
        facts = {r["metric"]: r["value"] for r in found["evaluation"].collect()}  # three rows
        writers.write_csv(found["predictions"], f"{p.outdir}/predictions_for_target_year.csv")
        writers.write_csv(spark.createDataFrame(found["model"].history, "train_loss double, val_loss double"), f"{p.outdir}/training_history.csv")
        writers.write_json(spark, f"{p.outdir}/run_summary.json", facts | {"target_year": p.predict_year})
        writers.write_text(spark, f"{p.outdir}/model.json", found["model"].to_json())
        top = writers.records(found["predictions"], 10)
        writers.write_text(spark, f"{p.outdir}/summary.txt", writers.summary("Topic forecast", facts, top, ("topic", "prediction", "ground_truth")))
        writers.write_text(spark, f"{p.outdir}/report.html", writers.html_report("Topic forecast", facts, top))


if __name__ == "__main__":
    main()
