"""Files: CSV with quotes and null tokens, sinks, the command line, and streams against batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.plans import run
from tidemark.sinks import writers
from tidemark.sources import papers as S
from tidemark.streaming import counts

CSV = '''paper_id,title,year,citation_count,fields_of_study,assigned_topics,extracted_keywords
1,"A ""big"" graph, neural network",2015.0,3,Computer Science,"[""A"", ""B""]","[""a, b"", ""c""]"
2,"two
lines",2016.7,NA,Math|Computer Science,A|B,"[""c"", ""a, b""]"
3,database,NA,1,,A,"[""c""]"
4,cut,2015,x,Math,,[]
'''


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "papers.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_and_loaders(spark, csv_path):
    df = S.read_csv(spark, csv_path)
    rows = {r["paper_id"]: r for r in df.collect()}
    assert rows["1"]["title"] == 'A "big" graph, neural network' and rows["2"]["title"] == "two\nlines" and rows["3"]["year"] is None
    assert {r["paper_id"]: (r["year"], r["items"]) for r in S.load_for_itemsets(df, 2015, 2016).collect()} == {"1": (2015, ["a, b", "c"]), "2": (2016, ["c", "a, b"])}
    loaded = {r["paper_id"]: r for r in S.load_for_keywords(df).collect()}
    assert set(loaded) == {"1", "2"} and loaded["2"]["topics"] == ["A", "B"] and loaded["2"]["citation_count"] == 0
    assert S.load_for_forecast(df.drop("citation_count")).filter("citation_count = 0").count() == 2
    assert sorted(r["paper_id"] for r in S.is_field(df).collect()) == ["1", "2"]
    with pytest.raises(FileNotFoundError):
        S.read_csv(spark, csv_path + ".none")
    with pytest.raises(ValueError, match="year"):
        S.load_for_forecast(df.drop("year"))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ['a"b', "c,d"]), (2, [])], "k int, xs array<string>")
    writers.write_csv(df, str(tmp_path / "x.csv"))
    back = {r["k"]: r["xs"] for r in S.read_csv(spark, str(tmp_path / "x.csv")).collect()}
    assert json.loads(back["1"]) == ['a"b', "c,d"]
    writers.write_parquet(df, str(tmp_path / "x.parquet"))
    assert S.read_parquet(spark, str(tmp_path / "x.parquet")).count() == 2
    writers.write_json(spark, str(tmp_path / "d" / "x.json"), {"a": "é"}, ascii_only=False)
    assert json.loads(writers.read_text(spark, str(tmp_path / "d" / "x.json"))) == {"a": "é"}
    page = writers.html_report("<t>", {"m": "<b>"}, [{"topic": "<x>", "keywords": [{"keyword": "<k>", "influence_score": 1.0}]}])
    assert "<x>" not in page and "&lt;k&gt;" in page


def test_command_line(spark, csv_path, tmp_path):
    out = str(tmp_path / "out")
    run.main(["tag", "--input", csv_path, "--outdir", out])
    assert json.loads(writers.read_text(spark, f"{out}/hypergraph.json"))["metadata"]["num_papers"] == 4
    run.main(["itemsets", "--input", csv_path, "--outdir", out, "--df-min-count", "1", "--df-max-frac", "1", "--min-lift", "0.5", "--min-count", "1"])
    assert json.loads(writers.read_text(spark, f"{out}/itemsets_predictions.json"))["metadata"]["method"] in ("trend", "residual")
    document = json.loads(writers.read_text(spark, f"{out}/itemsets_predictions.json"))
    assert document["metadata"]["total_itemsets"] == document["metadata"]["num_pairs"] + document["metadata"]["num_triples"] > 0
    assert [x["rank"] for x in document["top_trending_itemsets"]] == list(range(1, len(document["itemsets"]) + 1))
    assert all(x["itemset"]["size"] == len(x["itemset"]["keywords"]) for x in document["top_trending_itemsets"])
    run.main(["keywords", "--input", csv_path, "--outdir", out, "--window-start", "2015", "--window-end", "2015", "--target-year", "2016", "--min-df", "1", "--ngrams", "1,2"])
    assert json.loads(writers.read_text(spark, f"{out}/run_config.json"))["target_year"] == 2016


def test_keyword_summary_lists_every_topic(spark, tmp_path):
    lines = ["paper_id,title,abstract,year,citation_count,topics"]
    lines += [f"p{i},graph cut flow,sorting words,{2015 + i % 2},{i},\"['T{i // 2:03d}']\"" for i in range(240)]
    (tmp_path / "many.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    run.main(["keywords", "--input", str(tmp_path / "many.csv"), "--outdir", out, "--window-start", "2015", "--window-end", "2015", "--target-year", "2016", "--min-df", "1", "--ngrams", "1"])
    text = "".join(f.read_text() for f in sorted((tmp_path / "out" / "summary.txt").glob("part-*"))).splitlines()
    topics = [x.split(" | ")[0] for x in text if " | window papers=" in x]
    assert topics == [f"T{k:03d}" for k in range(120)] and "Keywords by topic" in text[0]
    assert sum(x.startswith(" - ") and ": influence=" in x for x in text) >= 120


def test_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = counts.windowed_counts(counts.read_events(spark, str(tmp_path / "events")))
    got = counts.run_available(stream, "event_counts", str(tmp_path / "cp"))
    key = lambda df: sorted((str(r["start"]), r["topic"], r["count"], round(r["total"], 6)) for r in df.collect())
    assert key(got) == key(counts.windowed_counts(events))


def test_stream_without_news_gives_the_former_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "events"))
    run_once = lambda: counts.run_available(counts.windowed_counts(counts.read_events(spark, str(tmp_path / "events"))), "c", str(tmp_path / "cp"))
    first = sorted(map(str, run_once().collect()))
    assert first and sorted(map(str, run_once().collect())) == first


def test_appended_windows_are_the_closed_ones_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = [r[0] for r in events.select(F.date_trunc("day", "ts")).distinct().orderBy(F.date_trunc("day", "ts")).collect()]
    folder, seen = tmp_path / "events", set()
    for k, day in enumerate(days):  # a file a day, in order of time
        events.filter(F.date_trunc("day", "ts") == F.lit(day)).coalesce(1).write.mode("append").parquet(str(folder))
        new = set(folder.glob("part-*")) - seen
        seen |= new
        for f in new:
            os.utime(f, (10**9 + k, 10**9 + k))
    stream = counts.windowed_counts(counts.read_events(spark, str(folder)))
    got = counts.append_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = counts.windowed_counts(events).filter(F.col("start") + F.expr("INTERVAL 1 DAY") <= F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR"))
    key = lambda df: sorted((str(r["start"]), r["topic"], r["count"], round(r["total"], 6)) for r in df.collect())
    assert key(got) and key(got) == key(closed)


def test_itemset_entries_by_method():
    trend = [{"rank": 7, "items": ["a", "b"], "size": 2, "trend_score": 0.12345678, "exp_k": 0.0, "logistic_k": 0.0, "linear_slope": 0.2469, "model_fit": "none", "linear_r2": 1.0}]
    assert reports.itemset_entries(trend, "trend") == [{"rank": 1, "itemset": {"keywords": ["a", "b"], "size": 2}, "trend_score": 0.123457, "exp_growth_rate_k": 0.0, "logistic_growth_rate_k": 0.0, "linear_slope": 0.2469, "best_fit_model": "none"}]
    assert reports.itemset_entries([{"items": ["c", "d", "e"], "size": 3, "predicted_residual": 0.5}], "residual") == [{"rank": 1, "itemset": {"keywords": ["c", "d", "e"], "size": 3}, "predicted_residual": 0.5}]
    assert reports.itemset_entries([], "trend") == []
