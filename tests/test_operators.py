"""Relational operators against hand-computed values and plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.config import ForecastConfig, ItemsetConfig, KeywordConfig
from tidemark.operators import forecast, hypergraph, itemsets, keywords, metrics, reports, snapshots, tagging, trends
from tidemark.plans import run
from tidemark.sources import papers as S


def series(spark, zs, start=2000):
    return spark.createDataFrame([(["a", "b"], 2, start + i, float(z)) for i, z in enumerate(zs)], "items array<string>, size int, year int, z double")


@pytest.mark.parametrize(("baseline", "want"), [("drift", [0, 0, 0.15]), ("ar1", [0, 0, 0.1]), ("mean", [0, 0, 0.05])])
def test_baselines(spark, baseline, want):
    rows = trends.residuals(series(spark, [0, 0.1, 0.3]), baseline, 5).orderBy("year").collect()
    assert [r["z_hat"] for r in rows] == pytest.approx(want)
    assert rows[0]["residual"] == 0


def test_drift_closed_form_is_the_loop(spark):
    random.seed(1)
    zs = [random.random() for _ in range(12)]
    got = [r["z_hat"] for r in trends.residuals(series(spark, zs), "drift", 5).orderBy("year").collect()]
    for t in range(1, 12):
        h = zs[max(0, t - 5) : t]
        steps = [b - a for a, b in itertools.pairwise(h)]
        assert got[t] == pytest.approx(sum(h) / len(h) + (sum(steps) / len(steps) if steps else 0))


def test_residual_forecast_window(spark):
    rows = spark.createDataFrame([(["a", "b"], 2, y, 0.0, float(y - 2020)) for y in range(2020, 2026)], "items array<string>, size int, year int, z double, residual double")
    assert trends.residual_forecast(rows, 2026, 5).first()["predicted_residual"] == pytest.approx(3.0)
    assert trends.residual_forecast(rows, 2050, 5).first()["predicted_residual"] == 0.0


def test_recent_trend(spark):
    assert trends.linear_trend(series(spark, [0.2, 0.9, 0.2])).first()["recent"] is False
    assert trends.linear_trend(series(spark, [0.2, 0.1])).first()["recent"] is True
    assert trends.linear_trend(series(spark, [0, 0, 0])).first()["linear_slope"] == 0


def test_curve_fits():
    import numpy as np

    t = np.arange(8, dtype=float)
    assert trends.fit_curves(0.2 * np.exp(0.3 * t), ("exponential",))[0] == pytest.approx(0.3, abs=1e-4)
    assert trends.fit_curves(0.8 / (1 + np.exp(-1.2 * (t - 4))), ("logistic",))[1] == pytest.approx(1.2, abs=1e-4)
    assert trends.fit_curves(np.zeros(5), ("logistic",)) == (0.0, 0.0, "constant")


def test_command_line_ranks_by_all_models(spark):
    import numpy as np

    t = np.arange(8, dtype=float)
    grown = {"exp": 0.01 * np.exp(0.4 * t), "log": 0.04 / (1 + np.exp(-2.5 * (t - 4))), "line": 0.3 + 0.05 * t, "falls": np.array([0.5, 0.01, 0.01, 0.01, 0.01, 0.01, 0.02, 0.04])}
    z = spark.createDataFrame([([k, "x"], 2, 2000 + i, float(v)) for k, zs in grown.items() for i, v in enumerate(zs)], "items array<string>, size int, year int, z double")
    found = {r["items"][0]: r for r in trends.rank_by_trend(z, run.parse(["itemsets", "--input", "x"])[3]).collect()}
    slopes = {k: np.polyfit(t, zs, 1)[0] for k, zs in grown.items()}
    assert found["exp"]["exp_k"] == pytest.approx(0.4, abs=1e-4) and found["log"]["logistic_k"] == pytest.approx(2.5, abs=1e-4)
    assert all(r["trend_score"] == pytest.approx(0.5 * slopes[k] + 0.25 * r["exp_k"] + 0.25 * r["logistic_k"], abs=1e-9) for k, r in found.items())
    assert found["log"]["rank"] < found["line"]["rank"]
    linear = {r["items"][0]: r for r in trends.rank_by_trend(z, ItemsetConfig(trend_models=("linear",))).collect()}
    assert linear["line"]["rank"] == 1 and "falls" not in linear and linear["log"]["rank"] > linear["exp"]["rank"]


def test_full_ranking_query(spark):
    from tidemark import queries

    rows = {r["itemset"]: r for r in queries.trend_ranking_full(spark, "/root/testdata/sf0.001").collect()}
    fits = {r["itemset"]: r for r in queries.curve_fit_trend(spark, "/root/testdata/sf0.001").collect()}
    assert rows and all(r["trend_score"] == pytest.approx(0.5 * fits[k]["linear_slope"] + 0.25 * fits[k]["exp_k"] + 0.25 * fits[k]["logistic_k"], rel=1e-6, abs=1e-9) for k, r in rows.items())


def test_rank_falls_back_to_residuals(spark):
    z = series(spark, [0.5, 0.4, 0.3])
    method, ranking = trends.rank_itemsets(z, trends.residuals(z), ItemsetConfig())
    assert method == "residual" and ranking.count() == 1


def test_support_uses_doubles(spark):
    c = spark.createDataFrame([(100,), (150,)], "n long").select(itemsets.least_count(F.col("n"), ItemsetConfig(minsup_frac=0.07)).alias("a"), itemsets.least_count(F.col("n"), ItemsetConfig(minsup_frac=0.01)).alias("b")).collect()
    assert c[0]["a"] == 8 and c[1]["b"] == 2


def baskets(spark, seed=3, n=60):
    random.seed(seed)
    data = [(i, 2000 + i % 3, sorted(random.sample("abcdef", random.randint(0, 5)))) for i in range(n)]
    return data, spark.createDataFrame(data, "row_id long, year int, items array<string>")


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_and_triples(spark, parts):
    data, df = baskets(spark)
    p = ItemsetConfig(min_count=2, minsup_frac=0.05, min_lift=0.8)
    tx = df.filter(F.size("items") > 0).repartition(parts)
    pairs = {(r["year"], r["a"], r["b"]): r for r in itemsets.frequent_pairs(tx, p).collect()}
    triples = {(r["year"], r["a"], r["b"], r["c"]): r for r in itemsets.frequent_triples(tx, itemsets.frequent_pairs(tx, p), p).collect()}
    want_pairs, want_triples = {}, {}
    for year in (2000, 2001, 2002):
        sets = [set(x) for _, y, x in data if y == year and x]
        n = len(sets)
        least = max(2, math.ceil(0.05 * n))
        count = lambda *k: sum(set(k) <= s for s in sets)  # noqa: E731, B023
        for a, b in itertools.combinations("abcdef", 2):
            c = count(a, b)
            lift = (c / n) / ((count(a) / n) * (count(b) / n) + 1e-12) if count(a) and count(b) else 0
            if c >= least and lift >= 0.8:
                want_pairs[year, a, b] = lift
        for k in itertools.combinations("abcdef", 3):
            held = [(year, *x) for x in itertools.combinations(k, 2)]
            if count(*k) >= least and all(x in want_pairs for x in held):
                want_triples[(year, *k)] = (count(*k), min(want_pairs[x] for x in held))
    assert {k: pytest.approx(v) for k, v in want_pairs.items()} == {k: r["lift"] for k, r in pairs.items()}
    assert {k: (v[0], pytest.approx(v[1])) for k, v in want_triples.items()} == {k: (r["count"], r["lift_min"]) for k, r in triples.items()}
    assert all(r["count"] <= pairs[k[0], k[1], k[2]]["count"] for k, r in triples.items())


def test_long_transactions_are_refused(spark):
    df = spark.createDataFrame([(1, 2000, [f"i{k:03d}" for k in range(80)])], "row_id long, year int, items array<string>")
    with pytest.raises(Exception, match="80 items"):
        itemsets.frequent_pairs(df, ItemsetConfig(min_lift=0.0)).collect()


def test_long_transactions_are_mined(spark):
    random.seed(5)
    data = [(i, 2000 + i % 2, sorted(random.sample([f"i{k}" for k in range(12)], n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12])]
    tx = spark.createDataFrame(data, "row_id long, year int, items array<string>").filter(F.size("items") > 0)
    short, wide = ItemsetConfig(min_lift=0.0, max_items=3), ItemsetConfig(min_lift=0.0)
    pairs = itemsets.frequent_pairs(tx, short, long_rows=True)
    assert sorted(pairs.collect()) == sorted(itemsets.frequent_pairs(tx, wide).collect())
    assert sorted(itemsets.frequent_triples(tx, pairs, short, long_rows=True).collect()) == sorted(itemsets.frequent_triples(tx, pairs, wide).collect())
    long = spark.createDataFrame([(i, 2000, [f"i{k:03d}" for k in range(80)]) for i in range(2)], "row_id long, year int, items array<string>")
    found = itemsets.yearly_metrics(long.withColumn("items", F.slice("items", 1, 66)), ItemsetConfig(min_lift=0.0))
    assert {r["size"]: r["count"] for r in found.groupBy("size").count().collect()} == {2: math.comb(66, 2), 3: math.comb(66, 3)}


def test_df_band(spark):
    df = spark.createDataFrame([(i, 2000, ["x", "x"] if i < 3 else ["y"]) for i in range(10)], "row_id long, year int, items array<string>")
    assert itemsets.df_band(df, 3, 0.25).count() == 0
    assert [(r["item"], r["df"]) for r in itemsets.df_band(df, 3, 0.5).collect()] == [("x", 3)]


def test_tagging(spark):
    df = spark.createDataFrame([("1", "A large language model and LLMs"), ("2", "knowledge"), ("3", "zzz"), ("4", None)], "paper_id string, title string")
    got = {r["paper_id"]: r for r in tagging.tag_papers(df).collect()}
    assert got["1"]["assigned_topics"] == ["Large Language Models", "Deep Learning", "Machine Learning", "Natural Language Processing"]
    assert got["2"]["primary_topic"] == "Computer Vision" and got["3"]["primary_topic"] == "Machine Learning" and got["4"]["num_topics"] == 1
    found = run.tag(df)
    assert found["topic_nodes"].count() == 25 and found["metadata"].first()["num_incidence_pairs"] == 7
    with pytest.raises(ValueError, match="title"):
        run.tag(df.drop("title"))


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "graph graph cut"), (2, "graph flow"), (3, "")], "row_id long, doc_text string")
    got = {(r["row_id"], r["term"]): r["weight"] for r in keywords.tfidf(docs, 1, 10).collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1
    a, b = (1 + math.log(2)) * idf(2), idf(1)
    assert got[1, "graph"] == pytest.approx(a / math.hypot(a, b)) and got[1, "cut"] == pytest.approx(b / math.hypot(a, b)) and (3, "graph") not in got


@pytest.mark.parametrize(("sizes", "min_df", "most"), [((1, 2, 3), 2, 12), ((2, 3), 2, 9), ((1, 2), 1, 10_000)])
def test_ngram_vocabulary(spark, sizes, min_df, most):
    """The vocabulary of n-grams and its counts against plain Python, with ties at the cut, empty and null texts and a
    word that only one document repeats; and only n-grams that can be in it are counted one by one."""
    random.seed(5)
    texts = [" ".join(random.choices(["graph", "cut", "flow", "tree", "node"], [8, 5, 3, 2, 1], k=random.randint(0, 14))) for _ in range(40)]
    texts += ["odd " * 50, None, ""]
    tf = Counter()
    for i, text in enumerate(texts):
        w = (text or "").split()
        tf.update((i, " ".join(w[k : k + n])) for n in range(min(sizes), max(sizes) + 1) for k in range(len(w) - n + 1))
    df, total = Counter(t for _, t in tf), Counter()
    for (_, t), n in tf.items():
        total[t] += n
    vocabulary = set(sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:most])
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, doc_text string")
    got = keywords.tfidf(docs, min_df, most, sizes, ()).collect()
    assert {(r["row_id"], r["term"]): r["tf"] for r in got} == {k: n for k, n in tf.items() if k[1] in vocabulary}
    words = docs.select("row_id", F.split("doc_text", " ").alias("words"))
    keys, n = keywords.frequent_keys(words.select("row_id", "words", F.posexplode("words").alias("i", "w")), min_df, most, sizes)
    assert n == keys.distinct().count() and (len(vocabulary) <= n < len(df) / 2 or most > len(df))


def test_influence_z_scores(spark):
    papers = spark.createDataFrame([(i, 2000 + i % 3, float(i), ["t", "u"] if i % 2 else ["t"]) for i in range(12)], "row_id long, year int, citation_count double, topics array<string>")
    words = spark.createDataFrame([(i, k, f"w{(i + k) % 4}", 0.5 / k) for i in range(12) for k in (1, 2)], "row_id long, rank int, keyword string, score double")
    rows = keywords.influence(papers, words, KeywordConfig(2000, 2001, 2002)).collect()
    for topic in ("t", "u"):
        z = [r["z_strength"] for r in rows if r["topic"] == topic]
        assert sum(z) == pytest.approx(0, abs=1e-9)
        assert sum(v * v for v in z) / len(z) == pytest.approx(1) or all(v == 0 for v in z)
    # a keyword's global weight counts a paper once, however many topics it has
    once = {r["keyword"]: r["global_window_weight"] for r in rows}
    assert sum(once.values()) < sum(r["window_weight"] for r in rows)


def topics_by_year(spark, counts):
    rows = [(i, y, 1.0, [t]) for i, (y, t) in enumerate((y, t) for (y, t), n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "row_id long, year int, citation_count double, topics array<string>")


def test_windows_are_contiguous(spark):
    papers = topics_by_year(spark, {(y, "t"): 3 for y in (2000, 2001, 2002, 2003, 2004, 2006, 2007)})
    samples = snapshots.window_samples(snapshots.snapshots(papers), 3)
    assert sorted(r["target_year"] for r in samples.collect()) == [2003, 2004]
    future = snapshots.window_samples(snapshots.snapshots(topics_by_year(spark, {(y, "t"): 3 for y in range(2000, 2004)})), 3, with_future=True)
    assert sorted((r["target_year"], r["truth"]) for r in future.filter("truth IS NULL").collect()) == [(2004, None)]


def test_growth(spark):
    rows = snapshots.snapshots(topics_by_year(spark, {(2000, "u"): 1, (2001, "t"): 3})).filter("topic = 't'").orderBy("year").collect()
    assert [r["f_growth"] for r in rows] == pytest.approx([0, math.log(4)]) and rows[1]["cumulative"] == 3


def test_convolution(spark):
    links = spark.createDataFrame([(1, 2000, "t"), (2, 2000, "u")], "row_id long, year int, topic string")
    x = spark.createDataFrame([(2000, "t", 0, 2.0), (2000, "u", 0, 3.0), (2001, "t", 0, 5.0)], "year int, topic string, k int, x double")
    assert {(r["year"], r["topic"]): r["y"] for r in hypergraph.convolve(x, links).collect()} == {(2000, "t"): 2.0, (2000, "u"): 3.0, (2001, "t"): 5.0}
    shared = spark.createDataFrame([(1, 2000, "t"), (1, 2000, "u"), (2, 2000, "t")], "row_id long, year int, topic string")
    a = {(r["topic"], r["other"]): r["a"] for r in hypergraph.topic_projection(shared).collect()}
    assert a["t", "t"] == pytest.approx(0.75) and a["t", "u"] == pytest.approx(0.5 / math.sqrt(2)) == a["u", "t"]
    got = {r["topic"]: r["y"] for r in hypergraph.convolve(x.filter("year = 2000"), shared).collect()}
    assert got["t"] == pytest.approx(a["t", "t"] * 2 + a["t", "u"] * 3)


def test_metrics(spark):
    p = spark.createDataFrame([("a", 3.0, 1.0), ("b", 2.0, 0.0), ("c", 1.0, 1.0)], "topic string, prediction double, ground_truth double")
    assert metrics.precision_at(p, 2).first()["precision"] == 0.5
    assert metrics.ndcg_at(p, 2).first()["ndcg"] == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert metrics.ndcg_at(p.withColumn("ground_truth", F.lit(0.0)), 2).first()["ndcg"] == 0
    assert metrics.losses(p).first()["mae"] == pytest.approx((2 + 2 + 0) / 3)


def test_network_gradients():
    import numpy as np

    p = ForecastConfig(predict_year=2010, hidden_dim=5, dropout=0.0)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(4, 3, 3)), rng.normal(size=4)
    mixer = np.stack([np.eye(4) * 0.5 + 0.1] * 3)
    for mode, m in (("count", None), ("binary", None), ("count", mixer)):
        w = forecast.init_params(p)
        target = (y > 0).astype(float) if mode == "binary" else y
        out, cache = forecast.forward(w, x, m)
        grads = forecast.backward(w, cache, forecast.loss(out, target, mode)[1])
        for k in w:
            at = tuple(0 for _ in w[k].shape)
            e = 1e-6
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += e
            down[k][at] -= e
            num = (forecast.loss(forecast.forward(up, x, m)[0], target, mode)[0] - forecast.loss(forecast.forward(down, x, m)[0], target, mode)[0]) / (2 * e)
            assert grads[k][at] == pytest.approx(num, abs=1e-6), (mode, k)


@pytest.mark.parametrize("structure", ["identity", "incidence"])
def test_forecast_plan(spark, structure):
    papers = topics_by_year(spark, {(y, t): 2 + k * (y - 2000) for y in range(2000, 2010) for k, t in enumerate("abc")}).withColumn("paper_id", F.col("row_id").cast("string"))
    found = run.forecast_topics(papers, ForecastConfig(predict_year=2009, window_size=3, hidden_dim=8, epochs=60, lr=1e-2, structure=structure))
    history = found["model"].history
    assert history[-1][0] < history[0][0]
    scores = {r["metric"]: r["value"] for r in found["evaluation"].collect()}
    assert scores["precision_at_5"] == 1.0 and scores["ndcg_at_10"] > 0.9
    again = forecast.Model.from_json(found["model"].to_json())
    assert again.topics == ["a", "b", "c"] and again.config == found["model"].config


def test_reports(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "keyword string")
    b = spark.createDataFrame([("y",), ("z",)], "keyword string")
    sets = reports.keyword_sets(a, b)
    assert {r["keyword"]: r["part"] for r in sets.collect()} == {"x": "topic_only", "y": "both", "z": "itemset_only"}
    assert reports.overlap_counts(sets).first().asDict() == {"intersection_count": 1, "topic_only_count": 1, "itemset_only_count": 1, "total_unique_keywords": 3}
    papers = spark.createDataFrame([(1, ["Data Mining"]), (2, ["Other"])], "row_id long, topics array<string>")
    words = spark.createDataFrame([(1, "association"), (2, "association"), (2, "iot"), (2, "plain")], "row_id long, keyword string")
    got = {(r["row_id"], r["suggested_addition"]): r["matching_keywords"] for r in reports.mismatches(papers, words).collect()}
    assert got == {(2, "Data Mining"): ["association"], (2, "Computer Networks"): ["iot"]}


def test_configs():
    for bad in (lambda: KeywordConfig(2020, 2019, 2021), lambda: KeywordConfig(2019, 2020, 2020), lambda: ItemsetConfig(baseline="x"), lambda: ForecastConfig(2020, target_mode="x")):
        with pytest.raises(ValueError):
            bad()
    assert KeywordConfig(2010, 2012, 2014).warns
    plan, path, _, p = run.parse(["itemsets", "--input", "x.csv", "--min-lift", "2", "--baseline", "ar1"])
    assert (plan, path, p.min_lift, p.baseline) == ("itemsets", "x.csv", 2.0, "ar1")
    assert run.parse(["keywords", "--input", "x", "--window-start", "1", "--window-end", "2", "--target-year", "3", "--ngrams", "1,2"])[3].ngrams == (1, 2)


def test_text_column_choice(spark):
    df = spark.createDataFrame([("1", "t", "v")], "paper_id string, venue string, title string")
    assert S.choose_text_columns(df) == ["title", "venue"]
    with pytest.raises(ValueError):
        S.choose_topic_column(df)


def test_itemset_plan_backtest_and_combination(spark):
    random.seed(11)
    rows = []
    for year in range(2015, 2024):
        for k in range(40):
            base = ["graph", "cut"] if k < 4 + 2 * (year - 2015) else ["flow", "plan"] if k % 3 else ["sort"]
            rows.append((str(len(rows)), year, float(k), ["T", "U"] if k % 2 else ["T"], base + random.sample(["a1", "b1", "c1"], 1)))
    papers = spark.createDataFrame(rows, "paper_id string, year int, citation_count double, topics array<string>, extracted_keywords array<string>")
    p = ItemsetConfig(min_year=2015, max_year=2023, forecast_year=2024, df_max_frac=0.9, min_lift=1.0)
    found = run.mine_itemsets(papers, p)
    assert found["method"] == "trend" and found["ranking"].first()["items"] == ["cut", "graph"]
    assert {r["k"] for r in run.backtest_itemsets(papers, p).collect()} == {5, 50}
    loaded = S.with_row_id(papers)
    words = loaded.select("row_id", F.posexplode("extracted_keywords").alias("rank", "keyword")).withColumn("score", F.lit(0.5))
    scores = keywords.influence(loaded, words, KeywordConfig(2015, 2022, 2023))
    predictions = spark.createDataFrame([("T", 40.0, 40.0), ("U", 20.0, 21.0)], "topic string, prediction double, ground_truth double")
    both = run.combined(predictions, scores, found["ranking"])
    told = both["interpretation"].collect()
    assert {r["topic"] for r in told} == {"T", "U"} and {r["prediction_error"] for r in told} == {0.0, -1.0}
    assert both["overlap"].first()["total_unique_keywords"] == both["keyword_sets"].count() and both["comparison"].count() == 5
    assert reports.nested_interpretation(both["interpretation"]).count() == 2


def test_combined_numbers_the_residual_ranking(spark):
    """Without trend scores the itemsets are numbered by their residuals, beside the topics of the same rank."""
    predictions = spark.createDataFrame([("x", 2.0, 1.0), ("y", 1.0, 1.0)], "topic string, prediction double, ground_truth double")
    names = "influence_score raw_strength topic_specificity continuity trend_ratio".split()
    scores = spark.createDataFrame([(t, "k" + t, 1.0, 1.0, 1.0, 1.0, 1.0, 3, 2) for t in "xy"], "topic string, keyword string, " + ", ".join(f"{c} double" for c in names) + ", topic_window_papers long, topic_target_papers long")
    ranking = spark.createDataFrame([(["c", "d"], 2, 0.1), (["a", "b"], 2, 0.5)], "items array<string>, size int, predicted_residual double")
    got = run.combined(predictions, scores, ranking)["comparison"].orderBy("rank").collect()
    assert [(r["rank"], r["topic"], r["itemset"]) for r in got] == [(1, "x", "a + b"), (2, "y", "c + d")]
