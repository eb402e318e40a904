"""Text functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions import text as X


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("fairness", "fairnes"), ("query processing", "query optimization"), ("support vector machines", "support vector machine"), ("deep rl", "deepreinforcement learning"),
        ("icml", ""), ("attention-based networks", "attention network"), ("knowledge-based", "knowledge-based"), ("large language models", "llm model"),
        ("text-to-image diffusion", "diffusion"), ("convolutional neural networks", "convolutional neural network"), ("", ""), ("data", ""),
    ],
)
def test_normalize_keyword(spark, given, want):
    assert one(spark, given, X.normalize_keyword) == want


def test_text_forms(spark):
    assert one(spark, "Explainable / Fair / Causal AI", X.slugify) == "explainable_fair_causal_ai"
    assert one(spark, "R&D/AI_Pre-Trained", X.normalize_for_tagging) == "r and d ai pre trained"
    assert one(spark, "R&D/AI_Pre-Trained é", X.normalize_for_keywords) == "r d ai pre-trained"
    assert one(spark, None, X.safe_text) == ""


@pytest.mark.parametrize(("cell", "want"), [('["A"," B ",""]', ["A", "B"]), ("A|B", ["A", "B"]), ("A; B", ["A", "B"]), ("A", ["A"]), ("  ", []), (None, []), ("[bad", ["[bad"])])
def test_parse_topics(spark, cell, want):
    assert one(spark, cell, X.parse_topics) == want


@pytest.mark.parametrize(("cell", "want"), [('["a, b","c"]', ["a, b", "c"]), ("a|b", []), ("3", []), (None, [])])
def test_parse_keywords(spark, cell, want):
    assert one(spark, cell, X.parse_keywords) == want


@pytest.mark.parametrize(("cell", "want"), [("2015.0", 2015), ("2016.7", 2016), ("NA", None), ("x", None), ("nan", None), (None, None)])
def test_whole_year(spark, cell, want):
    assert one(spark, cell, X.whole_year) == want


def test_citations(spark):
    assert [one(spark, v, X.citations) for v in ("3", "x", "nan", None)] == [3.0, 0.0, 0.0, 0.0]
    assert one(spark, -5.0, X.citation_weight, "double") == 1.0


def test_year_weight(spark):
    rows = spark.createDataFrame([(2020,), (2022,), (2024,)], "y int").select(X.year_weight(F.col("y"), 2020, 2024).alias("w")).collect()
    assert [r["w"] for r in rows] == [1.0, 1.5, 2.0]
    assert one(spark, 2020, lambda c: X.year_weight(c, 2020, 2020), "int") == 1.0


def test_ngrams_bridge_removed_words(spark):
    words = one(spark, "graph of a the network-flow x cut", lambda c: X.tokens(c, ["of", "the"]))
    assert words == ["graph", "network-flow", "cut"]
    grams = spark.createDataFrame([(words,)], "w array<string>").select(X.ngrams(F.col("w"), 1, 3).alias("g")).first()["g"]
    assert grams == ["graph", "network-flow", "cut", "graph network-flow", "network-flow cut", "graph network-flow cut"]


@pytest.mark.parametrize(("phrase", "want"), [("graph cut", True), ("", False), ("graph x", False), ("organization", False), ("oracle", False), ("2015", False), ("model", False), ("h264 x264", False), ("graph model", False), ("deep graph cut", True)])
def test_valid_phrase(spark, phrase, want):
    assert one(spark, phrase, X.valid_phrase) is want


def test_closure_is_idempotent():
    first = rules.closure(rules.PARENTS)
    again: dict = {}
    for c, p in first:
        again.setdefault(c, []).append(p)
    assert rules.closure(again) == first
    assert len(rules.default_taxonomy()) == 25 and len(rules.stopwords()) > 200
