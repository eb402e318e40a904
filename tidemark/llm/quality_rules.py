"""Operator 1: host-level quality rules, with DataFrame functions only.

Each document gets its rule failures; they are summed by host (pre-aggregated before the
shuffle), each host's failure rates are shrunk towards an empirical beta prior fitted to
all hosts, and the host's verdict is joined back to its documents.

Defined results: a null text has no words (and fails the length rule); documents with a
null host form one host of their own; repeated rows are judged row by row and all
returned; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, cut, words_col

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class HostRules:
    """min_words and max_repeat_percent are the base rules of a document. A host falls when the
    shrunk rate of any rule is over max_host_rate. strength bounds the prior's pseudo-count."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 20
    max_dup_line_percent: int = 50
    max_host_rate: float = 0.5
    min_strength: float = 2.0
    max_strength: float = 1000.0


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def document_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Everything stays within the row, so nothing is shuffled. A 5-word window is known by the
    64-bit hash of its words; windows are sorted only in documents that repeat one."""
    text = F.col("text")
    base = docs.select("doc_id", F.col(host).alias("host"), _or_empty(text).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, GAP_CHARS, "") != "")
    split = base.select(
        "doc_id", "host",
        F.length(F.translate("text", GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        words_col(F.col("text")).alias("words"),
        lines.alias("lines"),
    )
    n = F.size("words")
    keys = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(WINDOW)])),
    )
    keyed = split.select(
        "doc_id", "host", "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        keys.alias("keys"),
    )
    # (key, position) in order, in the documents that have some key twice
    ordered = F.when(
        F.size("keys") > F.size(F.array_distinct("keys")),
        F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("at")))),
    )
    rest = ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    sorted_keys = keyed.select(*rest, ordered.alias("o"))
    o = F.col("o")
    repeated = F.filter(o, lambda x, i: F.coalesce(F.get(o, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(o, i + 1)["k"] == x["k"], F.lit(False)))
    starts = F.sort_array(F.transform(repeated, lambda x: x["at"]))
    # words covered by the windows that start at these positions: each adds what the one before left
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n"), (s + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return sorted_keys.select(*rest, starts.alias("starts")).select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failures(rules: HostRules) -> dict[str, Column]:
    """Rule name to whether a document's features fail it; the first two are the base rules."""
    return {
        "short": F.col("n_words") < rules.min_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"),
    }


def host_verdicts(features: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """host, host_docs, host_ok and, by rule, the shrunk failure rate. The prior of each rule
    is the beta distribution with the mean and variance of the hosts' rates."""
    tests = failures(rules)
    hosts = features.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.sum(c.cast("long")).alias(f"f_{k}") for k, c in tests.items()])
    rate = lambda k: F.col(f"f_{k}") / F.col("host_docs")
    prior = hosts.agg(F.struct(*[x for k in tests for x in (F.avg(rate(k)).alias(f"m_{k}"), F.var_pop(rate(k)).alias(f"v_{k}"))]).alias("prior"))
    both = hosts.withColumn("prior", prior.scalar())
    shrunk = {}
    for k in tests:
        m, v = F.col("prior")[f"m_{k}"], F.col("prior")[f"v_{k}"]
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(rules.min_strength)), F.lit(rules.max_strength))).otherwise(rules.max_strength)
        shrunk[k] = (F.col(f"f_{k}") + strength * m) / (F.col("host_docs") + strength)
    rated = both.select("host", "host_docs", *[c.alias(f"rate_{k}") for k, c in shrunk.items()])
    return rated.withColumn("host_ok", F.greatest(*[F.col(f"rate_{k}") for k in tests]) <= rules.max_host_rate)


def judge(docs: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """The features of each document with base_failed, host_ok, the host's rates, and kept."""
    features = cut(document_features(docs, host))  # read twice: for the hosts and for the verdicts
    verdicts = host_verdicts(features, rules).withColumnRenamed("host", "h")
    tests = failures(rules)
    # The hosts are one row each; adaptive execution broadcasts them when their measured size is small.
    joined = features.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return joined.withColumn("base_failed", tests["short"] | tests["repeats"]).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
