"""TF-IDF keywords, and how strongly each keyword speaks for each topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KeywordConfig
from ..functions import text as X
from ..storage import cut, cut_in_buckets


#: A vocabulary up to this size is sent to all executors.
SMALL_VOCABULARY = 200_000


def term_counts(docs: DataFrame, ngrams: Sequence[int] = (1,), stop: Sequence[str] | None = None) -> DataFrame:
    """row_id, term, tf from doc_text; the sizes of n-grams are the range from the least to the greatest. Texts
    are dealt by row_id once; terms are counted, weighed and ranked where they fall."""
    words = docs.select("row_id", "doc_text").repartition("row_id").select("row_id", X.tokens(F.col("doc_text"), stop).alias("words"))
    # explode_outer: explode would have the planner test the size of the array first, and so make all n-grams twice
    terms = words.select("row_id", F.explode_outer(X.ngrams(F.col("words"), min(ngrams), max(ngrams))).alias("term")).filter("term IS NOT NULL")
    return terms.groupBy("row_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """term, df, total of the terms in min_df documents or more; of these the max_features most frequent."""
    kept = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return kept.orderBy(F.desc("total"), "term").limit(max_features)


def _key(n: int, skip: int = 0) -> Column:
    """The 64-bit hash of the n words of an array `words` that begin `skip` words after place i."""
    return F.xxhash64(F.lit(n), *[F.get("words", F.col("i") + k) for k in range(skip, skip + n)])


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_VOCABULARY else df


def frequent_keys(starts: DataFrame, min_df: int, max_features: int, ngrams: Sequence[int]) -> tuple[DataFrame, int]:
    """key (hashes) of all n-grams that can be among the max_features most frequent of those in min_df documents or
    more, and their number. starts: row_id, words and a row for each place i.

    An n-gram is no more frequent than the shorter ones that it begins and ends with, so sizes are counted one
    after the other, and only n-grams of two kept parts. `least` never exceeds the total of the last term of the
    vocabulary: it is the max_features-th of the totals counted so far, of terms whose documents fall on min_df
    of 64 marks, and so are as many."""
    mark = F.expr("shiftleft(1L, CAST(pmod(xxhash64(7, row_id), 64) AS INT))").alias("mark")
    least, before, counted = max(1, min_df), None, []
    for n in range(1, max(ngrams) + 1):
        found = starts.filter(F.col("i") + n <= F.size("words"))
        if before is None:
            found = found.select(_key(1).alias("key"), mark)
        else:
            found = found.select(_key(n - 1).alias("head"), _key(n - 1, 1).alias("tail"), _key(n).alias("key"), mark)
            size = before.count()
            found = found.join(_few(before.select(F.col("key").alias("head")), size), "head").join(_few(before.select(F.col("key").alias("tail")), size), "tail")
        totals = cut(found.groupBy("key").agg(F.count("*").alias("total"), F.bit_or("mark").alias("marks")).filter(F.col("total") >= least))
        if n >= min(ngrams):
            counted.append(totals)
            sure = [t.filter(F.bit_count("marks") >= min_df).select("total") for t in counted]
            every = sure[0]
            for t in sure[1:]:
                every = every.union(t)
            top = every.orderBy(F.desc("total")).limit(max_features).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
            least = max(least, top["least"]) if top["n"] == max_features and top["n"] else least
        before = totals.filter(F.col("total") >= least)
    keys = counted[0]
    for t in counted[1:]:
        keys = keys.union(t)
    keys = keys.filter(F.col("total") >= least).select("key")
    return keys, keys.count()


def ngram_counts(docs: DataFrame, min_df: int, max_features: int, ngrams: Sequence[int], stop: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The counts row_id, key, tf, and the vocabulary key, term, df, total, where the sizes of n-grams are a range with
    some over 1. Words are found once and written, dealt by row_id; n-grams are counted by 64-bit hashes, and only
    those that can be in the vocabulary (frequent_keys). Two terms of one hash would count as one."""
    words = cut_in_buckets(docs.select("row_id", X.tokens(F.col("doc_text"), stop).alias("words")), "row_id")
    starts = words.select("row_id", "words", F.posexplode("words").alias("i", "w")).drop("w")
    sizes = range(min(ngrams), max(ngrams) + 1)
    keys, size = frequent_keys(starts, min_df, max_features, ngrams)
    here = [F.when(F.col("i") + n <= F.size("words"), _key(n)) for n in sizes]
    counts = starts.select("row_id", F.explode(F.array(*here)).alias("key")).join(_few(keys, size), "key").groupBy("row_id", "key").agg(F.count("*").alias("tf"))
    found = cut(counts.groupBy("key").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.min("row_id").alias("at")).filter(F.col("df") >= min_df))
    # the words of each hash, from one document that holds it
    spots = found.select("at", F.col("key").alias("spot"))
    held = words.join(_few(spots.select("at").distinct(), size), F.col("row_id").eqNullSafe(F.col("at")), "left_semi")
    named = held.select("row_id", "words", F.posexplode("words").alias("i", "w"))
    spelt = [F.struct(key.alias("key"), F.array_join(F.slice("words", F.col("i") + 1, n), " ").alias("term")) for n, key in zip(sizes, here, strict=True)]
    named = named.select("row_id", F.explode(F.array(*spelt)).alias("x")).select("row_id", "x.key", "x.term")
    terms = named.join(_few(spots, size), F.col("row_id").eqNullSafe(F.col("at")) & (F.col("key") == F.col("spot"))).groupBy("key").agg(F.min("term").alias("term"))
    return counts, cut(found.join(terms, "key").select("key", "term", "df", "total").orderBy(F.desc("total"), "term").limit(max_features))


def tfidf(docs: DataFrame, min_df: int = 2, max_features: int = 20_000, ngrams: Sequence[int] = (1,), stop: Sequence[str] | None = None) -> DataFrame:
    """row_id, term, tf, weight: (1 + ln tf)(ln((1 + N) / (1 + df)) + 1) over its Euclidean norm in the document;
    and of each term, found once in the vocabulary: valid, and keyword (its normal form)."""
    if max(ngrams) > 1:
        counts, known = ngram_counts(docs, min_df, max_features, ngrams, stop)
    else:
        counts = term_counts(docs, ngrams, stop)
        known = vocabulary(counts, min_df, max_features).withColumn("key", F.col("term"))
        counts = counts.withColumnRenamed("term", "key")
    n = docs.agg(F.count("*").cast("double").alias("n")).scalar()
    known = known.select("key", "term", "df", X.valid_phrase(F.col("term"), stop).alias("valid"), X.normalize_keyword(F.col("term"), stop).alias("keyword"))
    known = F.broadcast(known) if max_features <= SMALL_VOCABULARY else known  # max_features rows at most
    raw = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + n) / (1 + F.col("df").cast("double"))) + 1)
    weighed = counts.join(known, "key").select("row_id", "term", "tf", "valid", "keyword", raw.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row_id")))
    return weighed.select("row_id", "term", "tf", (F.col("raw") / norm).alias("weight"), "valid", "keyword")


def top_keywords(weights: DataFrame, top_k: int, normalize: bool = True, drop_empty: bool = False) -> DataFrame:
    """row_id, rank, term, keyword, score: the top_k valid terms of each document. Validity and the normal form come
    after the weights, which stay as they are."""
    order = Window.partitionBy("row_id").orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = weights.filter("valid").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    out = ranked.select("row_id", "rank", "term", F.col("keyword" if normalize else "term").alias("keyword"), F.col("weight").alias("score"))
    return out.filter("keyword <> ''") if drop_empty else out


def keyword_columns(keywords: DataFrame) -> DataFrame:
    """row_id, extracted_keywords, extracted_keyword_scores (6 digits), by rank."""
    lists = keywords.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "keyword", "score"))).alias("k"))
    return lists.select("row_id", F.transform("k", lambda x: x["keyword"]).alias("extracted_keywords"), F.transform("k", lambda x: F.round(x["score"], 6)).alias("extracted_keyword_scores"))


def contributions(papers: DataFrame, keywords: DataFrame, p: KeywordConfig) -> DataFrame:
    """row_id, topics, keyword, w (in the window) and t (in the target year)."""
    cited = X.citation_weight(F.col("citation_count"))
    in_window, in_target = F.col("year").between(p.window_start, p.window_end), F.col("year") == p.target_year
    dated = papers.filter(in_window | in_target).select("row_id", "year", "topics", F.when(in_window, X.year_weight(F.col("year"), p.window_start, p.window_end) * cited).otherwise(0.0).alias("w"), F.when(in_target, cited).otherwise(0.0).alias("t"))
    joined = dated.join(keywords.select("row_id", "keyword", "score"), "row_id")
    return joined.select("row_id", "topics", "keyword", (F.col("score") * F.col("w")).alias("w"), (F.col("score") * F.col("t")).alias("t"))


def topic_papers(papers: DataFrame, p: KeywordConfig) -> DataFrame:
    """topic, topic_window_papers, topic_target_papers; a topic that a paper repeats counts each time."""
    rows = papers.select("year", F.explode("topics").alias("topic"))
    in_window, in_target = F.col("year").between(p.window_start, p.window_end), F.col("year") == p.target_year
    return rows.filter(in_window | in_target).groupBy("topic").agg(F.sum(in_window.cast("long")).alias("topic_window_papers"), F.sum(in_target.cast("long")).alias("topic_target_papers"))


def _z(c: str) -> Column:
    """Standard score within the topic; 0 where all values are alike."""
    w = Window.partitionBy("topic")
    spread = F.stddev_pop(c).over(w)
    return F.when(spread < 1e-12, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / spread)


def influence(papers: DataFrame, keywords: DataFrame, p: KeywordConfig) -> DataFrame:
    """The score table: a row for each topic and keyword that meet in the window or the target year."""
    each = contributions(papers, keywords, p)
    # totals of a keyword count a paper once, however many topics it has
    total = each.groupBy("keyword").agg(F.sum("w").alias("global_window_weight"), F.sum("t").alias("global_target_weight"))
    by_topic = each.select(F.explode("topics").alias("topic"), "keyword", "w", "t").groupBy("topic", "keyword").agg(F.sum("w").alias("window_weight"), F.sum("t").alias("target_weight"))
    whole = total.agg(F.sum("global_window_weight")).scalar()
    share = F.col("window_weight") / (F.sum("window_weight").over(Window.partitionBy("topic")) + F.lit(1e-9))
    everywhere = F.col("global_window_weight") / (whole + F.lit(1e-9))
    scored = (
        by_topic.join(total, "keyword")
        .join(topic_papers(papers, p), "topic", "left")
        .withColumn("topic_specificity", F.log((share + 1e-9) / (everywhere + 1e-9)))
        .withColumn("trend_ratio", F.log1p("target_weight") - F.log1p("window_weight"))
        .withColumn("raw_strength", F.log1p("window_weight"))
        .withColumn("continuity", F.log1p("target_weight"))
    )
    z = {"z_strength": "raw_strength", "z_specificity": "topic_specificity", "z_continuity": "continuity", "z_trend": "trend_ratio"}
    scored = scored.withColumns({k: _z(c) for k, c in z.items()})
    score = 0.40 * F.col("z_strength") + 0.30 * F.col("z_specificity") + 0.20 * F.col("z_continuity") + 0.10 * F.col("z_trend")
    return scored.withColumn("influence_score", score)


def top_per_topic(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("influence_score", 6)), "keyword")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def topic_summary(scores: DataFrame, n: int = 15) -> DataFrame:
    """topic, num_window_papers, num_target_papers, top_keywords, top_influence_scores (4 digits)."""
    lists = top_per_topic(scores, n).groupBy("topic").agg(F.max("topic_window_papers").alias("num_window_papers"), F.max("topic_target_papers").alias("num_target_papers"), F.sort_array(F.collect_list(F.struct("rank", "keyword", "influence_score"))).alias("k"))
    return lists.select("topic", "num_window_papers", "num_target_papers", F.transform("k", lambda x: x["keyword"]).alias("top_keywords"), F.transform("k", lambda x: F.round(x["influence_score"], 4)).alias("top_influence_scores"))
