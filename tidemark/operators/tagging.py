"""Rule tagging: multi-label topics, parents, fallback, and the topic-paper hypergraph."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X

Taxonomy = dict[str, list[str]]


def topic_hits(text: Column, taxonomy: Taxonomy) -> Column:
    """array<struct<topic, hits>> of the topics with a match; hits counts distinct patterns. Patterns are
    literals, each compiled once."""
    each = []
    for topic, patterns in taxonomy.items():
        hits = functools.reduce(lambda a, b: a + b, [text.rlike("(?i)" + p).cast("int") for p in patterns])
        each.append(F.struct(F.lit(topic).alias("topic"), hits.alias("hits")))
    return F.filter(F.array(*each), lambda t: t["hits"] > 0)


def with_parents(hits: Column, parents: dict[str, list[str]]) -> Column:
    """The topics with all their ancestors; an ancestor that didn't match has 0 hits."""
    ancestors = rules.closure(parents)
    if not ancestors:
        return hits
    table = F.array(*[F.struct(F.lit(c).alias("child"), F.lit(p).alias("parent")) for c, p in ancestors])
    names = F.transform(hits, lambda t: t["topic"])
    added = F.array_distinct(F.transform(F.filter(table, lambda r: F.array_contains(names, r["child"])), lambda r: r["parent"]))
    return F.concat(hits, F.transform(F.array_except(added, names), lambda p: F.struct(p.alias("topic"), F.lit(0).alias("hits"))))


def fallback_topic(text: Column, families=rules.FALLBACKS, default: str = rules.DEFAULT_TOPIC) -> Column:
    """The first family with a substring in the text (not bounded by words)."""
    low, out = F.lower(text), None
    for topic, terms in families:
        found = functools.reduce(lambda a, b: a | b, [low.contains(t) for t in terms])
        out = F.when(found, topic) if out is None else out.when(found, topic)
    return F.lit(default) if out is None else out.otherwise(default)


def in_order(hits: Column) -> Column:
    """Topic names, most hits first, then by name."""
    keyed = F.transform(hits, lambda t: F.struct((-t["hits"]).alias("o"), t["topic"].alias("topic")))
    return F.transform(F.array_sort(keyed), lambda t: t["topic"])


def tag(df: DataFrame, text: Column, taxonomy: Taxonomy | None = None, parents: dict[str, list[str]] | None = None) -> DataFrame:
    """df with assigned_topics, primary_topic, num_topics and search_text_used_for_matching."""
    taxonomy = rules.default_taxonomy() if taxonomy is None else taxonomy
    parents = rules.PARENTS if parents is None else parents
    name = "search_text_used_for_matching"
    hit = df.withColumn(name, text).withColumn("_hits", topic_hits(F.col(name), taxonomy))
    full = hit.withColumn("_all", with_parents(F.col("_hits"), parents))
    topics = F.when(F.size("_hits") > 0, in_order(F.col("_all"))).otherwise(F.array(fallback_topic(F.col(name))))
    return full.withColumn("assigned_topics", topics).withColumn("primary_topic", F.get("assigned_topics", F.lit(0))).withColumn("num_topics", F.size("assigned_topics")).drop("_hits", "_all")


def tag_papers(papers: DataFrame, taxonomy: Taxonomy | None = None, parents: dict[str, list[str]] | None = None) -> DataFrame:
    """Tagging by title, fields of study and venue, those that are there."""
    columns = [F.col(c) if c in papers.columns else F.lit(None).cast("string") for c in ("title", "fields_of_study", "venue")]
    return tag(papers, X.search_text(columns), taxonomy, parents)


def incidence(tagged: DataFrame) -> DataFrame:
    """paper_id, topic_id, topic_name, title, year: a row for each paper and topic; the year as text."""
    title, year = (X.safe_text(F.col(c)) if c in tagged.columns else F.lit("") for c in ("title", "year"))
    # explode_outer: explode would have the planner test the size of the array first, and so match all rules twice
    rows = tagged.select("paper_id", title.alias("title"), year.alias("year"), F.explode_outer("assigned_topics").alias("topic_name")).filter("topic_name IS NOT NULL")
    return rows.select("paper_id", X.slugify(F.col("topic_name")).alias("topic_id"), "topic_name", "title", "year")


def topic_nodes(links: DataFrame, topics: list[str]) -> DataFrame:
    """topic_id, topic_name, paper_count of all topics, with those that no paper has."""
    names = links.sparkSession.createDataFrame([(t,) for t in topics], "topic_name string")
    counts = links.groupBy("topic_name").agg(F.count("*").alias("n"))
    return names.join(counts, "topic_name", "left").select(X.slugify(F.col("topic_name")).alias("topic_id"), "topic_name", F.coalesce("n", F.lit(0)).cast("long").alias("paper_count"))


def hyperedges(tagged: DataFrame) -> DataFrame:
    """A record for each paper with its topics and their ids."""
    own = [X.safe_text(F.col(c)).alias(c) if c in tagged.columns else F.lit("").alias(c) for c in ("paper_id", "title", "year", "citation_count", "venue", "fields_of_study")]
    return tagged.select(*own, F.col("assigned_topics").alias("topics"), F.transform("assigned_topics", X.slugify).alias("topic_ids"), "primary_topic")


def hypergraph_stats(tagged: DataFrame, n_topics: int) -> DataFrame:
    """num_papers, num_topics, num_incidence_pairs."""
    return tagged.agg(F.count("*").alias("num_papers"), F.lit(n_topics).cast("long").alias("num_topics"), F.coalesce(F.sum(F.size("assigned_topics").cast("long")), F.lit(0)).cast("long").alias("num_incidence_pairs"))
