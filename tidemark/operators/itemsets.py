"""Frequent keyword pairs and triples by year.

Transactions are (row_id, year, items), items sorted and distinct. Pairs come out of each row
with array functions, so nothing is shuffled before they are counted; triples are made only from
pairs that are strong in their year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ItemsetConfig


def document_frequency(papers: DataFrame) -> DataFrame:
    """item, df: the papers that have the item."""
    return papers.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("df"))


def df_band(papers: DataFrame, min_count: int, max_frac: float) -> DataFrame:
    """item, df within [min_count, whole part of max_frac of the papers with items]."""
    total = papers.filter(F.size("items") > 0).agg(F.floor(F.lit(float(max_frac)) * F.count("*").cast("double")).alias("m")).scalar()
    return document_frequency(papers).filter((F.col("df") >= min_count) & (F.col("df") <= total))


def transactions(papers: DataFrame, valid: DataFrame) -> DataFrame:
    """row_id, year, items: the valid items of each paper, sorted; papers without any go."""
    rows = papers.select("row_id", "year", F.explode(F.array_distinct("items")).alias("item"))
    return rows.join(valid.select("item"), "item", "left_semi").groupBy("row_id", "year").agg(F.sort_array(F.collect_list("item")).alias("items"))


def year_sizes(tx: DataFrame) -> DataFrame:
    """year, n: transactions of the year, which are never empty."""
    return tx.groupBy("year").agg(F.count("*").alias("n"))


def _short(tx: DataFrame, max_items: int) -> DataFrame:
    """Pairs grow with the square of a row's items: a longer row is an error, not cut."""
    n = F.size("items")
    checked = F.when(n <= max_items, F.col("items")).otherwise(F.raise_error(F.concat(F.lit("a transaction has "), n.cast("string"), F.lit(f" items; mine top keywords, or raise max_items ({max_items})"))))
    return tx.withColumn("items", checked)


def pairs_of(items: Column) -> Column:
    """array<struct<a, b>> of the pairs a < b of a sorted array."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def edges_of(tx: DataFrame, max_items: int, long_rows: bool) -> DataFrame:
    """row_id, year, a, b: the pairs a < b of each row. long_rows: a row of more than max_items items gets its pairs from a
    join of its items with themselves, so that no row holds an array of them."""
    # explode_outer: explode would have the planner test the size of the array first, and so make all pairs twice
    within = lambda rows: rows.select("row_id", "year", F.explode_outer(pairs_of(F.col("items"))).alias("p")).filter("p IS NOT NULL").select("row_id", "year", "p.*")
    if not long_rows:
        return within(_short(tx, max_items))
    # one block of max_items items meets another in a task
    block = lambda c: (F.col(c) / F.lit(max_items)).cast("int")
    items = tx.filter(F.size("items") > max_items).select("row_id", "year", F.size("items").alias("n"), F.posexplode("items").alias("i", "item"))
    blocks = F.floor((F.col("n") - 1) / max_items).cast("int")
    left = items.select("row_id", "year", F.col("item").alias("a"), F.col("i").alias("at_a"), block("i").alias("x"), F.explode(F.sequence(block("i"), blocks)).alias("y"))
    right = items.select("row_id", "year", F.col("item").alias("b"), F.col("i").alias("at_b"), block("i").alias("y"), F.explode(F.sequence(F.lit(0), block("i"))).alias("x"))
    met = left.join(right, ["row_id", "year", "x", "y"]).filter("at_a < at_b").select("row_id", "year", "a", "b")
    return within(tx.filter(F.size("items") <= max_items)).unionByName(met)


def least_count(n: Column, p: ItemsetConfig) -> Column:
    """In double arithmetic throughout: 7 % of 100 is over 7."""
    return F.greatest(F.lit(p.min_count).cast("long"), F.ceil(F.lit(float(p.minsup_frac)) * n.cast("double")))


def frequent_pairs(tx: DataFrame, p: ItemsetConfig, long_rows: bool = False) -> DataFrame:
    """year, a, b, count, supp, lift of the pairs with enough support and lift in their year. Rows of more than max_items
    items are an error, or with long_rows mined like all others."""
    sizes = year_sizes(tx)
    singles = tx.select("year", F.explode("items").alias("item")).groupBy("year", "item").agg(F.count("*").alias("c"))
    counted = edges_of(tx, p.max_items, long_rows).groupBy("year", "a", "b").agg(F.count("*").alias("count"))
    enough = counted.join(F.broadcast(sizes), "year").filter(F.col("count") >= least_count(F.col("n"), p))  # a row for each year
    a, b = (singles.select("year", F.col("item").alias(k), F.col("c").alias(f"c_{k}")) for k in "ab")
    share = lambda c: F.col(c).cast("double") / F.col("n")
    lifted = enough.join(a, ["year", "a"]).join(b, ["year", "b"]).withColumn("supp", share("count")).withColumn("lift", F.col("supp") / (share("c_a") * share("c_b") + F.lit(1e-12)))
    return lifted.filter(F.col("lift") >= float(p.min_lift)).select("year", "a", "b", "count", "supp", "lift")


def frequent_triples(tx: DataFrame, strong: DataFrame, p: ItemsetConfig, long_rows: bool = False) -> DataFrame:
    """year, a, b, c, count, supp, lift_min of the triples whose three pairs are strong in the year. long_rows: as in frequent_pairs."""
    edges = edges_of(tx, p.max_items, long_rows)
    edges = edges.join(strong.select("year", "a", "b", "lift"), ["year", "a", "b"])
    # the strong pairs of a row, and the triangles among them
    held = edges.groupBy("row_id", "year").agg(F.sort_array(F.collect_list(F.struct("a", "b", "lift"))).alias("e")).filter(F.size("e") >= 3)
    named = F.transform("e", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    found = held.withColumn("names", named).withColumn(
        "t",
        F.flatten(
            F.transform(
                "e",
                lambda x: F.transform(
                    F.filter("e", lambda y: (y["a"] == x["a"]) & (y["b"] > x["b"]) & F.array_contains(F.col("names"), F.struct(x["b"].alias("a"), y["b"].alias("b")))),
                    lambda y: F.struct(x["a"].alias("a"), x["b"].alias("b"), y["b"].alias("c")),
                ),
            )
        ),
    )
    counted = found.select("year", F.explode_outer("t").alias("t")).filter("t IS NOT NULL").groupBy("year", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.c").alias("c")).agg(F.count("*").alias("count"))
    enough = counted.join(F.broadcast(year_sizes(tx)), "year").filter(F.col("count") >= least_count(F.col("n"), p))
    lift = lambda x, y, name: strong.select("year", F.col("a").alias(x), F.col("b").alias(y), F.col("lift").alias(name))
    with_lift = enough.join(lift("a", "b", "l1"), ["year", "a", "b"]).join(lift("a", "c", "l2"), ["year", "a", "c"]).join(lift("b", "c", "l3"), ["year", "b", "c"])
    return with_lift.select("year", "a", "b", "c", "count", (F.col("count").cast("double") / F.col("n")).alias("supp"), F.least("l1", "l2", "l3").alias("lift_min"))


def yearly_metrics(tx: DataFrame, p: ItemsetConfig) -> DataFrame:
    """year, items (sorted array), size, count, supp, lift (of a triple: its least pair lift), for all years at once."""
    pairs = frequent_pairs(tx, p, long_rows=True)
    triples = frequent_triples(tx, pairs, p, long_rows=True)
    two = pairs.select("year", F.array("a", "b").alias("items"), F.lit(2).alias("size"), "count", "supp", "lift")
    three = triples.select("year", F.array("a", "b", "c").alias("items"), F.lit(3).alias("size"), "count", "supp", F.col("lift_min").alias("lift"))
    return two.union(three)


def label(items: Column) -> Column:
    return F.array_join(items, " + ")
