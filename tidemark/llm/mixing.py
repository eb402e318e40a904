"""Operator 7: mixing sources to target weights with a hypergeometric splitting tree.

1. The sizes of all documents are written once, with a place: a hash of doc_id and text. Documents
   fall into pseudo-random blocks of their source by their place, so reruns agree and a hot source is
   spread over many groups; the number of blocks follows the largest source.
2. A source's quota of words becomes whole passes over its blocks, then further blocks in their
   order, one block cut between documents and one document cut between words, so that every
   source takes its quota exactly.
3. The drawn blocks are dealt to the output shards by a tree: at each node the quota vector (blocks by
   source) is split between the two halves of the shards with a multivariate hypergeometric
   draw; each source's blocks are then dealt in a permuted order, without overlap, and rows
   are ordered by a hash within a shard.

Texts are joined to the table of blocks once; only those of each source's one cut block are sorted.
The driver holds one row per source, the components of the mixture (and, of each, its blocks' bounds by
shard); all else is grouped by (source, block).

Defined results: a null text has size 0; sources with null names are one source, last in
order; an all-empty corpus takes nothing; a document of size 0 takes nothing; rows with a null or a
shared doc_id are told apart by their texts; repeated rows are separate documents, and which
of them the cut falls on makes no difference; other columns are kept, but for those named as the results.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GAP, count_words, cut

#: A table of blocks up to this size is sent to all executors; a larger one is joined by (source, block).
SMALL_PLAN = 50_000


@dataclass(frozen=True)
class Mixture:
    """weights repeat over the sources in code point order; a target stops at max_epochs times
    its source's size. shards is the number of output shards. A source has min_blocks blocks, or more so that
    a block of the largest has about block_words words."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_epochs: int = 3
    shards: int = 16
    seed: int = 7
    min_blocks: int = 256
    block_words: int = 1 << 22


def targets(sizes: list[int], weights: list[int], max_epochs: int) -> list[Fraction]:
    """Shares of the total by weight, none over max_epochs times its size: shares over their
    caps stop there and the rest is shared anew by weight."""
    left, free = Fraction(sum(sizes)), {i for i, s in enumerate(sizes) if s > 0}
    out = [Fraction(0)] * len(sizes)
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > max_epochs * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = Fraction(max_epochs * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard, as [shard, source]: exact quotas, split in halves."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    total = int(quotas.sum())
    left = rng.multivariate_hypergeometric(quotas, total * half // shards, method="marginals") if total else quotas * 0
    return np.concatenate([splitting_tree(left, half, rng), splitting_tree(quotas - left, shards - half, rng)])


def _place(mixture: Mixture):
    """A number of 60 bits that depends on doc_id and text alone."""
    known = F.concat_ws(":", F.lit(str(mixture.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """doc_id, source, size (words) and place of each document, as a written table."""
    return cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), _place(mixture).alias("place")))


def block_plan(measured: DataFrame, mixture: Mixture) -> tuple[DataFrame, int, int]:
    """From sizes(): b_source, b_block, words, source_size, target, epochs (whole passes), last_words (of the last pass)
    and units (copy, shard) of each block, as a written table; the number of blocks of a source; and of rows."""
    spark = measured.sparkSession
    rows = measured.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row per source
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [mixture.weights[i % len(mixture.weights)] for i in range(len(rows))]
    amounts = [int(r["size"]) for r in rows]
    goals = targets(amounts, weights, mixture.max_epochs)
    plan = []
    for r, size, goal in zip(rows, amounts, goals, strict=True):
        epochs, rest = divmod(min(int(goal + Fraction(1, 2)), mixture.max_epochs * size), size) if size else (0, 0)
        plan.append((r["source"], size, float(goal), epochs, rest))
    schema = T.StructType([T.StructField("p_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType()), T.StructField("rest", T.LongType())])
    planned = spark.createDataFrame(plan, schema)
    n_blocks = max(mixture.min_blocks, -(-max(amounts, default=0) // mixture.block_words))

    # words before each block in its source; the blocks of the last, partial pass
    blocks = measured.groupBy("source", (F.col("place") % n_blocks).alias("block")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        blocks.join(planned, F.col("source").eqNullSafe(F.col("p_source")))
        .drop("p_source")
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("last_words", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before"))))
    )
    drawn = cut(ranked.withColumn("copies", (F.col("epochs") + F.when(F.col("last_words") > 0, 1).otherwise(0)).cast("long")))
    counts = {r["source"]: (int(r["n"]), int(r["rows"])) for r in drawn.groupBy("source").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).collect()}  # a row per source
    tree = splitting_tree(np.array([counts[r["source"]][0] for r in rows], dtype=np.int64), mixture.shards, np.random.default_rng(mixture.seed))
    ends = spark.createDataFrame(
        [(r["source"], [int(x) for x in np.cumsum(tree[:, i])]) for i, r in enumerate(rows)],
        T.StructType([T.StructField("e_source", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))]),
    )
    # each source's (block, copy) units in permuted order
    copy = drawn.filter("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(mixture.seed + 1), F.col("block"), F.col("copy")), "block", "copy")
    dealt = (
        copy.withColumn("rank", F.row_number().over(permuted) - 1)
        .join(ends, F.col("source").eqNullSafe(F.col("e_source")))
        .select("source", "block", F.struct("copy", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")).alias("unit"))
        .groupBy("source", "block")
        .agg(F.sort_array(F.collect_list("unit")).alias("units"))
        .select(F.col("source").alias("d_source"), F.col("block").alias("d_block"), "units")
    )
    units = F.coalesce("units", F.array().cast("array<struct<copy:bigint,shard:int>>")).alias("units")
    both = drawn.join(dealt, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")), "left")
    return cut(both.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "words", "source_size", "target", "epochs", "last_words", units)), n_blocks, sum(n for _, n in counts.values())


def draw(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The documents with size, source_size, target, and draws: array of (copy, words, shard, key),
    one for each time the mix takes the document; words under size is a cut copy. docs has texts, or is a table of sizes()."""
    has_text = "text" in docs.columns
    plan, n_blocks, n_rows = block_plan(sizes(docs, mixture) if has_text else docs, mixture)
    plan = F.broadcast(plan) if n_rows <= SMALL_PLAN else plan
    # the row travels whole, so that none of its columns meets one of ours
    placed = docs.select(F.struct("*").alias("row"), F.col("source").alias("_source"), (_place(mixture) if has_text else F.col("place")).alias("_place"))
    joined = placed.join(plan, F.col("_source").eqNullSafe(F.col("b_source")) & ((F.col("_place") % n_blocks) == F.col("b_block")))
    size = count_words(F.col("row.text")) if has_text else F.col("row.size")
    is_cut = (F.col("last_words") > 0) & (F.col("last_words") < F.col("words"))
    whole = joined.filter(~is_cut).withColumn("_size", size).withColumn("_last", F.when(F.col("last_words") > 0, F.col("_size")).otherwise(0))
    # the last pass takes the documents of a source's cut block in the order of their places until its words are reached
    order = Window.partitionBy("b_source", "b_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    part = joined.filter(is_cut).withColumn("_size", size)
    part = part.withColumn("_last", F.greatest(F.lit(0).cast("long"), F.least("_size", F.col("last_words") - F.coalesce(F.sum("_size").over(order), F.lit(0)))))
    both = whole.unionByName(part)
    draws = F.filter(
        F.transform(
            "units",
            lambda u: F.struct(
                u["copy"].alias("copy"),
                F.when(u["copy"] <= F.col("epochs"), F.col("_size")).otherwise(F.col("_last")).alias("words"),
                u["shard"].alias("shard"),
                F.xxhash64(F.lit(mixture.seed + 3), F.col("_place"), u["copy"]).alias("key"),
            ),
        ),
        lambda d: d["words"] > 0,
    )
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "draws")]
    return both.select(*own, F.col("_size").alias("size"), "source_size", "target", draws.alias("draws"))


def taken(drawn: DataFrame):
    """The words that the mix takes of a document."""
    return F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])


def mixed_documents(drawn: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each draw of draw(), its text cut after the words taken (and n_chars counted anew where it
    was cut), with shard and key."""
    rows = drawn.select(*columns, F.col("size").alias("whole"), F.explode("draws").alias("d"))
    first = F.array_join(F.slice(F.filter(F.split("text", GAP), lambda w: w != ""), F.lit(1), F.col("d.words").cast("int")), " ")
    is_cut = F.col("d.words") < F.col("whole")
    rows = rows.withColumn("text", F.when(is_cut, first).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(is_cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns, F.col("d.shard").alias("shard"), F.col("d.key").alias("key"))
