"""From raw documents to packed token sequences: STAGES in order, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result in the shared folder and rereads it. Stages that send
whole texts to Python last write their result themselves, in small batches, whoever reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from tidemark.llm.common import DOCUMENT_COLUMNS, cut, shuffle_partitions, table
from tidemark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows scored under the cut stay as they are; those predicted toxic go. Null and empty texts
    score as no match and stay; repeated rows are judged alike; an empty table stays empty; other columns go."""
    return cut(toxicity.reject(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked texts the row with the least doc_id stays, of rows alike one. Null and
    empty texts and null doc_ids link with nothing and all stay; an empty table stays empty; other columns go."""
    return jaccard_join.keep_one(docs.select(*DOCUMENT_COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all rows stay; every span of a text becomes [SECRET], and n_chars counts the new text. Null
    and empty texts stay as they are; repeated rows are scanned each; an empty table stays empty; other columns go."""
    return cut(secret_scan.redact(docs.select(*DOCUMENT_COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as often as the mix takes them, shard by shard, each shard in a shuffled order; a row that the
    mix takes in part ends after the words taken. Documents without words are taken never, so null and empty texts
    go; null sources are one source; repeated rows are documents each; an empty table stays empty; other columns go."""
    shards = shuffle_partitions(spark)
    drawn = mixing.draw(docs.select(*DOCUMENT_COLUMNS), mixing.Mixture(shards=shards))
    mixed = mixing.mixed_documents(drawn, list(DOCUMENT_COLUMNS))
    return mixed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a row for each piece of each document, with its sequence and offset. Null and empty texts are the
    end token alone; repeated rows (a document drawn again) are packed each; an empty table packs into nothing."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages whose result is a written table already.
WRITTEN = {"toxicity", "secrets"}

#: The lexicon of the first stage is learnt, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name in WRITTEN else cut(docs)
    return docs
