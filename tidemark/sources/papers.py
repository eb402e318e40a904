"""Readers, loaders and adapters that give the papers table its canonical form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NULL_TOKENS, PAPERS_CSV

TOPIC_COLUMNS = ("assigned_topics", "topics", "matched_topics")
TEXT_COLUMNS = ("title", "abstract", "summary", "keywords", "fields_of_study", "venue")


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def choose_topic_column(df: DataFrame) -> str:
    for c in TOPIC_COLUMNS:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {', '.join(TOPIC_COLUMNS)} is there")


def choose_text_columns(df: DataFrame) -> list[str]:
    found = [c for c in TEXT_COLUMNS if c in df.columns]
    if not found:
        raise ValueError(f"none of the columns {', '.join(TEXT_COLUMNS)} is there")
    return found


def read_csv(spark: SparkSession, path: str, schema=PAPERS_CSV) -> DataFrame:
    """A CSV file with a header, doubled quotes and multi-line cells, columns by name; null tokens become
    null. Columns of the schema that the file lacks are left out."""
    try:
        header = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).columns
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    ddl = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    df = spark.read.schema(ddl).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.select(*[F.when(~F.trim(c).isin(*NULL_TOKENS), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """A key for each row: papers are not unique by paper_id. It depends on how the files are split, so the plans write the
    numbered table once before they join by it."""
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def _dated(df: DataFrame) -> DataFrame:
    cited = X.citations(F.col("citation_count")) if "citation_count" in df.columns else F.lit(0.0)
    return df.withColumn("year", X.whole_year(F.col("year"))).withColumn("citation_count", cited).filter("year IS NOT NULL")


def _topics(df: DataFrame) -> Column:
    name = choose_topic_column(df)
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else X.parse_topics(F.col(name))


def load_for_keywords(df: DataFrame) -> DataFrame:
    """Papers with a year and topics: row_id, topics, doc_text and their own columns."""
    require_columns(df, ("paper_id", "year"))
    text = X.document_text([F.col(c) for c in choose_text_columns(df)])
    return with_row_id(_dated(df)).withColumn("topics", _topics(df)).filter(F.size("topics") > 0).withColumn("doc_text", text)


def load_for_itemsets(df: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """row_id, paper_id, year, items of the papers in a range of years that have keywords."""
    require_columns(df, ("paper_id", "year", "extracted_keywords"))
    items = F.col("extracted_keywords") if dict(df.dtypes)["extracted_keywords"].startswith("array") else X.parse_keywords(F.col("extracted_keywords"))
    dated = with_row_id(_dated(df)).filter(F.col("year").between(min_year, max_year))
    return dated.select("row_id", "paper_id", "year", items.alias("items")).filter(F.size("items") > 0)


def load_for_forecast(df: DataFrame) -> DataFrame:
    """row_id, paper_id, year, citation_count, topics of the papers with a year and topics."""
    require_columns(df, ("paper_id", "year"))
    return with_row_id(_dated(df)).withColumn("topics", _topics(df)).filter(F.size("topics") > 0).select("row_id", "paper_id", "year", "citation_count", "topics")


# ---- adapters: other tables as papers


def basket_papers(spark: SparkSession, sf_dir: str, item: str = "p_name") -> DataFrame:
    """Orders as papers: their distinct parts are the items, the parts' brands the topics."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("citation_count"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(item).alias("item"), "p_brand")
    sold = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set("p_brand")).alias("topics"))
    return orders.join(sold, orders.row_id == sold.l_orderkey).select("row_id", F.col("row_id").cast("string").alias("paper_id"), "year", "citation_count", "items", "topics")


def document_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: language and source are the topics, years go round."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("doc_id").cast("string").alias("paper_id"),
        (2015 + F.col("doc_id") % 11).cast("int").alias("year"),
        (F.col("n_chars") % 500).cast("double").alias("citation_count"),
        F.array(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("source "), "source")).alias("topics"),
        X.normalize_for_keywords(F.coalesce("text", F.lit(""))).alias("doc_text"),
    )


def event_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as papers: days are the years, the event's type its topic."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("row_id"), F.col("event_id").cast("string").alias("paper_id"), F.dayofmonth("ts").alias("year"), F.col("value").alias("citation_count"), F.array("event_type").alias("topics"))


def is_field(df: DataFrame, field: str = "Computer Science", column: str = "fields_of_study") -> DataFrame:
    """Ingest filter: papers of a field of study (an array, or text with | or ;)."""
    fields = F.col(column) if dict(df.dtypes)[column].startswith("array") else X.parse_topics(F.col(column))
    return df.filter(F.array_contains(fields, field))
