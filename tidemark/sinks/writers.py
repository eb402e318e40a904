"""Sinks: parquet first; CSV, JSON, text and HTML documents for bounded results; model files."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, which CSV can hold."""
    nested = ("array", "struct", "map")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document at a path that Spark's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if at.getParent() is not None:
        fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def records(df: DataFrame, limit: int | None = None) -> list[dict[str, Any]]:
    """At most `limit` rows as plain values; all rows of a table that is known to be small."""
    return [json.loads(x) for x in (df if limit is None else df.limit(limit)).select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]]


def write_json(spark: SparkSession, path: str, document: Any, ascii_only: bool = True) -> None:
    write_text(spark, path, json.dumps(document, indent=2, ensure_ascii=ascii_only) + "\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary(title: str, facts: dict[str, Any], rows: list[dict[str, Any]], columns: Sequence[str]) -> str:
    """A text summary: facts, then a numbered list."""
    lines = [title, "=" * len(title), ""]
    lines += [f"{k}: {v}" for k, v in facts.items()]
    lines += [""] + [f"{i}. " + " | ".join(f"{r.get(c):.4f}" if isinstance(r.get(c), float) else str(r.get(c)) for c in columns) for i, r in enumerate(rows, 1)]
    return "\n".join(lines) + "\n"


def html_report(title: str, metrics: dict[str, Any], cards: list[dict[str, Any]]) -> str:
    """Metric cards and a card for each record; every value is escaped."""
    e = lambda x: html.escape(str(x))
    head = "".join(f"<div class='metric'><b>{e(v)}</b><span>{e(k)}</span></div>" for k, v in metrics.items())
    body = []
    for c in cards:
        words = "".join(f"<li>{e(w.get('keyword', ''))} {w.get('influence_score', 0):.4f}</li>" for w in c.get("keywords", []) or [])
        facts = "".join(f"<p>{e(k)}: {e(v)}</p>" for k, v in c.items() if k != "keywords")
        body.append(f"<section class='card'>{facts}<ul>{words}</ul></section>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1><div>{head}</div>{''.join(body)}</body></html>\n"
