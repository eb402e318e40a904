"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: As read from CSV: all text; the loaders coerce.
PAPERS_CSV = _struct(paper_id=_S, title=_S, year=_S, citation_count=_S, venue=_S, fields_of_study=_S, abstract=_S, summary=_S, keywords=_S)
PAPERS_WITH_TOPICS_CSV = T.StructType([*PAPERS_CSV.fields, *_struct(assigned_topics=_S, primary_topic=_S, num_topics=_S, search_text_used_for_matching=_S).fields])
PAPERS_WITH_KEYWORDS_CSV = T.StructType([*PAPERS_WITH_TOPICS_CSV.fields, *_struct(extracted_keywords=_S, extracted_keyword_scores=_S).fields])
EDGES = _struct(src=_S, dst=_S)
PREDICTIONS = _struct(topic=_S, prediction=_D, ground_truth=_D)
CURVES = _struct(items=_S, size=_I, linear_slope=_D, linear_r2=_D, exp_k=_D, logistic_k=_D, model_fit=_S, trend_score=_D)
#: Cells that stand for a missing value in CSV files.
NULL_TOKENS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>")
