"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, jaccard_join, mixing, packing, quality_rules, secret_scan, substring_dedup, token_counts, topk_search, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_ok")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn_from(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("uid")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(mixing.sizes(table(spark, sf_dir, "documents")))
    return drawn.select("doc_id", "size", "source_size", "target", mixing.taken(drawn).alias("taken"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold every control string and the quote character.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(HARD_TEXT).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("x")
    )
    return chat_format.digest(chat_format.round_trip(turns.unionByName(hard.select("x.*"))))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_bestfit_packing": op5_bestfit_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_source_mixing": op7_source_mixing,
    "op8_topk_search": op8_topk_search,
    "op9_chat_format": op9_chat_format,
    "op10_secret_scan": op10_secret_scan,
}

_OP1 = r"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_number() OVER () AS rid, doc_id, host, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), win AS (
  SELECT rid, unnest(generate_series(0, len(words) - 5)) AS pos,
         unnest(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i+4], ' '))) AS k
  FROM w WHERE len(words) >= 5
), dup AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT pos + j) AS n_repeat_words FROM dup, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY rid
), f AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), t AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
         100 * n_symbols > 20 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS dup_lines FROM f
), h AS (
  SELECT host, count(*) AS n, sum(short::INT)::DOUBLE AS f1, sum(repeats::INT)::DOUBLE AS f2,
         sum(symbols::INT)::DOUBLE AS f3, sum(dup_lines::INT)::DOUBLE AS f4 FROM t GROUP BY host
), r AS (
  SELECT host, n, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS k FROM h
), p AS (
  SELECT k, avg(f / n) AS m, var_pop(f / n) AS v FROM r GROUP BY k
), s AS (
  SELECT host, n, f, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS strength
  FROM r JOIN p USING (k)
), o AS (
  SELECT host, max((f + strength * m) / (n + strength)) <= 0.5 AS host_ok FROM s GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed,
       (NOT (short OR repeats) AND host_ok) AS kept, host_ok
FROM t JOIN o ON t.host IS NOT DISTINCT FROM o.host
"""

_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), q AS (
  SELECT *,
    (contains(role, '\') OR contains(text, '\') OR contains(role, ':') OR contains(role, '###') OR contains(text, '###')
      OR contains(role, '</turn>') OR contains(text, '</turn>')) AS hard,
    len(role) - len(replace(role, '\', '')) + len(text) - len(replace(text, '\', '')) + len(role) - len(replace(role, ':', ''))
      + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: len(x) - 2)), 0)
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: len(x) - 2)), 0)
      + (len(role) - len(replace(role, '</turn>', ''))) // 7 + (len(text) - len(replace(text, '</turn>', ''))) // 7 AS extra
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(role) + len(text) + 14 + CASE WHEN hard THEN extra ELSE 0 END) AS BIGINT) AS formatted_chars,
  true AS identical
FROM q GROUP BY conv_id
"""

_OP8 = r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid AS q_uid, q.vec_id AS query_id, c.uid AS c_uid, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q_uid ORDER BY score DESC, vec_id, c_uid) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP3 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, unnest(range(1, len(words) - 33)) AS pos, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i+34], ' ')))) AS k
  FROM w WHERE len(words) >= 35
), dup AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT rid, pos + j AS place FROM dup, (SELECT unnest(range(35)) AS j)
), each AS (
  SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY place) AS t, count(*) AS n FROM each ANTI JOIN gone USING (rid, place) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w
), e AS (
  SELECT rid, md5(unnest(shingles)) AS k FROM s
), o AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS n FROM e a JOIN e b ON a.k = b.k AND a.rid < b.rid GROUP BY 1, 2
), l AS (
  SELECT x, y FROM o JOIN s a ON a.rid = x JOIN s b ON b.rid = y WHERE 100 * n >= 80 * (len(a.shingles) + len(b.shingles) - n)
), both_ AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT rid, rid AS other FROM s UNION SELECT reach.rid, y FROM reach JOIN both_ ON x = other
)
SELECT a.doc_id, CAST(len(a.shingles) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN s a ON a.rid = reach.rid JOIN s b ON b.rid = other GROUP BY a.rid, a.doc_id, len(a.shingles)
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rn FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][rn % 3 + 1] AS BIGINT) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), o AS (  -- sources that reach three times their size first come first
  SELECT *, CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight DESC, rn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS weights
  FROM w WHERE source_size > 0
), c AS (
  SELECT *, bool_and(weight * (total - before) > 3 * source_size * weights) OVER (ORDER BY source_size::DOUBLE / weight, rn ROWS UNBOUNDED PRECEDING) AS full_ FROM o
), l AS (
  SELECT CAST(coalesce(sum(3 * source_size) FILTER (WHERE full_), 0) AS BIGINT) AS capped, CAST(coalesce(sum(weight) FILTER (WHERE NOT full_), 1) AS BIGINT) AS free FROM c
), g AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE (weight * (total - capped))::DOUBLE / free::DOUBLE END AS target,
         CASE WHEN full_ THEN 3 * source_size ELSE (2 * weight * (total - capped) + free) // (2 * free) END AS quota
  FROM c, l UNION ALL SELECT source, source_size, 0.0, 0 FROM w WHERE source_size = 0
), n AS (
  SELECT greatest(256, (max(source_size) + 4194303) // 4194304) AS blocks FROM s
), b AS (
  SELECT source, place % blocks AS block, sum(size) AS words FROM d, n GROUP BY 1, 2
), last AS (
  SELECT b.source, block, source_size, target, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS epochs,
         greatest(0, least(words, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END
           - coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS last_words
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, last_words - coalesce(sum(size) OVER (PARTITION BY d.source, block ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN n ON true JOIN last ON d.source IS NOT DISTINCT FROM last.source AND place % blocks = block
"""

ORACLES = {
    "op1_quality_rules": _OP1,
    "op3_substring_dedup": _OP3,
    "op6_jaccard_join": _OP6,
    "op7_source_mixing": _OP7,
    "op8_topk_search": _OP8,
    "op9_chat_format": _OP9,
}
