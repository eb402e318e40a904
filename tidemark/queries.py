"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import TREND_MODELS, ForecastConfig, ItemsetConfig, KeywordConfig
from .functions import rules
from .functions import text as X
from .operators import forecast, hypergraph, itemsets, keywords, metrics, reports, snapshots, tagging, trends
from .plans import run
from .sources import papers as S
from .storage import cut
from .streaming import counts as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- parameters under which the test tables give rows

NAMES = ItemsetConfig(min_year=1990, max_year=2010, forecast_year=2002, df_min_count=3, df_max_frac=0.25, minsup_frac=0.002, min_count=2, min_lift=1.0, top_m=20)
TYPES = ItemsetConfig(min_year=1990, max_year=2010, forecast_year=2002, df_min_count=3, df_max_frac=1.0, minsup_frac=0.01, min_count=2, min_lift=0.5, top_m=20)
SCORES = KeywordConfig(window_start=2015, window_end=2023, target_year=2024, min_df=2, max_features=20_000, ngrams=(1,))

#: A taxonomy of words that the test documents hold, with parents that are matched and that aren't.
TEST_TAXONOMY = {
    "English Function Words": [r"\bthe\b", r"\band\b", r"\bof\b", r"\bfrom\b"],
    "German Function Words": [r"\bder\b", r"\bund\b", r"\bmit\b"],
    "French Function Words": [r"\bles?\b", r"\bde\b", r"\baux?\b"],
    "Spanish Function Words": [r"\blos\b", r"\bque\b", r"\bde\b"],
    "Reinforcement": [r"(?<![a-z])rl(?![a-z])", r"\btions?\b"],
    "Contact Data": [r"@mail\d", r"example\.com"],
    "Credentials": [r"password", r"\btoken\b"],
}
TEST_PARENTS = {"German Function Words": ["Germanic"], "English Function Words": ["Germanic"], "Germanic": ["Language"], "French Function Words": ["Romance"], "Spanish Function Words": ["Romance"], "Romance": ["Language"], "Credentials": ["Contact Data"]}

# ---- itemsets


def _tx(spark: SparkSession, sf_dir: str, p: ItemsetConfig, item: str) -> DataFrame:
    papers = S.basket_papers(spark, sf_dir, item)
    return cut(itemsets.transactions(papers, itemsets.df_band(papers, p.df_min_count, p.df_max_frac)))


def _tx_sql(p: ItemsetConfig, item: str) -> str:
    return f"""
raw AS (SELECT DISTINCT o_orderkey AS row_id, CAST(year(o_orderdate) AS INTEGER) AS yr, {item} AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
dfs AS (SELECT item, count(*) AS df FROM raw GROUP BY item),
valid AS (SELECT item FROM dfs WHERE df >= {p.df_min_count} AND df <= floor({p.df_max_frac}::DOUBLE * (SELECT count(DISTINCT row_id) FROM raw)::DOUBLE)),
tx AS (SELECT raw.* FROM raw JOIN valid USING (item)),
ny AS (SELECT yr, count(DISTINCT row_id) AS n FROM tx GROUP BY yr),
ci AS (SELECT yr, item, count(*) AS c FROM tx GROUP BY yr, item),
pc AS (SELECT x.yr, x.item AS a, y.item AS b, count(*) AS cnt FROM tx x JOIN tx y ON x.row_id = y.row_id AND x.item < y.item GROUP BY 1, 2, 3),
pairs AS (SELECT pc.yr, a, b, cnt, cnt::DOUBLE / n AS supp,
    (cnt::DOUBLE / n) / ((ca.c::DOUBLE / n) * (cb.c::DOUBLE / n) + 1e-12::DOUBLE) AS lift
  FROM pc JOIN ny ON pc.yr = ny.yr JOIN ci ca ON ca.yr = pc.yr AND ca.item = a JOIN ci cb ON cb.yr = pc.yr AND cb.item = b
  WHERE cnt >= greatest({p.min_count}, ceil({p.minsup_frac}::DOUBLE * n::DOUBLE))),
strong AS (SELECT * FROM pairs WHERE lift >= {p.min_lift}::DOUBLE)"""


def _metrics_sql(p: ItemsetConfig, item: str, triples: bool) -> str:
    three = f"""
tc AS (SELECT x.yr, x.item AS a, y.item AS b, z.item AS c, count(*) AS cnt
  FROM tx x JOIN tx y ON x.row_id = y.row_id AND x.item < y.item JOIN tx z ON x.row_id = z.row_id AND y.item < z.item GROUP BY 1, 2, 3, 4),
triples AS (SELECT tc.yr, tc.a, tc.b, tc.c, tc.cnt, tc.cnt::DOUBLE / n AS supp, least(p.lift, q.lift, r.lift) AS lift_min
  FROM tc JOIN ny ON tc.yr = ny.yr JOIN strong p ON p.yr = tc.yr AND p.a = tc.a AND p.b = tc.b
  JOIN strong q ON q.yr = tc.yr AND q.a = tc.a AND q.b = tc.c JOIN strong r ON r.yr = tc.yr AND r.a = tc.b AND r.b = tc.c
  WHERE tc.cnt >= greatest({p.min_count}, ceil({p.minsup_frac}::DOUBLE * n::DOUBLE))),"""
    union = "UNION ALL SELECT yr, a || ' + ' || b || ' + ' || c, 3, supp FROM triples" if triples else ""
    return f"""{_tx_sql(p, item)},{three if triples else ''}
met AS (SELECT yr, a || ' + ' || b AS itemset, 2 AS size, supp FROM strong {union}),
grid AS (SELECT DISTINCT itemset, size, ny.yr FROM met, ny),
z AS (SELECT grid.itemset, grid.size, grid.yr, ln(1 + coalesce(supp, 0)) AS z FROM grid LEFT JOIN met ON met.itemset = grid.itemset AND met.yr = grid.yr)"""


_HAT = {
    "mean": "avg(z) OVER w",
    "drift": "avg(z) OVER w + CASE WHEN count(z) OVER w > 1 THEN (last_value(z) OVER w - first_value(z) OVER w) / (count(z) OVER w - 1) ELSE 0 END",
}
_AR1 = """
h AS (SELECT *, list(z) OVER (PARTITION BY itemset ORDER BY yr ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hist FROM z),
g AS (SELECT *, len(hist) AS n, hist[1:len(hist)-1] AS xs, hist[2:len(hist)] AS ys FROM h),
m AS (SELECT *, list_avg(xs) AS mx, list_avg(ys) AS my FROM g),
s AS (SELECT *, list_sum(list_transform(xs, lambda v: (v - mx) * (v - mx))) AS sxx,
       list_sum(list_transform(range(1, n), lambda i: (xs[i] - mx) * (ys[i] - my))) AS sxy FROM m),
res AS (SELECT itemset, size, yr, z, CASE WHEN hist IS NULL OR n = 0 THEN z WHEN n = 1 THEN hist[1]
       WHEN sxx > 1e-12 THEN sxy / sxx * hist[n] + my - sxy / sxx * mx ELSE my END AS z_hat FROM s)"""


def _residual_sql(p: ItemsetConfig, item: str, triples: bool, baseline: str) -> str:
    base = _metrics_sql(p, item, triples)
    if baseline == "ar1":
        return f"{base},{_AR1}"
    return f"""{base},
res AS (SELECT itemset, size, yr, z, CASE WHEN count(z) OVER w = 0 THEN z ELSE {_HAT[baseline]} END AS z_hat
  FROM z WINDOW w AS (PARTITION BY itemset ORDER BY yr ROWS BETWEEN {p.window} PRECEDING AND 1 PRECEDING))"""


@query("""SELECT p_name AS item, count(*) AS df FROM
  (SELECT DISTINCT o_orderkey, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.document_frequency(S.basket_papers(spark, sf_dir))


@query(f"WITH {_tx_sql(NAMES, 'p_name')} SELECT dfs.item, df FROM dfs JOIN valid USING (item)")
def df_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.df_band(S.basket_papers(spark, sf_dir), NAMES.df_min_count, NAMES.df_max_frac)


@query(f"""WITH {_tx_sql(NAMES, 'p_name')} SELECT tx.yr, count(DISTINCT row_id) AS n_papers, count(*) AS n_items FROM tx GROUP BY tx.yr""")
def yearly_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = _tx(spark, sf_dir, NAMES, "p_name")
    return tx.groupBy(F.col("year").alias("yr")).agg(F.count("*").alias("n_papers"), F.sum(F.size("items").cast("long")).alias("n_items"))


@query(f"WITH {_tx_sql(NAMES, 'p_name')} SELECT yr, a, b, cnt, round(supp, 9) AS supp, round(lift, 9) AS lift FROM strong")
def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itemsets.frequent_pairs(_tx(spark, sf_dir, NAMES, "p_name"), NAMES, long_rows=True)
    return found.select(F.col("year").alias("yr"), "a", "b", F.col("count").alias("cnt"), F.round("supp", 9).alias("supp"), F.round("lift", 9).alias("lift"))


@query(f"WITH {_metrics_sql(TYPES, 'p_type', True)} SELECT yr, a, b, c, cnt, round(supp, 9) AS supp, round(lift_min, 9) AS lift_min FROM triples")
def frequent_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = _tx(spark, sf_dir, TYPES, "p_type")
    found = itemsets.frequent_triples(tx, itemsets.frequent_pairs(tx, TYPES, long_rows=True), TYPES, long_rows=True)
    return found.select(F.col("year").alias("yr"), "a", "b", "c", F.col("count").alias("cnt"), F.round("supp", 9).alias("supp"), F.round("lift_min", 9).alias("lift_min"))


def _series(spark: SparkSession, sf_dir: str, p: ItemsetConfig, item: str, triples: bool) -> DataFrame:
    tx = _tx(spark, sf_dir, p, item)
    if triples:
        found = cut(itemsets.yearly_metrics(tx, p))
    else:
        found = itemsets.frequent_pairs(tx, p, long_rows=True).select("year", F.array("a", "b").alias("items"), F.lit(2).alias("size"), "supp")
    return trends.series(found, tx)


def _residual_rows(found: DataFrame) -> DataFrame:
    return found.select(itemsets.label(F.col("items")).alias("itemset"), "size", F.col("year").alias("yr"), *[F.round(c, 9).alias(c) for c in ("z", "z_hat", "residual")])


_ROWS = "SELECT itemset, size, yr, round(z, 9) AS z, round(z_hat, 9) AS z_hat, round(z - z_hat, 9) AS residual FROM res"


@query(f"WITH {_residual_sql(NAMES, 'p_name', False, 'drift')} {_ROWS}")
def drift_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual_rows(trends.residuals(_series(spark, sf_dir, NAMES, "p_name", False), "drift", NAMES.window))


@query(f"WITH {_residual_sql(TYPES, 'p_type', True, 'ar1')} {_ROWS}")
def ar1_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual_rows(trends.residuals(_series(spark, sf_dir, TYPES, "p_type", True), "ar1", TYPES.window))


@query(f"WITH {_residual_sql(TYPES, 'p_type', True, 'mean')} {_ROWS}")
def mean_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual_rows(trends.residuals(_series(spark, sf_dir, TYPES, "p_type", True), "mean", TYPES.window))


_FORECAST = f"""fc AS (SELECT itemset, size, coalesce(avg(CASE WHEN yr >= {max(1990, NAMES.forecast_year - NAMES.window)} THEN z - z_hat END), 0) AS f FROM res GROUP BY itemset, size)"""


@query(f"WITH {_residual_sql(NAMES, 'p_name', False, 'drift')}, {_FORECAST} SELECT itemset, size, round(f, 9) AS predicted_residual FROM fc")
def residual_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trends.residuals(_series(spark, sf_dir, NAMES, "p_name", False), "drift", NAMES.window)
    out = trends.residual_forecast(found, NAMES.forecast_year, NAMES.window, first_year=1990)
    return out.select(itemsets.label(F.col("items")).alias("itemset"), "size", F.round("predicted_residual", 9).alias("predicted_residual"))


@query(f"""WITH {_residual_sql(NAMES, 'p_name', False, 'drift')}, {_FORECAST}
SELECT itemset, size, round(f, 9) AS predicted_residual FROM fc ORDER BY round(f, 9) DESC, size, string_split(itemset, ' + ') LIMIT {NAMES.top_m}""")
def residual_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trends.residuals(_series(spark, sf_dir, NAMES, "p_name", False), "drift", NAMES.window)
    top = trends.rank_by_residual(trends.residual_forecast(found, NAMES.forecast_year, NAMES.window, first_year=1990), NAMES.top_m)
    return top.select(itemsets.label(F.col("items")).alias("itemset"), "size", F.round("predicted_residual", 9).alias("predicted_residual"))


_TREND = """zt AS (SELECT *, (row_number() OVER (PARTITION BY itemset ORDER BY yr) - 1)::DOUBLE AS t FROM z),
tr AS (SELECT itemset, size, count(*) AS n, list(z ORDER BY yr) AS zs, sum(abs(z)) AS mass, regr_slope(z, t) AS slope, regr_r2(z, t) AS r2 FROM zt GROUP BY itemset, size),
lin AS (SELECT itemset, size, n, CASE WHEN n < 3 THEN true ELSE zs[n] > zs[n - 2] END AS recent,
  CASE WHEN n < 2 OR mass < 1e-10 THEN 0 ELSE coalesce(slope, 0) END AS linear_slope, CASE WHEN n < 2 OR mass < 1e-10 THEN 0 ELSE coalesce(r2, 0) END AS linear_r2 FROM tr)"""


@query(f"WITH {_metrics_sql(NAMES, 'p_name', False)}, {_TREND} SELECT itemset, size, recent, round(linear_slope, 9) + 0 AS linear_slope, round(linear_r2, 6) + 0 AS linear_r2 FROM lin")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trends.linear_trend(_series(spark, sf_dir, NAMES, "p_name", False))
    return found.select(itemsets.label(F.col("items")).alias("itemset"), "size", "recent", (F.round("linear_slope", 9) + F.lit(0.0)).alias("linear_slope"), (F.round("linear_r2", 6) + F.lit(0.0)).alias("linear_r2"))


_RANKED = f"""ranked AS (SELECT itemset, size, 0.5 * linear_slope AS score, row_number() OVER (ORDER BY round(0.5 * linear_slope, 9) DESC, size, string_split(itemset, ' + ')) AS rank
  FROM lin WHERE recent AND 0.5 * linear_slope > 0)"""


@query(f"WITH {_metrics_sql(NAMES, 'p_name', False)}, {_TREND}, {_RANKED} SELECT CAST(rank AS INTEGER) AS rank, itemset, size, round(score, 9) AS trend_score FROM ranked WHERE rank <= {NAMES.top_m}")
def trend_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = trends.rank_by_trend(_series(spark, sf_dir, NAMES, "p_name", False), NAMES)
    return top.select("rank", itemsets.label(F.col("items")).alias("itemset"), "size", F.round("trend_score", 9).alias("trend_score"))


@query()
def trend_ranking_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all three models, as the command line ranks."""
    p = ItemsetConfig(**(vars(TYPES) | {"trend_models": TREND_MODELS}))
    top = trends.rank_by_trend(_series(spark, sf_dir, p, "p_type", True), p)
    return top.select("rank", itemsets.label(F.col("items")).alias("itemset"), "size", "trend_score", "linear_slope", "exp_k", "logistic_k", "model_fit")


@query()
def curve_fit_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = trends.linear_trend(_series(spark, sf_dir, TYPES, "p_type", True))
    found = trends.trend_curves(trend, ("linear", "exponential", "logistic"))
    return found.select(itemsets.label(F.col("items")).alias("itemset"), "size", "linear_slope", "exp_k", "logistic_k", "model_fit", "trend_score")


@query()
def backtest_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = S.basket_papers(spark, sf_dir, "p_type").withColumnRenamed("items", "extracted_keywords")
    return run.backtest_itemsets(papers, ItemsetConfig(**(vars(TYPES) | {"min_year": 1995, "max_year": 2000, "eval_k": 10, "top_m": 5})))


# ---- text and tagging


@query("""SELECT DISTINCT p_brand, p_type, trim(regexp_replace(lower(trim(p_brand || ' / ' || p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return parts.withColumn("slug", X.slugify(F.concat_ws(" / ", "p_brand", "p_type")))


_SEARCH = r"""trim(regexp_replace(regexp_replace(replace(replace(lower(concat_ws(' | ', nullif(trim(coalesce(text, '')), ''), nullif(trim(lang), ''), nullif(trim(source), ''))), '&', ' and '), '/', ' '), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, md5({_SEARCH}) AS digest, length({_SEARCH}) AS n FROM documents")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.search_text([F.col("text"), F.col("lang"), F.col("source")])
    return _read(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


_CELLS = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN to_json([lang, ' ' || source || ' ', '']) WHEN 1 THEN lang || '|' || source || '| ' WHEN 2 THEN lang || '; ' || source WHEN 3 THEN source ELSE '  ' END AS cell, lang, source FROM documents)"""


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN source WHEN 4 THEN '' ELSE lang || '~' || source END AS topics FROM {_CELLS}""")
def parse_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    listed = F.to_json(F.array("lang", F.concat(F.lit(" "), "source", F.lit(" ")), F.lit("")))
    cell = F.when(k == 0, listed).when(k == 1, F.concat_ws("|", "lang", "source", F.lit(" "))).when(k == 2, F.concat_ws("; ", "lang", "source")).when(k == 3, F.col("source")).otherwise("  ")
    return docs.select("doc_id", F.array_join(X.parse_topics(cell), "~").alias("topics"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), (2015 + F.col("doc_id") % 11).cast("string").alias("year"), "text")
    return tagging.tag(docs, X.normalize_for_tagging(F.coalesce("text", F.lit(""))), TEST_TAXONOMY, TEST_PARENTS)


def _re2(p: str) -> str:
    """The patterns as RE2 can say them, alike as a yes or no: no look-around, and word ends that see all letters."""
    p = p.replace("(?<![a-z])", "(^|[^a-z])").replace("(?![a-z])", "([^a-z]|$)")
    p = r"(^|[^\p{L}\p{N}_])" + p[2:] if p.startswith(r"\b") else p
    return p[:-2] + r"([^\p{L}\p{N}_]|$)" if p.endswith(r"\b") else p


_NORM = r"trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce(text, '')), '&', ' and '), '/', ' '), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _tag_sql() -> str:
    hits = ",\n".join(f"({' + '.join(f'regexp_matches(t, {_quote(_re2(p))})::INT' for p in ps)}) AS h{i}" for i, ps in enumerate(TEST_TAXONOMY.values()))
    long = " UNION ALL ".join(f"SELECT doc_id, {_quote(topic)} AS topic, h{i} AS hits FROM hit WHERE h{i} > 0" for i, topic in enumerate(TEST_TAXONOMY))
    anc = ", ".join(f"({_quote(c)}, {_quote(p)})" for c, p in rules.closure(TEST_PARENTS))
    fallback = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {_quote(x)})' for x in terms)} THEN {_quote(topic)}" for topic, terms in rules.FALLBACKS) + f" ELSE {_quote(rules.DEFAULT_TOPIC)} END"
    return f"""norm AS (SELECT doc_id, {_NORM} AS t FROM documents),
hit AS (SELECT doc_id, t, {hits} FROM norm),
direct AS ({long}),
anc(child, parent) AS (VALUES {anc}),
full_ AS (SELECT doc_id, topic, max(hits) AS hits FROM (SELECT * FROM direct UNION ALL SELECT doc_id, parent, 0 FROM direct JOIN anc ON child = topic) GROUP BY 1, 2),
fb AS (SELECT doc_id, {fallback} AS topic FROM norm WHERE doc_id NOT IN (SELECT doc_id FROM direct)),
assigned AS (SELECT doc_id, list(topic ORDER BY hits DESC, topic) AS topics FROM full_ GROUP BY 1 UNION ALL SELECT doc_id, [topic] FROM fb)"""


@query(f"WITH {_tag_sql()} SELECT doc_id, topic, hits FROM direct")
def topic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", X.normalize_for_tagging(F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", F.explode_outer(tagging.topic_hits(F.col("t"), TEST_TAXONOMY)).alias("h")).filter("h IS NOT NULL").select("doc_id", "h.topic", "h.hits")


@query(f"WITH {_tag_sql()} SELECT CAST(doc_id AS VARCHAR) AS paper_id, array_to_string(topics, '~') AS topics, topics[1] AS primary_topic, CAST(len(topics) AS INTEGER) AS num_topics FROM assigned")
def topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("paper_id", F.array_join("assigned_topics", "~").alias("topics"), "primary_topic", "num_topics")


@query(f"WITH {_tag_sql()} SELECT doc_id, topic FROM fb")
def fallback_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", X.normalize_for_tagging(F.coalesce("text", F.lit(""))).alias("t"))
    none = docs.filter(F.size(tagging.topic_hits(F.col("t"), TEST_TAXONOMY)) == 0)
    return none.select("doc_id", tagging.fallback_topic(F.col("t")).alias("topic"))


@query(f"WITH {_tag_sql()} SELECT topics[1] AS primary_topic, count(*) AS n FROM assigned GROUP BY 1")
def primary_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).groupBy("primary_topic").agg(F.count("*").alias("n"))


_TOPICS = [*TEST_TAXONOMY, "Germanic", "Romance", "Language", "Never Assigned"]
_SLUG = "trim(regexp_replace(lower(trim(topic_name)), '[^a-z0-9]+', '_', 'g'), '_')"


@query(f"""WITH {_tag_sql()}, names(topic_name) AS (VALUES {', '.join(f'({_quote(t)})' for t in _TOPICS)}),
c AS (SELECT unnest(topics) AS topic, count(*) AS n FROM assigned GROUP BY 1)
SELECT {_SLUG} AS topic_id, topic_name, coalesce(n, 0) AS paper_count FROM names LEFT JOIN c ON topic = topic_name""")
def topic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.topic_nodes(tagging.incidence(_tagged(spark, sf_dir)), _TOPICS)


@query(f"""WITH {_tag_sql()}, e AS (SELECT doc_id, unnest(topics) AS topic_name FROM assigned)
SELECT CAST(doc_id AS VARCHAR) AS paper_id, {_SLUG} AS topic_id, topic_name, 't' || doc_id AS title, CAST(2015 + doc_id % 11 AS VARCHAR) AS yr FROM e""")
def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.incidence(_tagged(spark, sf_dir)).withColumnRenamed("year", "yr")


@query(f"""WITH {_tag_sql()} SELECT CAST(doc_id AS VARCHAR) AS paper_id, array_to_string(list_transform(topics, lambda x: trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '_', 'g'), '_')), '~') AS topic_ids, topics[1] AS primary_topic FROM assigned""")
def hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.hyperedges(_tagged(spark, sf_dir)).select("paper_id", F.array_join("topic_ids", "~").alias("topic_ids"), "primary_topic")


@query(f"WITH {_tag_sql()} SELECT count(*) AS num_papers, CAST({len(TEST_TAXONOMY)} AS BIGINT) AS num_topics, CAST(sum(len(topics)) AS BIGINT) AS num_incidence_pairs FROM assigned")
def hypergraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.hypergraph_stats(_tagged(spark, sf_dir), len(TEST_TAXONOMY))


# ---- keywords

_DOC_TEXT = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\-\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _stop_sql() -> str:
    return "(" + ", ".join(_quote(w) for w in rules.stopwords()) + ")"


def _tfidf_sql(low: int = 1, high: int = 1, min_df: int = 2, features: int = 20_000) -> str:
    grams = " UNION ALL ".join(f"SELECT row_id, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i+{n}-1], ' '))) AS term FROM words WHERE len(ws) >= {n}" for n in range(low, high + 1))
    return rf"""papers AS (SELECT doc_id AS row_id, CAST(2015 + doc_id % 11 AS INTEGER) AS yr, (n_chars % 500)::DOUBLE AS cit, ['lang ' || lang, 'source ' || source] AS topics, {_DOC_TEXT} AS doc_text FROM documents),
words AS (SELECT row_id, list_filter(regexp_extract_all(doc_text, '\b[a-zA-Z][a-zA-Z0-9\-]{{1,}}\b'), lambda t: t NOT IN {_stop_sql()}) AS ws FROM papers),
grams AS ({grams}),
tc AS (SELECT row_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tc GROUP BY 1 HAVING count(*) >= {min_df} ORDER BY total DESC, term LIMIT {features}),
raw AS (SELECT row_id, term, tf, (1 + ln(tf::DOUBLE)) * (ln((1 + (SELECT count(*) FROM papers)::DOUBLE) / (1 + df::DOUBLE)) + 1) AS r FROM tc JOIN vocab USING (term)),
tfidf AS (SELECT row_id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY row_id)) AS weight FROM raw)"""


def _valid_sql(term: str) -> str:
    return rf"""(len(trim({term})) > 0 AND len(list_filter(string_split({term}, ' '), lambda t: t IN {_stop_sql()})) < len(string_split({term}, ' '))
 AND len(list_filter(string_split({term}, ' '), lambda t: len(t) <= 1)) = 0 AND NOT regexp_full_match({term}, '[0-9]+')
 AND NOT regexp_matches({term}, '{'|'.join(rules.NOISE)}')
 AND len(list_filter(string_split({term}, ' '), lambda t: t IN {_stop_sql()})) / len(string_split({term}, ' ')) <= 0.4
 AND NOT (len(list_filter(string_split({term}, ' '), lambda t: regexp_matches(t, '[0-9]'))) / len(string_split({term}, ' ')) > 0.5 AND len(string_split({term}, ' ')) <= 2)
 AND coalesce(list_sum(list_transform(list_filter(string_split({term}, ' '), lambda t: t IN {_stop_sql()}), lambda t: len(t))), 0) / list_sum(list_transform(string_split({term}, ' '), lambda t: len(t))) <= 0.5)"""


def _normalize_sql(c: str) -> str:
    """A nested expression up to the phrase and plural rules; the list steps follow in _keyword_sql."""
    for p, r in [*rules.PHRASE_RULES]:
        c = f"regexp_replace({c}, {_quote(p)}, {_quote(r)}, 'gi')"
    for s in rules.SINGULARS:
        c = f"regexp_replace({c}, {_quote(rf'{chr(92)}b{s}s?{chr(92)}b')}, {_quote(s)}, 'g')"
    return c


def _keyword_sql(source: str, column: str, name: str = "nk") -> str:
    """name(term, keyword) for the distinct values of a column."""
    venues = "(" + ", ".join(_quote(v) for v in rules.VENUES) + ")"
    variant = " OR ".join(f"(suffix(t, {_quote(s)}) AND t <> {_quote(s)} AND len(rtrim(t[1:len(t) - {len(s)}], '-_')) > 2)" for s in rules.DROPPED_SUFFIXES)
    return rf"""{name}0 AS (SELECT DISTINCT {column} AS term, regexp_replace(lower(trim({column})), '\b(\w+)ss\b', '\1s', 'g') AS k FROM {source}),
{name}1 AS (SELECT term, CASE WHEN len(list_filter(string_split(k, ' '), lambda t: t IN {venues})) > 0 THEN array_to_string(list_filter(string_split(k, ' '), lambda t: t NOT IN {venues}), ' ') ELSE k END AS k FROM {name}0),
{name}2 AS (SELECT term, {_normalize_sql('k')} AS k FROM {name}1),
{name}3 AS (SELECT term, list_filter(regexp_split_to_array(k, '\s+'), lambda t: t <> '') AS ts FROM {name}2),
{name}4 AS (SELECT term, ts, list_filter(ts, lambda t: NOT ({variant})) AS kept FROM {name}3),
{name}5 AS (SELECT term, CASE WHEN len(kept) > 0 THEN kept ELSE ts END AS ts FROM {name}4),
{name}6 AS (SELECT term, array_to_string(list_transform(list_filter(range(1, len(ts) + 1), lambda i: i = 1 OR ts[i] <> ts[i - 1]), lambda i: ts[i]), ' ') AS k FROM {name}5),
{name} AS (SELECT term, CASE WHEN k IN {_stop_sql()} THEN '' ELSE k END AS keyword FROM {name}6)"""


def _top_sql(top: int = 5) -> str:
    return f"""ok AS (SELECT term FROM vocab WHERE {_valid_sql('term')}),
top AS (SELECT * FROM (SELECT row_id, term, weight, row_number() OVER (PARTITION BY row_id ORDER BY round(weight, 9) DESC, term) AS rank FROM tfidf JOIN ok USING (term)) WHERE rank <= {top})"""


@query(f"WITH {_tfidf_sql()} SELECT term, df, CAST(total AS BIGINT) AS total FROM vocab")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.vocabulary(keywords.term_counts(S.document_papers(spark, sf_dir)), 2, 20_000)


def _top_rows(weights: DataFrame) -> DataFrame:
    found = keywords.top_keywords(weights, 5, normalize=False)
    return found.select(F.col("row_id").alias("doc_id"), "rank", "term", F.round("score", 6).alias("score"))


@query(f"WITH {_tfidf_sql()}, {_top_sql()} SELECT row_id AS doc_id, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS score FROM top")
def tfidf_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_rows(keywords.tfidf(S.document_papers(spark, sf_dir)))


@query(f"WITH {_tfidf_sql(1, 3)}, {_top_sql()} SELECT row_id AS doc_id, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS score FROM top")
def tfidf_top_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_rows(keywords.tfidf(S.document_papers(spark, sf_dir), ngrams=(1, 2, 3)))


#: Phrases that reach every step of the normal form.
PHRASES = (
    "fairness|query processing|support vector machines|deep rl|icml|attention-based networks|knowledge-based|large language models|text-to-image diffusion|"
    "convolutional neural networks|sql query|icml learning systems|retrieval augmented|autoencoders scalable|graph networks networks|class models|rl|transformer layers|"
    "variational autoencoder|explainability|fair machine learning|gpt|bert models|remote imagery|software|mdp|self attention|data|small-scale datasets|cost-efficient filters"
).split("|")
_PHRASED = f"(SELECT DISTINCT p_type, list_extract([{', '.join(_quote(x) for x in PHRASES)}], CAST(p_partkey % {len(PHRASES)} + 1 AS INTEGER)) AS phrase, p_partkey % 3 AS k FROM part)"
_PHRASE = f"(SELECT DISTINCT CASE k WHEN 0 THEN phrase WHEN 1 THEN phrase || ' ' || lower(p_type) ELSE lower(p_type) || ' ' || phrase END AS term FROM {_PHRASED})"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    k, kind = F.col("p_partkey") % 3, F.lower("p_type")
    return _read(spark, sf_dir, "part").select(F.when(k == 0, phrase).when(k == 1, F.concat_ws(" ", phrase, kind)).otherwise(F.concat_ws(" ", kind, phrase)).alias("term")).distinct()


@query(f"WITH {_keyword_sql(_PHRASE, 'term')} SELECT term, keyword FROM nk")
def normalized_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("term", X.normalize_keyword(F.col("term")).alias("keyword"))


@query(f"SELECT term, {_valid_sql('term')} AS valid FROM {_PHRASE}")
def valid_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("term", X.valid_phrase(F.col("term")).alias("valid"))


def _scores_sql(p: KeywordConfig) -> str:
    return f"""{_tfidf_sql()}, {_top_sql(p.top_keywords_per_paper)}, {_keyword_sql('top', 'term')},
kw AS (SELECT row_id, keyword, weight FROM top JOIN nk USING (term)),
each_ AS (SELECT kw.row_id, topics, keyword,
  CASE WHEN yr BETWEEN {p.window_start} AND {p.window_end} THEN weight * ((1 + (yr - {p.window_start}) / {float(p.window_end - p.window_start)}::DOUBLE) * (ln(1 + greatest(cit, 0)) + 1)) ELSE 0 END AS w,
  CASE WHEN yr = {p.target_year} THEN weight * (ln(1 + greatest(cit, 0)) + 1) ELSE 0 END AS t
  FROM kw JOIN papers ON papers.row_id = kw.row_id WHERE yr BETWEEN {p.window_start} AND {p.window_end} OR yr = {p.target_year}),
tot AS (SELECT keyword, sum(w) AS gw, sum(t) AS gt FROM each_ GROUP BY 1),
bt AS (SELECT topic, keyword, sum(w) AS ww, sum(t) AS tw FROM (SELECT unnest(topics) AS topic, keyword, w, t FROM each_) GROUP BY 1, 2),
tp AS (SELECT topic, CAST(count(*) FILTER (WHERE yr BETWEEN {p.window_start} AND {p.window_end}) AS BIGINT) AS wp, CAST(count(*) FILTER (WHERE yr = {p.target_year}) AS BIGINT) AS tpn
  FROM (SELECT yr, unnest(topics) AS topic FROM papers) WHERE yr BETWEEN {p.window_start} AND {p.window_end} OR yr = {p.target_year} GROUP BY 1),
f AS (SELECT bt.topic, bt.keyword, ww, tw, gw, gt, wp, tpn,
  ln((ww / (sum(ww) OVER (PARTITION BY bt.topic) + 1e-9) + 1e-9) / (gw / ((SELECT sum(gw) FROM tot) + 1e-9) + 1e-9)) AS spec,
  ln(1 + tw) - ln(1 + ww) AS trend, ln(1 + ww) AS strength, ln(1 + tw) AS cont
  FROM bt JOIN tot ON tot.keyword = bt.keyword LEFT JOIN tp ON tp.topic = bt.topic),
s AS (SELECT *, {', '.join(f"CASE WHEN stddev_pop({c}) OVER w < 1e-12 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS z_{c}" for c in ('spec', 'trend', 'strength', 'cont'))}
  FROM f WINDOW w AS (PARTITION BY topic)),
sc AS (SELECT *, 0.4 * z_strength + 0.3 * z_spec + 0.2 * z_cont + 0.1 * z_trend AS inf FROM s)"""


def _doc_keywords(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    papers = S.document_papers(spark, sf_dir)
    return papers, cut(keywords.top_keywords(keywords.tfidf(papers), SCORES.top_keywords_per_paper))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.influence(*_doc_keywords(spark, sf_dir), SCORES)


@query(f"WITH {_scores_sql(SCORES)} SELECT keyword, round(gw, 6) AS window_weight, round(gt, 6) AS target_weight FROM tot")
def keyword_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = keywords.contributions(*_doc_keywords(spark, sf_dir), SCORES)
    return each.groupBy("keyword").agg(F.round(F.sum("w"), 6).alias("window_weight"), F.round(F.sum("t"), 6).alias("target_weight"))


_SCORE_COLUMNS = {"window_weight": "ww", "target_weight": "tw", "global_window_weight": "gw", "global_target_weight": "gt", "topic_specificity": "spec", "trend_ratio": "trend", "raw_strength": "strength", "continuity": "cont", "z_strength": "z_strength", "z_specificity": "z_spec", "z_continuity": "z_cont", "z_trend": "z_trend", "influence_score": "inf"}


@query(f"WITH {_scores_sql(SCORES)} SELECT topic, keyword, {', '.join(f'round({v}, 6) + 0 AS {k}' for k, v in _SCORE_COLUMNS.items())}, wp AS topic_window_papers, tpn AS topic_target_papers FROM sc")
def keyword_topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("topic", "keyword", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _SCORE_COLUMNS], "topic_window_papers", "topic_target_papers")


_BEST = "(SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(inf, 6) DESC, keyword) AS rank FROM sc)"


@query(f"WITH {_scores_sql(SCORES)} SELECT topic, CAST(rank AS INTEGER) AS rank, keyword FROM {_BEST} WHERE rank <= 10")
def top_keywords_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.top_per_topic(_scores(spark, sf_dir), 10).select("topic", "rank", "keyword")


@query(f"""WITH {_scores_sql(SCORES)} SELECT topic, max(wp) AS num_window_papers, max(tpn) AS num_target_papers, string_agg(keyword, '~' ORDER BY rank) AS top_keywords FROM {_BEST} WHERE rank <= 15 GROUP BY 1""")
def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.topic_summary(_scores(spark, sf_dir))
    return found.select("topic", "num_window_papers", "num_target_papers", F.array_join("top_keywords", "~").alias("top_keywords"))


# ---- snapshots and the hypergraph

_BRANDS = """papers AS (SELECT o_orderkey AS row_id, CAST(year(o_orderdate) AS INTEGER) AS yr, o_totalprice AS cit FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
links AS (SELECT DISTINCT row_id, yr, cit, p_brand AS topic FROM papers JOIN lineitem ON l_orderkey = row_id JOIN part ON l_partkey = p_partkey),
cnt AS (SELECT yr, topic, count(*) AS n, sum(ln(1 + greatest(cit, 0))) AS cs FROM links GROUP BY 1, 2),
grid AS (SELECT t.topic, y.yr FROM (SELECT DISTINCT topic FROM cnt) t, (SELECT DISTINCT yr FROM cnt) y),
yc AS (SELECT grid.topic, grid.yr, coalesce(n, 0) AS n, coalesce(cs, 0) AS cs FROM grid LEFT JOIN cnt ON cnt.topic = grid.topic AND cnt.yr = grid.yr),
sn AS (SELECT *, lag(n, 1, 0) OVER w AS prev, CAST(sum(n) OVER (PARTITION BY topic ORDER BY yr ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM yc WINDOW w AS (PARTITION BY topic ORDER BY yr)),
ft AS (SELECT *, ln(1 + prev::DOUBLE) AS f1, ln(1 + n::DOUBLE) - ln(1 + prev::DOUBLE) AS f2, 1.0::DOUBLE AS f3 FROM sn)"""


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.basket_papers(spark, sf_dir)


@query(f"WITH {_BRANDS} SELECT topic, CAST(row_number() OVER (ORDER BY topic) - 1 AS INTEGER) AS topic_index FROM (SELECT DISTINCT topic FROM links)")
def topic_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.topic_vocabulary(_brands(spark, sf_dir))


@query(f"WITH {_BRANDS} SELECT yr, topic, n FROM yc")
def yearly_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.yearly_counts(_brands(spark, sf_dir)).select(F.col("year").alias("yr"), "topic", F.col("count").alias("n"))


@query(f"WITH {_BRANDS} SELECT yr, topic, round(cs, 6) AS citation_sum FROM yc")
def citation_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.yearly_counts(_brands(spark, sf_dir)).select(F.col("year").alias("yr"), "topic", F.round("citation_sum", 6).alias("citation_sum"))


@query(f"WITH {_BRANDS} SELECT yr, topic, cum AS cumulative FROM sn")
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshots(_brands(spark, sf_dir)).select(F.col("year").alias("yr"), "topic", "cumulative")


@query(f"WITH {_BRANDS} SELECT yr, topic, prev AS prev_count, round(f2, 9) + 0 AS growth FROM ft")
def topic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshots(_brands(spark, sf_dir)).select(F.col("year").alias("yr"), "topic", F.col("prev_count").cast("long"), (F.round("f_growth", 9) + F.lit(0.0)).alias("growth"))


@query(f"WITH {_BRANDS} SELECT yr, topic, round(f1, 9) AS f_log_prev, round(f2, 9) + 0 AS f_growth, f3 AS f_const FROM ft")
def snapshot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshots(_brands(spark, sf_dir)).select(F.col("year").alias("yr"), "topic", F.round("f_log_prev", 9).alias("f_log_prev"), (F.round("f_growth", 9) + F.lit(0.0)).alias("f_growth"), "f_const")


_WINDOWS = f"""{_BRANDS}, wd AS (SELECT topic, yr AS target_year, n AS truth, list(yr) OVER w AS ys, list(f1) OVER w AS l1, list(f2) OVER w AS l2, list(n) OVER w AS ns FROM ft WINDOW w AS (PARTITION BY topic ORDER BY yr ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
ws AS (SELECT * FROM wd WHERE len(ys) = 3 AND ys[1] = target_year - 3 AND ys[3] = target_year - 1)"""


def _samples(spark: SparkSession, sf_dir: str, mode: str = "count") -> DataFrame:
    return snapshots.window_samples(snapshots.snapshots(_brands(spark, sf_dir)), 3, mode)


@query(f"WITH {_WINDOWS} SELECT target_year, topic, round(list_sum(l1), 6) AS sum_log_prev, round(list_sum(l2), 6) + 0 AS sum_growth, round(ln(1 + truth::DOUBLE), 9) AS y FROM ws")
def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda f: F.aggregate("features", F.lit(0.0), lambda s, x: s + x[f])
    return _samples(spark, sf_dir).select("target_year", "topic", F.round(total("f1"), 6).alias("sum_log_prev"), (F.round(total("f2"), 6) + F.lit(0.0)).alias("sum_growth"), F.round("y", 9).alias("y"))


@query(f"WITH {_WINDOWS} SELECT target_year, topic, (truth > 0)::INT::DOUBLE AS y, CASE WHEN target_year = 2001 THEN 'predict' WHEN target_year = (SELECT max(target_year) FROM ws WHERE target_year < 2001) THEN 'validation' ELSE 'train' END AS part FROM ws WHERE target_year <= 2001")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.split(_samples(spark, sf_dir, "binary"), 2001).select("target_year", "topic", "y", "part")


@query(f"WITH {_BRANDS} SELECT yr, topic, count(*) AS dv FROM links GROUP BY 1, 2")
def hypergraph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    dv, _ = hypergraph.degrees(snapshots.topic_incidence(_brands(spark, sf_dir)))
    return dv.select(F.col("year").alias("yr"), "topic", "dv")


THETA, BIAS = ((0.5, -0.25), (1.0, 0.75), (0.1, -0.2)), (0.05, 0.3)


@query(f"""WITH {_BRANDS}, dv AS (SELECT yr, topic, count(*) AS d FROM links GROUP BY 1, 2), de AS (SELECT yr, row_id, count(*) AS d FROM links GROUP BY 1, 2),
x AS ({' UNION ALL '.join(f"SELECT yr, topic, {k} AS k, f1 * {THETA[0][k]}::DOUBLE + f2 * {THETA[1][k]}::DOUBLE + f3 * {THETA[2][k]}::DOUBLE + {BIAS[k]}::DOUBLE AS x FROM ft" for k in range(2))}),
sx AS (SELECT x.*, 1 / sqrt(greatest(coalesce(d, 0), 1)::DOUBLE) AS s FROM x LEFT JOIN dv ON dv.yr = x.yr AND dv.topic = x.topic),
em AS (SELECT l.yr, l.row_id, k, sum(x * s) AS m FROM links l JOIN sx ON sx.yr = l.yr AND sx.topic = l.topic GROUP BY 1, 2, 3),
bk AS (SELECT l.yr, l.topic, k, sum(m / greatest(d, 1)) AS m FROM links l JOIN em ON em.yr = l.yr AND em.row_id = l.row_id JOIN de ON de.yr = l.yr AND de.row_id = l.row_id GROUP BY 1, 2, 3)
SELECT sx.yr, sx.topic, sx.k, round(coalesce(m, 0) * s, 6) + 0 AS y FROM sx LEFT JOIN bk ON bk.yr = sx.yr AND bk.topic = sx.topic AND bk.k = sx.k""")
def hypergraph_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _brands(spark, sf_dir)
    x = hypergraph.projected(snapshots.snapshots(papers), THETA, BIAS)
    out = hypergraph.convolve(x, snapshots.topic_incidence(papers))
    return out.select(F.col("year").alias("yr"), "topic", "k", (F.round("y", 6) + F.lit(0.0)).alias("y"))


# ---- forecasts and metrics

_NAIVE = "pr AS (SELECT target_year, topic, ns[3]::DOUBLE AS prediction, truth::DOUBLE AS ground_truth FROM ws)"
_DRIFT = "pr AS (SELECT target_year, topic, greatest(ns[3] + (ns[3] - ns[1]) / 2.0::DOUBLE, 0) AS prediction, truth::DOUBLE AS ground_truth FROM ws)"
_FORECAST_ROWS = "SELECT target_year, topic, round(prediction, 6) AS prediction, ground_truth, round(prediction - ground_truth, 4) + 0 AS prediction_error FROM pr"


def _forecast_rows(df: DataFrame) -> DataFrame:
    return metrics.signed_error(df).select("target_year", "topic", F.round("prediction", 6).alias("prediction"), "ground_truth", (F.col("prediction_error") + F.lit(0.0)).alias("prediction_error"))


@query(f"WITH {_WINDOWS}, {_NAIVE} {_FORECAST_ROWS}")
def naive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast_rows(forecast.naive(_samples(spark, sf_dir)))


@query(f"WITH {_WINDOWS}, {_DRIFT} {_FORECAST_ROWS}")
def drift_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast_rows(forecast.drift(_samples(spark, sf_dir)))


@query(f"""WITH {_WINDOWS}, {_DRIFT}, r AS (SELECT *, row_number() OVER (PARTITION BY target_year ORDER BY round(prediction, 9) DESC, topic) AS k FROM pr)
SELECT target_year, avg((ground_truth > 0)::INT::DOUBLE) AS precision FROM r WHERE k <= 5 GROUP BY 1""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision_at(forecast.drift(_samples(spark, sf_dir)), 5, ("target_year",))


@query(f"""WITH {_WINDOWS}, {_DRIFT}, r AS (SELECT *, ln(1 + ground_truth) AS g, row_number() OVER (PARTITION BY target_year ORDER BY round(prediction, 9) DESC, topic) AS k,
row_number() OVER (PARTITION BY target_year ORDER BY ln(1 + ground_truth) DESC, topic) AS i FROM pr)
SELECT target_year, round(sum(CASE WHEN k <= 10 THEN g / log2(k + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END), 9) AS ndcg FROM r GROUP BY 1""")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg_at(forecast.drift(_samples(spark, sf_dir)), 10, ("target_year",)).withColumn("ndcg", F.round("ndcg", 9))


@query(f"""WITH {_WINDOWS}, {_DRIFT} SELECT target_year, round(avg((prediction - ground_truth) ** 2), 6) AS mse, round(avg(abs(prediction - ground_truth)), 6) AS mae, round(sqrt(avg((prediction - ground_truth) ** 2)), 6) AS rmse FROM pr GROUP BY 1""")
def forecast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.losses(forecast.drift(_samples(spark, sf_dir)), ("target_year",)).select("target_year", *[F.round(c, 6).alias(c) for c in ("mse", "mae", "rmse")])


@query()
def gru_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    model = forecast.train(samples, ForecastConfig(predict_year=2001, window_size=3, epochs=40))
    return forecast.predict(model, samples.filter("target_year = 2001"))


@query()
def next_year_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = snapshots.window_samples(snapshots.snapshots(_brands(spark, sf_dir)), 3, with_future=True)
    model = forecast.train(samples, ForecastConfig(predict_year=2002, window_size=3, epochs=20))
    return forecast.predict(model, samples.filter("target_year = 2002"))


# ---- reports

_SOURCES = """src AS (SELECT 'source ' || source AS topic, count(*) FILTER (WHERE doc_id % 11 <> 9)::DOUBLE AS prediction, count(*) FILTER (WHERE doc_id % 11 = 9)::DOUBLE AS ground_truth FROM documents GROUP BY 1),
tops AS (SELECT *, row_number() OVER (ORDER BY round(prediction, 9) DESC, topic) AS rank FROM src)"""


def _source_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.col("doc_id") % 11 == 9
    return _read(spark, sf_dir, "documents").groupBy(F.concat(F.lit("source "), "source").alias("topic")).agg(F.sum((~target).cast("double")).alias("prediction"), F.sum(target.cast("double")).alias("ground_truth"))


_TOLD = f"told AS (SELECT tops.rank, tops.topic, prediction, ground_truth, b.rank AS keyword_rank, keyword, inf, wp, tpn FROM tops JOIN {_BEST} b ON b.topic = tops.topic WHERE tops.rank <= 5 AND b.rank <= 5)"


@query(f"""WITH {_scores_sql(SCORES)}, {_SOURCES}, {_TOLD}
SELECT CAST(rank AS INTEGER) AS rank, topic, prediction, round(prediction - ground_truth, 4) AS prediction_error, CAST(keyword_rank AS INTEGER) AS keyword_rank, keyword, wp AS window_papers, tpn AS target_papers FROM told""")
def interpret_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.interpret(_source_predictions(spark, sf_dir), _scores(spark, sf_dir))
    return told.select("rank", "topic", "prediction", "prediction_error", "keyword_rank", "keyword", "window_papers", "target_papers")


#: Keyword itemsets of documents by year, as the plan mines them.
DOC_SETS = ItemsetConfig(min_year=2015, max_year=2025, forecast_year=2026, df_min_count=2, df_max_frac=0.5, minsup_frac=0.001, min_count=2, min_lift=1.0, top_m=5)
_DOC_TX = f"""kx AS (SELECT DISTINCT kw.row_id, yr, keyword AS item FROM kw JOIN papers ON papers.row_id = kw.row_id),
kd AS (SELECT item FROM kx GROUP BY 1 HAVING count(*) >= {DOC_SETS.df_min_count} AND count(*) <= floor({DOC_SETS.df_max_frac}::DOUBLE * (SELECT count(DISTINCT row_id) FROM kx)::DOUBLE)),
kt AS (SELECT kx.* FROM kx JOIN kd USING (item)),
kn AS (SELECT yr, count(DISTINCT row_id) AS n FROM kt GROUP BY 1),
kp AS (SELECT x.yr, x.item AS a, y.item AS b, count(*) AS cnt FROM kt x JOIN kt y ON x.row_id = y.row_id AND x.item < y.item GROUP BY 1, 2, 3),
ks AS (SELECT a, b, sum(cnt) AS total FROM kp JOIN kn ON kn.yr = kp.yr WHERE cnt >= greatest({DOC_SETS.min_count}, ceil({DOC_SETS.minsup_frac}::DOUBLE * n::DOUBLE)) GROUP BY 1, 2),
kr AS (SELECT a, b, total, row_number() OVER (ORDER BY total DESC, a, b) AS rank FROM ks)"""


def _doc_itemsets(spark: SparkSession, sf_dir: str, words: DataFrame, papers: DataFrame) -> DataFrame:
    """rank, items, score: the keyword pairs most often strong together over the years."""
    listed = words.groupBy("row_id").agg(F.sort_array(F.collect_set("keyword")).alias("items")).join(papers.select("row_id", "year"), "row_id")
    p = DOC_SETS
    tx = itemsets.transactions(listed, itemsets.df_band(listed, p.df_min_count, p.df_max_frac))
    loose = ItemsetConfig(**(vars(p) | {"min_lift": 0.0}))
    found = itemsets.frequent_pairs(tx, loose, long_rows=True).groupBy("a", "b").agg(F.sum("count").alias("score"))
    top = found.orderBy(F.desc("score"), "a", "b").limit(p.top_m)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "a", "b"))).select("rank", F.array("a", "b").alias("items"), F.col("score").cast("double").alias("score"))


_SETS = f"""sets AS (SELECT coalesce(x.keyword, y.keyword) AS keyword, CASE WHEN y.keyword IS NULL THEN 'topic_only' WHEN x.keyword IS NULL THEN 'itemset_only' ELSE 'both' END AS part
FROM (SELECT DISTINCT keyword FROM told) x FULL JOIN (SELECT DISTINCT unnest([a, b]) AS keyword FROM kr WHERE rank <= {DOC_SETS.top_m}) y ON x.keyword = y.keyword)"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    papers, words = _doc_keywords(spark, sf_dir)
    told = reports.interpret(_source_predictions(spark, sf_dir), keywords.influence(papers, words, SCORES))
    return told, _doc_itemsets(spark, sf_dir, words, papers)


@query(f"WITH {_scores_sql(SCORES)}, {_SOURCES}, {_TOLD}, {_DOC_TX}, {_SETS} SELECT keyword, part FROM sets")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, sets = _both(spark, sf_dir)
    return reports.keyword_sets(told, sets.select(F.explode("items").alias("keyword")))


@query(f"""WITH {_scores_sql(SCORES)}, {_SOURCES}, {_TOLD}, {_DOC_TX}, {_SETS} SELECT CAST(count(*) FILTER (WHERE part = 'both') AS BIGINT) AS intersection_count, CAST(count(*) FILTER (WHERE part = 'topic_only') AS BIGINT) AS topic_only_count,
CAST(count(*) FILTER (WHERE part = 'itemset_only') AS BIGINT) AS itemset_only_count, count(*) AS total_unique_keywords FROM sets""")
def combined_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, sets = _both(spark, sf_dir)
    return reports.overlap_counts(reports.keyword_sets(told, sets.select(F.explode("items").alias("keyword"))))


@query(f"""WITH {_scores_sql(SCORES)}, {_SOURCES}, {_DOC_TX} SELECT CAST(coalesce(t.rank, k.rank) AS INTEGER) AS rank, t.topic, t.prediction, a || ' + ' || b AS itemset, total::DOUBLE AS score
FROM (SELECT * FROM tops WHERE rank <= 5) t FULL JOIN (SELECT * FROM kr WHERE rank <= {DOC_SETS.top_m}) k ON t.rank = k.rank""")
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, sets = _both(spark, sf_dir)
    return reports.compare_methods(told.select("rank", "topic", "prediction").distinct(), sets)


@query(f"""WITH {_tfidf_sql()}, {_top_sql()}, ind(keyword, t) AS (SELECT term, 'lang ' || l FROM (SELECT term FROM vocab WHERE length(term) <= 4), (VALUES ('en'), ('de')) x(l))
SELECT row_id AS doc_id, t AS suggested_addition, string_agg(DISTINCT top.term, '~' ORDER BY top.term) AS matching_keywords FROM top JOIN ind ON ind.keyword = top.term JOIN papers USING (row_id) WHERE NOT list_contains(topics, t) GROUP BY 1, 2""")
def topic_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = S.document_papers(spark, sf_dir)
    weights = keywords.tfidf(papers)
    words = keywords.top_keywords(weights, 5, normalize=False)
    short = [r["term"] for r in keywords.vocabulary(keywords.term_counts(papers), 2, 20_000).filter(F.length("term") <= 4).collect()]  # an indicator list, max_features terms at most
    found = reports.mismatches(papers, words, {"lang en": short, "lang de": short})
    return found.select(F.col("row_id").alias("doc_id"), "suggested_addition", F.array_join("matching_keywords", "~").alias("matching_keywords"))


@query("""SELECT 'nodes' AS section, 'all' AS key, count(*) AS n FROM documents UNION ALL SELECT 'year', CAST(2015 + doc_id % 11 AS VARCHAR), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'edges', 'all', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return reports.corpus_profile(S.document_papers(spark, sf_dir), edges)


@query("""SELECT node, CAST(sum(o) AS BIGINT) AS cites, CAST(sum(i) AS BIGINT) AS cited FROM (SELECT CAST(l_suppkey AS VARCHAR) || 's' AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT CAST(l_partkey AS VARCHAR) || 'p', 0, 1 FROM lineitem) GROUP BY 1""")
def citation_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, s: F.concat(F.col(c).cast("string"), F.lit(s))
    return reports.citation_degrees(_read(spark, sf_dir, "lineitem").select(name("l_suppkey", "s").alias("src"), name("l_partkey", "p").alias("dst")))


@query("SELECT date_trunc('day', ts) AS start, event_type AS topic, count(*) AS count, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.windowed_counts(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""WITH t AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS d, event_type FROM events)
SELECT x.d AS start, x.event_type AS a, y.event_type AS b, count(*) AS count FROM t x JOIN t y ON x.user_id = y.user_id AND x.d = y.d AND x.event_type < y.event_type GROUP BY 1, 2, 3""")
def event_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("ts")).agg(F.sort_array(F.collect_set("event_type")).alias("items"))
    return streaming.windowed_pairs(days)


@query("""WITH t AS (SELECT DISTINCT user_id, CAST(extract(day FROM ts) AS INTEGER) AS yr, event_type FROM events)
SELECT x.yr, x.event_type AS a, y.event_type AS b, count(*) AS cnt FROM t x JOIN t y ON x.user_id = y.user_id AND x.yr = y.yr AND x.event_type < y.event_type GROUP BY 1, 2, 3""")
def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _read(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("yr")).agg(F.sort_array(F.collect_set("event_type")).alias("items"))
    rows = days.select("yr", F.explode(itemsets.pairs_of(F.col("items"))).alias("p"))
    return rows.groupBy("yr", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("cnt"))
