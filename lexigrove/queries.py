"""Queries of the retrieval and ranking operators over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .functions import text as tx
from .functions.quantities import COMPARED
from .operators import constraints, evaluate, fusion, pivots, products, retrieval, tree, views
from .operators.scorers import TableScorer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = store.tidy(f)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


# --- tokens and term statistics -------------------------------------------------------------------

_TOKENS = "list_filter(regexp_extract_all(lower(replace(replace(replace({t}, chr(160), ' '), 'ё', 'е'), 'Ё', 'Е')), '[а-яёa-z0-9]+(?:[.,][0-9]+)?'), lambda t: length(t) > 1)"
_GRAMS = (
    "flatten(list_transform(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform([3, 4, 5], lambda n: "
    "CASE WHEN length(w) + 2 >= n THEN list_transform(range(1, length(w) + 4 - n), lambda i: substr(' ' || w || ' ', i, n)) ELSE [] END))))"
)


def _tf(side: str, key: str, name: str, terms: str) -> str:
    return f"{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT {key} AS id, unnest({terms.format(t='text')}) AS term FROM {side}) GROUP BY 1, 2)"


def _tfidf_sql(leg: str, terms: str, queries: str = "benchmark") -> str:
    """CTEs ending in ``leg`` (query_id, doc_id, score)."""
    return f"""
{_tf("documents", "doc_id", f"{leg}_d", terms)}, {_tf(queries, "item_id", f"{leg}_q", terms)},
{leg}_idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM {leg}_d GROUP BY 1),
{leg}_dw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM {leg}_d JOIN {leg}_idf USING (term)),
{leg}_qw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM {leg}_q JOIN {leg}_idf USING (term)),
{leg}_dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM {leg}_dw GROUP BY 1), {leg}_qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM {leg}_qw GROUP BY 1),
{leg}_dot AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS s FROM {leg}_qw q JOIN {leg}_dw d USING (term) GROUP BY 1, 2),
{leg} AS (SELECT query_id, doc_id, s / ({leg}_dn.n * {leg}_qn.n) AS score FROM {leg}_dot JOIN {leg}_dn ON doc_id = {leg}_dn.id JOIN {leg}_qn ON query_id = {leg}_qn.id)"""


_BM25_SQL = f"""
{_tf("documents", "doc_id", "b_d", _TOKENS)}, {_tf("benchmark", "item_id", "b_q", _TOKENS)},
b_raw AS (SELECT term, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM b_d GROUP BY 1),
b_idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM b_raw) ELSE raw END AS idf FROM b_raw),
b_len AS (SELECT id, sum(tf) AS dl FROM b_d GROUP BY 1), b_avg AS (SELECT sum(dl) / (SELECT count(*) FROM documents) AS avgdl FROM b_len),
bm25 AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.tf * idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM b_q q JOIN b_idf USING (term) JOIN b_d d USING (term) JOIN b_len ON d.id = b_len.id, b_avg GROUP BY 1, 2)"""


def _rank_sql(leg: str, name: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {leg})"


def _rank_all_sql(leg: str, name: str) -> str:
    """Ranks of all pairs, those without a common term included."""
    pairs = "(SELECT item_id AS query_id, doc_id FROM benchmark, documents)"
    return f"{name} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, doc_id) AS rank FROM {pairs} LEFT JOIN {leg} USING (query_id, doc_id))"


def _top_sql(ctes: str, leg: str) -> str:
    return f"WITH {ctes}, {_rank_sql(leg, 'ranks')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranks WHERE rank <= 10"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")


def _legs(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, products.Leg]:
    queries, docs = _sides(spark, sf_dir)
    asked = queries.select(F.col("item_id").alias("query_id"), "text")
    return retrieval.text_legs(asked, docs, "text", retrieval.corpus_size(docs), {name: ("char" if name == "char" else "word", name == "bm25") for name in names})


def _leg(spark: SparkSession, sf_dir: str, name: str) -> products.Leg:
    return _legs(spark, sf_dir, [name])[name]


def _top(spark: SparkSession, sf_dir: str, name: str, k: int) -> DataFrame:
    return retrieval.top(products.best(_leg(spark, sf_dir, name), k), k)


def _top10(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _top(spark, sf_dir, name, 10).select("query_id", "doc_id", "rank", rounded("score"))


@query(f"SELECT doc_id, len({_TOKENS.format(t='text')})::BIGINT AS n_tokens, array_to_string({_TOKENS.format(t='text')}, ' ') AS tokens FROM documents")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tx.tokenise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query(f"WITH {_tf('documents', 'doc_id', 'd', _TOKENS)} SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM d GROUP BY 1")
def token_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = retrieval.term_statistics(docs, "doc_id", "text", "word")
    return retrieval.smoothed(counts, retrieval.corpus_size(docs)).select("term", "df", rounded("idf"))


@query(f"WITH {_tf('documents', 'doc_id', 'd', _GRAMS)} SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM d GROUP BY 1")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", "char")


@query(_top_sql(_tfidf_sql("word", _TOKENS), "word"))
def tfidf_word_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top10(spark, sf_dir, "word")


@query(_top_sql(_tfidf_sql("chars", _GRAMS), "chars"))
def tfidf_char_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top10(spark, sf_dir, "char")


@query(_top_sql(_BM25_SQL, "bm25"))
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top10(spark, sf_dir, "bm25")


# --- fusion ---------------------------------------------------------------------------------------


def _fused_sql(legs: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, {w} / (60 + rank) AS part FROM r_{leg}" for leg, w in legs)
    return f"fused AS (SELECT query_id, doc_id, sum(part) AS score FROM ({union}) GROUP BY 1, 2)"


_ALL_LEGS = f"{_tfidf_sql('word', _TOKENS)}, {_tfidf_sql('chars', _GRAMS)}, {_BM25_SQL}, {_rank_all_sql('word', 'r_word')}, {_rank_all_sql('chars', 'r_chars')}, {_rank_all_sql('bm25', 'r_bm25')}"
_TWO_LEGS = f"{_tfidf_sql('word', _TOKENS)}, {_tfidf_sql('chars', _GRAMS)}, {_rank_all_sql('word', 'r_word')}, {_rank_all_sql('chars', 'r_chars')}"


def _fused(spark: SparkSession, sf_dir: str, weights: dict[str, float]) -> DataFrame:
    """The ten best by the legs' ranks of all pairs, those without a common term included."""
    queries, docs = _sides(spark, sf_dir)
    legs = _legs(spark, sf_dir, list(weights))
    found = fusion.best_fused(legs, weights, queries.select(F.col("item_id").alias("query_id")), docs.select("doc_id"), 10, digits=9, depth=fusion.FAR)
    return found.select("query_id", "doc_id", "rank", rounded("score"))


@query(_top_sql(f"{_ALL_LEGS}, {_fused_sql([('chars', 1.0), ('word', 1.0), ('bm25', 1.0)])}", "fused"))
def rrf_fused_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, {"char": 1.0, "word": 1.0, "bm25": 1.0})


@query(_top_sql(f"{_TWO_LEGS}, {_fused_sql([('chars', 3.0), ('word', 1.0)])}", "fused"))
def rrf_weighted_3_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, {"char": 3.0, "word": 1.0})


# What the jobs write, for the registered queries that run them.
MATCHED_SQL = f"""WITH {_TWO_LEGS}, {_fused_sql([('chars', 3.0), ('word', 1.0)])},
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, doc_id) AS rank FROM fused),
own AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE rank <= 16)
SELECT query_id, rank, doc_id, round(61e0 / (60 + rank), 6) AS score, lang FROM own JOIN (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY 1) USING (doc_id) WHERE rank <= 10"""
ROUTED_SQL = f"""WITH {_tf("benchmark", "item_id", "e", _TOKENS)}, {_tf("documents", "doc_id", "a", _TOKENS)},
i AS (SELECT term, ln((1 + (SELECT count(DISTINCT item_id) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM e GROUP BY 1),
ew AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM e JOIN i USING (term)), aw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM a JOIN i USING (term)),
en AS (SELECT id, sqrt(sum(w * w)) AS n FROM ew GROUP BY 1), an AS (SELECT id, sqrt(sum(w * w)) AS n FROM aw GROUP BY 1),
p AS (SELECT aw.id AS doc_id, ew.id AS entry_id, sum(aw.w * ew.w) AS s FROM aw JOIN ew USING (term) GROUP BY 1, 2),
r AS (SELECT doc_id, entry_id, s / (an.n * en.n) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(s / (an.n * en.n), 9) DESC, entry_id) AS rank FROM p JOIN an ON an.id = doc_id JOIN en ON en.id = entry_id)
SELECT doc_id, entry_id, rank, round(score, 6) AS score, lang FROM r JOIN (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY 1) USING (doc_id) WHERE rank <= 3"""


_RERANK = f"""{_tfidf_sql('word', _TOKENS)}, {_rank_sql('word', 'r_word')},
cand AS (SELECT query_id, doc_id, rank - 1 AS cand_pos FROM r_word WHERE rank <= 16),
scored AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, cand_pos) AS rank_ce FROM cand c JOIN documents USING (doc_id)),
fused AS (SELECT query_id, doc_id, cand_pos, 1.0 / (61 + cand_pos) + 2.0 / (60 + rank_ce) AS f FROM scored),
normal AS (SELECT query_id, doc_id, cand_pos, f / max(f) OVER (PARTITION BY query_id) AS score FROM fused)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 best by words, reranked by a table scorer: document length."""
    docs = table(spark, sf_dir, "documents")
    candidates = _top(spark, sf_dir, "word", 16).select("query_id", "doc_id", (F.col("rank") - 1).alias("cand_pos"))
    lengths = candidates.join(docs, "doc_id").select("query_id", "doc_id", F.col("n_chars").cast("double").alias("score"))
    return fusion.rerank(candidates, TableScorer(lengths).score(candidates), 2.0)


@query(f"WITH {_RERANK} SELECT query_id, doc_id, cand_pos, round(score, 6) AS score FROM normal")
def rerank_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "cand_pos", rounded("score"))


@query(f"WITH {_RERANK} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_pos) AS rank FROM normal) WHERE rank <= 10")
def top10_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_stable(_reranked(spark, sf_dir)).select("query_id", "doc_id", "rank", rounded("score"))


@query(
    "WITH r AS (SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS doc_id, floor(l_discount * 10) / 10 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_discount * 10) / 10 DESC, l_linenumber) AS rank FROM lineitem) "
    "SELECT query_id, doc_id, rank, round(min(s + (rank - 1) * 1e-9) OVER (PARTITION BY query_id ORDER BY rank) - (rank - 1) * 1e-9, 12) AS score FROM r"
)
def clamp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("doc_id"), (F.floor(F.col("l_discount") * 10) / 10).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fusion.clamp(lines.withColumn("rank", F.row_number().over(order).cast("long"))).select("query_id", "doc_id", "rank", rounded("score", 12))


@query(
    "WITH r AS (SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS doc_id, l_extendedprice AS s FROM lineitem) SELECT query_id, doc_id, round(s / coalesce(nullif(max(s) OVER w, 0), 1), 6) AS over_max, "
    "round(CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 0.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 6) AS min_max FROM r WINDOW w AS (PARTITION BY query_id)"
)
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("doc_id"), F.col("l_extendedprice").alias("score"))
    return lines.withColumn("over_max", fusion.over_max()).withColumn("min_max", fusion.min_max()).select("query_id", "doc_id", rounded("over_max"), rounded("min_max"))


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.e, d.e) AS score FROM v q, v d WHERE q.vec_id % 20 = 0) "
    "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"
)
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id 20 divides is the stated block of queries, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return pivots.dense_top(rows.where(F.col("id") % 20 == 0), rows).select("query_id", "doc_id", "rank", rounded("score"))


# --- intervals, quantities, constraint signals ----------------------------------------------------

_PART_TEXT = "'более ' || p_size || ' мм, но не более ' || (p_size + 10) || ' мм; не менее ' || (p_retailprice::BIGINT) || ' кг'"


def _part_text() -> Column:
    return F.concat(F.lit("более "), F.col("p_size").cast("string"), F.lit(" мм, но не более "), (F.col("p_size") + 10).cast("string"), F.lit(" мм; не менее "), F.round("p_retailprice").cast("long").cast("string"), F.lit(" кг"))


_CMP = COMPARED
_CMP_SQL = f"""WITH t AS (SELECT p_partkey, {_PART_TEXT.replace('p_retailprice::BIGINT', 'round(p_retailprice)::BIGINT')} AS text FROM part),
m AS (SELECT p_partkey, unnest(regexp_extract_all(text, '{_CMP}', 1)) AS word, unnest(regexp_extract_all(text, '{_CMP}', 2))::DOUBLE AS value, unnest(regexp_extract_all(text, '{_CMP}', 3)) AS raw, unnest(range(len(regexp_extract_all(text, '{_CMP}', 1)))) AS pos FROM t)"""


@query(_CMP_SQL + " SELECT p_partkey, pos::BIGINT AS pos, word, value, CASE WHEN raw = 'мм' THEN 'mm' ELSE 'kg' END AS unit, word IN ('более', 'не менее') AS is_lower, word = 'более' AS strict FROM m")
def interval_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constraints.comparison_rows(table(spark, sf_dir, "part").select("p_partkey", _part_text().alias("text")), "p_partkey")
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), "word", "value", "unit", "is_lower", "strict")


@query(
    "SELECT p_partkey, 0::BIGINT AS pos, 'mm' AS unit, p_size::DOUBLE AS lo, true AS lo_strict, (p_size + 10)::DOUBLE AS hi, false AS hi_strict FROM part UNION ALL "
    "SELECT p_partkey, 1, 'kg', round(p_retailprice)::BIGINT::DOUBLE, false, NULL, false FROM part"
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constraints.interval_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _part_text().alias("text")))
    return rows.select(F.col("doc_id").alias("p_partkey"), F.col("pos").cast("long").alias("pos"), "unit", "lo", "lo_strict", "hi", "hi_strict")


def _line_text() -> Column:
    return F.concat(F.lit("изделие "), F.col("l_quantity").cast("long").cast("string"), F.lit(" мм, масса "), F.floor("l_extendedprice").cast("string"), F.lit(",5 кг"))


@query(
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, pos, unit, value FROM (SELECT l_orderkey, l_linenumber, 0::BIGINT AS pos, 'mm' AS unit, l_quantity::BIGINT::DOUBLE AS value FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, 1, 'kg', floor(l_extendedprice) + 0.5 FROM lineitem)"
)
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).alias("line"), _line_text().alias("text"))
    rows = constraints.quantity_rows(lines, "line", subjects=False)
    return rows.select("query_id.l_orderkey", "query_id.l_linenumber", F.col("pos").cast("long").alias("pos"), "unit", "value")


def _some_part(spark: SparkSession, sf_dir: str, key: Column) -> Column:
    """A part for each key, all parts in turn; part keys have no gaps."""
    known = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("low")).first()
    return key % max(1, known["n"]) + (known["low"] or 0)


@query(
    "SELECT o_orderkey AS query_id, p_partkey AS doc_id, CASE WHEN o_orderkey % 60 > p_size AND o_orderkey % 60 <= p_size + 10 AND floor(o_totalprice / 100) + 0.5 >= round(p_retailprice) THEN 1.0 ELSE -1.0 END AS signal "
    "FROM orders JOIN part ON o_orderkey % (SELECT count(*) FROM part) = p_partkey - (SELECT min(p_partkey) FROM part)"
)
def constraint_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("изделие "), (F.col("o_orderkey") % 60).cast("string"), F.lit(" мм, масса "), F.floor(F.col("o_totalprice") / 100).cast("string"), F.lit(",5 кг"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), _some_part(spark, sf_dir, F.col("o_orderkey")).alias("doc_id"), text.alias("text"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _part_text().alias("text"))
    pairs = orders.select("query_id", "doc_id").join(parts.select("doc_id"), "doc_id")
    return constraints.signal(pairs, constraints.interval_rows(parts), constraints.quantity_rows(orders)).select("query_id", "doc_id", "signal")


# --- prefixes, qualifiers, views ------------------------------------------------------------------

_LCP = "(SELECT coalesce(max(i), 0) FROM range(1, least(length(lo), length(hi)) + 1) r(i) WHERE substr(lo, 1, i) = substr(hi, 1, i))"


@query(f"SELECT p_brand, CASE WHEN n < 2 THEN 0 ELSE {_LCP} END::BIGINT AS prefix_len FROM (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi, count(p_name) AS n FROM part GROUP BY 1)")
def lcp_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prefix_by_group(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query(
    "WITH t AS (SELECT p_partkey, p_brand || ' ' || p_type || ', ' || p_name AS t, length(p_brand) + 4 AS k FROM part), h AS (SELECT p_partkey, t, k, length(regexp_replace(substr(t, 1, k), '[^ ,;:]*$', '')) AS c FROM t) "
    "SELECT p_partkey, CASE WHEN k >= length(t) THEN t ELSE trim(regexp_replace(substr(t, c + 1), '^[ ,;:]+', '')) END AS tail FROM h"
)
def tail_after_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" "), "p_type", F.lit(", "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", tx.trim_to_word(text, F.length("p_brand") + 4).alias("tail"))


_TAGS = "list_distinct(string_split(p_type, ' ') || [p_brand, CASE WHEN p_size > 0 THEN 'sized' ELSE 'plain' END])"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.concat(F.split("p_type", " "), F.array("p_brand", F.when(F.col("p_size") > 0, "sized").otherwise("plain"))))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", tags.alias("tags"))


_SHARED = f"""WITH t AS (SELECT p_partkey, p_brand, {_TAGS} AS tags FROM part), n AS (SELECT p_brand, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT p_brand, v, count(*) AS k FROM (SELECT p_brand, unnest(tags) AS v FROM t) GROUP BY 1, 2),
s AS (SELECT p_brand, coalesce(string_agg(v, '|' ORDER BY v) FILTER (WHERE k = n AND n > 1), '') AS shared FROM n LEFT JOIN k USING (p_brand) GROUP BY 1)"""


@query(_SHARED + " SELECT p_brand, shared FROM s")
def shared_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.shared_values(_tagged(spark, sf_dir), "p_brand", "tags").select("p_brand", F.array_join("shared", "|").alias("shared"))


@query(_SHARED + " SELECT p_partkey, array_to_string(list_sort(list_filter(tags, lambda x: NOT list_contains(string_split(shared, '|'), x))), '|') AS own FROM t JOIN s USING (p_brand)")
def own_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    both = rows.join(views.shared_values(rows, "p_brand", "tags"), "p_brand")
    return both.select("p_partkey", F.array_join(F.sort_array(views.without(F.col("tags"), F.col("shared"))), "|").alias("own"))


@query(
    "SELECT p_partkey, CASE WHEN length(h) <= 14 THEN h ELSE regexp_replace(substr(h, 1, 14), ' [^ ]*$', '') || '…' END AS family FROM (SELECT p_partkey, trim(regexp_split_to_array(p_type || ' ' || p_name || '; ' || p_brand, '[;(]')[1]) AS h FROM part)"
)
def short_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("p_type", F.lit(" "), "p_name", F.lit("; "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", tx.short_family(label, 14).alias("family"))


@query(
    "SELECT p_partkey, concat_ws(' | ', nullif(p_brand, ''), nullif(p_type, ''), nullif(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, '')) AS view, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || '. ' || p_type END AS text FROM part"
)
def concat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")
    more = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.join_parts(F.col("p_brand"), F.col("p_type"), even).alias("view"), tx.declaration_text(F.col("p_name"), more).alias("text"))


# --- trees and codes ------------------------------------------------------------------------------


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as the lines of one dump for each region."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = region.select("r_regionkey", F.lit(-1).alias("n"), F.lit(-1).cast("long").alias("c"), F.explode(F.array(F.lit(tree.BEGIN), F.concat(F.lit("V | "), "r_name"))).alias("value"))
    middle = nation.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("n"), F.lit(-1).cast("long").alias("c"), F.concat(F.lit("  "), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" | "), "n_name", F.lit(":")).alias("value"))
    low = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("n"), F.col("c_custkey").alias("c"),
        F.concat(F.lit("    "), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(" | – – "), "c_name", F.lit(" ["), "c_mktsegment", F.lit("]")).alias("value"),
    )
    order = Window.partitionBy("r_regionkey").orderBy("n", "c", F.when(F.col("value") == tree.BEGIN, 0).otherwise(1))
    rows = top.unionByName(middle).unionByName(low).withColumn("line_no", (F.row_number().over(order) - 1).cast("int"))
    return rows.select(F.col("r_regionkey").cast("string").alias("file"), "line_no", "value")


@query("""
WITH rows AS (
  SELECT r_regionkey AS r, -1 AS n, -1 AS c, 0 AS depth, NULL AS code, r_name AS label, NULL AS gloss, '' AS chain FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 1, lpad(n_nationkey::VARCHAR, 2, '0'), n_name, NULL, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 4, lpad(c_custkey::VARCHAR, 10, '0'), c_name, c_mktsegment, r_name || ' > ' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n, c) AS line_no FROM rows)
SELECT p.r::VARCHAR AS file, p.line_no::BIGINT AS line_no, p.depth, p.code, p.label, p.gloss, p.chain, coalesce(q.line_no, -1)::BIGINT AS parent
FROM placed p LEFT JOIN placed q ON p.r = q.r AND ((p.depth = 1 AND q.depth = 0) OR (p.depth = 4 AND q.depth = 1 AND q.n = p.n))
""")
def tree_parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.with_labels(tree.linked(tree.parsed(tree.sections(_geography(spark, sf_dir)))))
    chain = F.array_join(F.transform("chain", lambda x: x["label"]), " > ")
    return nodes.select("file", F.col("line_no").cast("long").alias("line_no"), "depth", "code", "label", "gloss", chain.alias("chain"), F.coalesce(F.col("parent"), F.lit(-1)).cast("long").alias("parent"))


@query(
    "SELECT c_custkey, code, n_name AS chapter_label, CASE WHEN substr(code, 1, 4) = lpad(n_nationkey::VARCHAR, 2, '0') || '00' THEN r_name ELSE '' END AS heading_label FROM "
    "(SELECT c_custkey, c_nationkey, lpad(c_nationkey::VARCHAR, 2, '0') || lpad((c_custkey % 3)::VARCHAR, 2, '0') || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS code FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def code_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    code = F.concat(pad(F.col("c_nationkey"), 2), pad(F.col("c_custkey") % 3, 2), pad(F.col("c_custkey") % 1000000, 6))
    rows = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).select("*", *views.code_levels(F.col("code")))
    chapters = nation.select(pad(F.col("n_nationkey"), 2).alias("chapter"), F.col("n_name").alias("chapter_label"))
    headings = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(pad(F.col("n_nationkey"), 2), F.lit("00")).alias("heading"), F.col("r_name").alias("heading_label"))
    joined = rows.join(chapters, "chapter", "left").join(headings, "heading", "left")
    return joined.select("c_custkey", "code", "chapter_label", F.coalesce("heading_label", F.lit("")).alias("heading_label"))


# --- evaluation -----------------------------------------------------------------------------------

_RANKING = f"WITH {_tfidf_sql('word', _TOKENS)}, {_rank_sql('word', 'r_word')}, ranking AS (SELECT query_id AS declaration_id, doc_id AS regulation_id, rank, score FROM r_word WHERE rank <= 10), gold AS (SELECT query_id AS declaration_id, min(doc_id) AS regulation_id FROM r_word WHERE rank <= 12 GROUP BY 1)"


def _ranking_and_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The word ranking, and as gold the smallest id among each query's first twelve."""
    found = _top(spark, sf_dir, "word", 12).select(F.col("query_id").alias("declaration_id"), F.col("doc_id").alias("regulation_id"), "rank", "score")
    return found.where(F.col("rank") <= 10), found.groupBy("declaration_id").agg(F.min("regulation_id").alias("regulation_id"))


_METRICS = "m AS (SELECT count(*) AS n, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS hit1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS hit3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS hit5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hit10, avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END) AS mrr10 FROM gold LEFT JOIN ranking USING (declaration_id, regulation_id))"


@query(f"{_RANKING}, {_METRICS} SELECT n, round(hit1, 6) AS hit1, round(hit3, 6) AS hit3, round(hit5, 6) AS hit5, round(hit10, 6) AS hit10, round(mrr10, 6) AS mrr10 FROM m")
def hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_ranking_and_gold(spark, sf_dir)).select("n", *[rounded(c) for c in ("hit1", "hit3", "hit5", "hit10", "mrr10")])


@query(
    f"{_RANKING}, {_METRICS} SELECT n, round(hit1, 6) AS hit1, round(greatest(0, (hit1 + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(hit1 * (1 - hit1) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS low, "
    "round(least(1, (hit1 + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(hit1 * (1 - hit1) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM m"
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.report(*_ranking_and_gold(spark, sf_dir))
    return found.select("n", rounded("hit1"), F.round("hit1_low", 6).alias("low"), F.round("hit1_high", 6).alias("high"))


@query(
    "WITH m AS (SELECT lpad((l_partkey * 7919 % 1000000)::VARCHAR, 6, '0') AS chosen, lpad((l_partkey * 7919 % 1000000 + CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 10000 END)::VARCHAR, 6, '0') AS gold FROM lineitem), "
    "l AS (SELECT CASE WHEN substr(chosen, 1, 6) = substr(gold, 1, 6) THEN 6 WHEN substr(chosen, 1, 4) = substr(gold, 1, 4) THEN 4 WHEN substr(chosen, 1, 2) = substr(gold, 1, 2) THEN 2 ELSE 0 END AS level FROM m) SELECT coalesce(level, -1)::BIGINT AS level, count(*) AS n FROM l GROUP BY ROLLUP (level)"
)
def error_level_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.pmod(F.col("l_partkey") * 7919, F.lit(1000000))
    off = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(100), F.lit(10000)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    pad = lambda c: F.when(F.length(c.cast("string")) >= 6, F.substring(c.cast("string"), 1, 6)).otherwise(F.lpad(c.cast("string"), 6, "0"))
    return evaluate.error_levels(table(spark, sf_dir, "lineitem").select(pad(base).alias("chosen"), pad(base + off).alias("gold"))).select(F.coalesce("level", F.lit(-1)).cast("long").alias("level"), "n")


_GATE = "WITH r AS (SELECT o_custkey::VARCHAR AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderkey % 500 = 0 THEN 'x' ELSE (o_orderkey % 97)::VARCHAR END AS g, CASE WHEN o_orderkey % 700 = 0 THEN NULL WHEN o_orderkey % 900 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS s FROM orders)"


@query(
    _GATE + ", c AS (SELECT c_custkey::VARCHAR AS d FROM customer WHERE c_custkey % 50 <> 0), g AS (SELECT d, count(*) AS n, count(DISTINCT g) AS k, max(rank) AS top FROM r GROUP BY 1), "
    "v AS (SELECT 'unknown_declaration' AS rule, d, d AS detail FROM (SELECT DISTINCT d FROM r) WHERE d NOT IN (SELECT d FROM c) UNION ALL SELECT 'absent_declaration', d, d FROM c WHERE d NOT IN (SELECT d FROM r) "
    "UNION ALL SELECT 'row_count', d, n::VARCHAR FROM g WHERE n <> 10 UNION ALL SELECT 'ranks', d, array_to_string(range(1, n + 1), ',') FROM g WHERE n <> 10 UNION ALL SELECT 'duplicate_regulation', d, k::VARCHAR FROM g WHERE k <> n "
    "UNION ALL SELECT 'unknown_regulation', d, g FROM r WHERE g = 'x' UNION ALL SELECT 'not_finite', d, rank::VARCHAR FROM r WHERE s IS NULL UNION ALL SELECT 'rising_score', d, rank::VARCHAR FROM (SELECT *, lag(s) OVER (PARTITION BY d ORDER BY rank) AS before FROM r) WHERE before < s) "
    "SELECT rule, d AS declaration_id, detail FROM v"
)
def validate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders")
    ranking = store.spread(orders, orders.count(), "o_custkey").select(
        F.col("o_custkey").cast("string").alias("declaration_id"), F.row_number().over(order).alias("rank"), F.when(key % 500 == 0, "x").otherwise((key % 97).cast("string")).alias("regulation_id"),
        F.when(key % 700 == 0, F.lit(None)).when(key % 900 == 0, price * 2).otherwise(price).alias("score"),
    )
    known = table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").cast("string").alias("declaration_id"))
    docs = spark.range(97).select(F.col("id").cast("string").alias("regulation_id"))
    return evaluate.violations(ranking, known, docs)


@query("SELECT lang, count(*) AS n, round(median(length(text)), 6) AS median_chars, max(length(text))::BIGINT AS max_chars, count(*) FILTER (WHERE length(text) < 100) AS n_short FROM documents GROUP BY 1")
def text_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(n), 6).alias("median_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if(n < 100).alias("n_short"))


@query("WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(' ' || lower(replace(text, chr(160), ' ')), '[^\\pL\\pN_,.](\\d+(?:[.,]\\d+)?)', 1), lambda x: replace(x, ',', '.')::DOUBLE) AS xs FROM documents) SELECT doc_id, len(xs)::BIGINT AS n, round(coalesce(list_sum(list_transform(xs, lambda x: ln(1 + x))), 0), 6) AS logs FROM n")
def number_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", tx.numbers(F.col("text")).alias("xs"))
    logs = F.aggregate("xs", F.lit(0.0), lambda s, x: s + F.log(1 + x))
    return found.select("doc_id", F.size("xs").cast("long").alias("n"), F.round(logs, 6).alias("logs"))
