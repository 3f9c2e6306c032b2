"""Queries of the training-data operations over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hnsw, html, merkle, mixing, neardup, secrets, separators, tokenfiles, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("start", found["start"].cast("long"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP2_SQL = f"""
WITH it AS (SELECT item_id, ws, len(ws) AS w, least(5, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
ish AS (SELECT item_id, w, k, w - k + 1 AS m, v, count(*) AS ci FROM (SELECT item_id, w, k, unnest(list_transform(range(1, w - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS v FROM it) GROUP BY ALL),
d AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
dp AS (SELECT doc_id, n, k, unnest(range(0, n - k + 1)) AS pos, unnest(list_transform(range(1, n - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS v FROM d, (SELECT DISTINCT k FROM it) WHERE n >= k),
h AS (SELECT dp.doc_id, dp.n, dp.pos, ish.item_id, ish.w, ish.k, ish.m, ish.ci, ish.v FROM dp JOIN ish ON dp.k = ish.k AND dp.v = ish.v),
st AS (SELECT DISTINCT doc_id, n, item_id, w, k, m, greatest(0, least(pos, n - w)) AS start FROM h),
o AS (SELECT st.doc_id, st.item_id, st.start, st.m, least(st.w, st.n) - st.k + 1 AS mw, h.v, count(*) AS cw, any_value(h.ci) AS ci
  FROM st JOIN h ON h.doc_id = st.doc_id AND h.item_id = st.item_id AND h.pos BETWEEN st.start AND st.start + least(st.w, st.n) - st.k GROUP BY ALL),
sm AS (SELECT doc_id, item_id, start, sum(least(cw, ci))::DOUBLE / (m + mw - sum(least(cw, ci))) AS similarity FROM o GROUP BY doc_id, item_id, start, m, mw)
SELECT doc_id, item_id, start::BIGINT AS start, similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sm WHERE similarity >= 0.75) WHERE r = 1
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.neighbours(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH turns AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), shared AS (
  SELECT a.pair_id, count(*) AS n FROM (
    SELECT a.pair_id, a.k, row_number() OVER (PARTITION BY a.pair_id ORDER BY a.k) AS r
    FROM turns a JOIN turns b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1 AND a.role = b.role AND a.text = b.text
  ) a WHERE a.k = a.r GROUP BY 1
), placed AS (
  SELECT t.*, coalesce(s.n, 0) AS n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM turns t LEFT JOIN shared s USING (pair_id)
), spans AS (
  SELECT *, coalesce(sum(CASE WHEN k > n THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM placed
), written AS (
  SELECT *, (off + length(role) + 5)::BIGINT || ':' || (off + length(shown) - 1)::BIGINT AS span FROM spans
)
SELECT pair_id, max(n)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN k <= n AND side = 0 THEN shown END, '' ORDER BY k), '') AS prompt,
  coalesce(string_agg(CASE WHEN k > n AND side = 0 THEN shown END, '' ORDER BY k), '') AS chosen,
  coalesce(string_agg(CASE WHEN k > n AND side = 1 THEN shown END, '' ORDER BY k), '') AS rejected,
  coalesce(string_agg(CASE WHEN k > n AND side = 0 AND role = 'assistant' THEN span END, ',' ORDER BY k), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN k > n AND side = 1 AND role = 'assistant' THEN span END, ',' ORDER BY k), '') AS rejected_mask
FROM written GROUP BY pair_id
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, n::BIGINT AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.proofs(docs, merkle.lowered(F.col("doc_id"), F.col("text")))


def _leaf_sql(text: str) -> str:
    shown = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(shown)})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 bit by bit: a character's code enters by exclusive or, and eight steps (-1) divide by the polynomial.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
)


def _up_sql(name: str, lowest: str) -> str:
    """Recursive CTE of a tree's nodes over ``lowest`` (tree, idx, digest, n)."""
    return (
        f"{name}(tree, level, idx, digest, n) AS (SELECT tree, 0, idx, digest, n FROM {lowest} UNION ALL "
        f"SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 8, n)"
    )


def _steps_sql(starts: str, name: str, key: str, first: int) -> str:
    return (
        f"SELECT {key}, {first} + level AS step, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < s.idx // (8 ** level)::BIGINT), '') AS before, "
        f"coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > s.idx // (8 ** level)::BIGINT), '') AS after "
        f"FROM {starts} s JOIN {name} u ON u.tree = s.tree AND u.n > 1 AND u.idx // 8 = s.idx // (8 ** (level + 1))::BIGINT GROUP BY ALL"
    )


OP11_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql(_LOWER)} END AS claimed FROM documents),
d AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
{_up_sql("up", "d")},
t AS (SELECT '' AS tree, tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
{_up_sql("top", "t")},
own AS ({_steps_sql("d", "up", "s.tree AS lang, s.idx", 0)}),
over AS ({_steps_sql("t", "top", "s.lang", 100)}),
steps AS (SELECT *, row_number() OVER (PARTITION BY lang, idx ORDER BY step) AS k FROM (SELECT lang, idx, step, before, after FROM own UNION ALL SELECT d.tree, d.idx, step, before, after FROM over JOIN d ON d.tree = over.lang)),
fold(lang, idx, k, acc) AS (SELECT tree, idx, 0, coalesce(claimed, leaf) FROM d UNION ALL
  SELECT f.lang, f.idx, f.k + 1, sha256(before || acc || after) FROM fold f JOIN steps s ON s.lang = f.lang AND s.idx = f.idx AND s.k = f.k + 1),
folded AS (SELECT lang, idx, arg_max(acc, k) AS folded_root FROM fold GROUP BY 1, 2),
shown AS (SELECT lang, idx, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY 1, 2)
SELECT d.doc_id, d.leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM d JOIN t ON t.lang = d.tree JOIN (SELECT digest FROM top WHERE n = 1) r ON true JOIN folded f ON f.lang = d.tree AND f.idx = d.idx LEFT JOIN shown s ON s.lang = d.tree AND s.idx = d.idx
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


_BASE32 = (
    "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], "
    "lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> b) & 31) + 1)::BIGINT, 1)), '')), '')"
)

OP12_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_toxicity": op5_toxicity,
        "op6_token_files": op6_token_files,
        "op7_secret_scan": op7_secret_scan,
        "op8_minhash_neardup": op8_minhash_neardup,
        "op9_mixing": op9_mixing,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_warc": op12_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op8_minhash_neardup": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_warc": OP12_SQL}
