"""Queries of catalogue preparation, parsers, readers, labels and the whole ranking, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .functions import text as tx
from .functions.quantities import UNITS
from .operators import constraints, evaluate, lemmas, tree, views
from .operators.retrieval import dense_scores
from .operators.scorers import TableScorer
from .plans import ranking
from .queries import ORACLE, QUERIES, _GRAMS, _LCP, _TOKENS, _geography, _rank_all_sql, _some_part, _tfidf_sql, query, rounded, table
from .sources import files

# --- parsers: every comparator and unit -------------------------------------------------------------

_WORDS = ("не более", "не менее", "не превышает", "более", "менее", "свыше", "выше", "ниже", "от", "до")
_SURFACES = tuple(surface for surface, _ in UNITS)
#: A surface with a blank is cut there by the pattern, and what is left of it is no unit.
_CANON = tuple(None if " " in surface else canon for surface, canon in UNITS)


def _sql_list(values: tuple[str | None, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _picked(values: tuple[str | None, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


@query(
    f"WITH t AS (SELECT p_partkey, {_sql_list(_WORDS)}[p_partkey % 10 + 1] AS word, {_sql_list(_CANON)}[p_partkey // 10 % {len(UNITS)} + 1] AS unit, p_size FROM part) "
    "SELECT p_partkey, word, p_size + 0.5::DOUBLE AS value, unit, word IN ('более', 'свыше', 'выше', 'не менее', 'от') AS is_lower, word IN ('более', 'свыше', 'выше', 'менее', 'ниже') AS strict, 'масса нетто' AS subject FROM t WHERE unit IS NOT NULL"
)
def unit_comparator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.concat(F.lit("Масса нетто, и "), _picked(_WORDS, key % 10), F.lit(" "), F.col("p_size").cast("string"), F.lit(",5 "), _picked(_SURFACES, F.floor(key / 10) % len(UNITS)))
    rows = constraints.comparison_rows(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return rows.select("p_partkey", "word", "value", "unit", "is_lower", "strict", F.array_join(F.sort_array("subject"), " ").alias("subject"))


@query(
    f"WITH t AS (SELECT p_partkey, {_sql_list(_CANON)}[p_partkey % {len(UNITS)} + 1] AS unit, p_size FROM part) "
    "SELECT p_partkey, unit, p_size::DOUBLE AS value, CASE WHEN unit LIKE 'pct%' THEN 'pct' ELSE unit END AS family, 'изделие летнее' AS subject FROM t WHERE unit IS NOT NULL"
)
def unit_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Изделие летнее из "), F.col("p_size").cast("string"), F.lit(" "), _picked(_SURFACES, F.col("p_partkey") % len(UNITS)))
    rows = constraints.quantity_rows(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return rows.select(F.col("query_id").alias("p_partkey"), "unit", "value", "family", F.array_join("subject", " ").alias("subject"))


@query(
    "WITH p AS (SELECT o_orderkey AS query_id, p_partkey AS doc_id, o_orderkey % 4 AS kind, o_orderkey % 60 AS a, p_size FROM orders JOIN part ON p_partkey - (SELECT min(p_partkey) FROM part) = o_orderkey % (SELECT count(*) FROM part)) "
    "SELECT query_id, doc_id, CASE WHEN kind IN (0, 3) THEN 0e0 WHEN a <= p_size THEN 1e0 ELSE -1e0 END AS signal FROM p"
)
def constraint_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of another kind stand in for a missing unit; of several quantities the subject decides, a tie says nothing."""
    key = F.col("o_orderkey")
    a, b = (key % 60).cast("string"), (key % 7).cast("string")
    cotton = lambda u: F.concat(F.lit("хлопка "), a, F.lit(u))
    wool = lambda u: F.concat(F.lit("шерсти "), b, F.lit(u))
    texts = [
        F.concat(cotton(" мас.%"), F.lit(", "), wool(" об.%")),  # both stand behind the word: a tie
        F.concat(wool(" об.%"), F.lit(", "), cotton(" мас.%")),  # only the second does
        F.concat(cotton(" %"), F.lit(", "), wool(" об.%")),  # the interval's own unit is there
        F.lit("хлопка много"),
    ]
    text = F.when(key % 4 == 0, texts[0]).when(key % 4 == 1, texts[1]).when(key % 4 == 2, texts[2]).otherwise(texts[3])
    orders = table(spark, sf_dir, "orders").select(key.alias("query_id"), _some_part(spark, sf_dir, key).alias("doc_id"), text.alias("text"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("ткани, хлопка не более "), F.col("p_size").cast("string"), F.lit(" %")).alias("text"))
    pairs = orders.select("query_id", "doc_id").join(parts.select("doc_id"), "doc_id")
    return constraints.signal(pairs, constraints.interval_rows(parts), constraints.quantity_rows(orders)).select("query_id", "doc_id", "signal")


@query(
    "SELECT p_partkey, i.pos::BIGINT AS pos, i.unit, i.lo, i.hi, i.subject FROM (SELECT p_partkey, unnest(["
    "{'pos': 0, 'unit': 'mm', 'lo': p_size::DOUBLE, 'hi': p_size + 10::DOUBLE, 'subject': 'длина доски шириной'}, "
    "{'pos': 1, 'unit': 'kg', 'lo': NULL::DOUBLE, 'hi': 7::DOUBLE, 'subject': 'длина доски масса шириной'}]) AS i FROM part)"
)
def interval_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged interval has the words before either of its bounds, without stop words and repeats."""
    size = F.col("p_size")
    text = F.concat(F.lit("Длина доски более "), size.cast("string"), F.lit(" мм, шириной до "), (size + 10).cast("string"), F.lit(" мм, для доски масса "), F.lit("менее 7 кг"))
    rows = constraints.interval_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return rows.select(F.col("doc_id").alias("p_partkey"), F.col("pos").cast("long").alias("pos"), "unit", "lo", "hi", F.array_join(F.sort_array("subject"), " ").alias("subject"))


_LEMMAS = (("колеса", "колесо"), ("стальные", "стальной"), ("мебели", "мебель"), ("данные", "данный"))


@query(
    f"WITH t AS (SELECT p_partkey, unnest(['колесо', 'стальной', 'мебель', 'мм', p_size::VARCHAR] || {_TOKENS.format(t='p_name')}) AS term FROM part) SELECT p_partkey, term, count(*) AS tf FROM t WHERE length(term) > 1 GROUP BY ALL"
)
def lemma_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a lemma become it; stop words go afterwards, of which some are lemmas."""
    text = F.concat(F.lit("Колёса стальные для мебели, и прочие данная "), F.col("p_size").cast("string"), F.lit(" мм "), F.col("p_name"))
    lemmas = spark.createDataFrame([*_LEMMAS, ("колесa", "x")], "token string, lemma string")
    rows = tx.lemma_rows(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", lemmas)
    return rows.groupBy("p_partkey", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(
    "SELECT p_partkey, 'query: ' || p_name AS asked, 'passage: ' || p_type AS passage, p_type AS plain, "
    "'<Instruct>: judge' || chr(10) || '<Query>: ' || p_name || chr(10) || '<Document>: ' || p_type AS body, round(1 / (1 + exp(p_size / 10.0 - p_retailprice / 1000)), 6) AS p_yes FROM part"
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    prompt = tx.rerank_prompt(F.lit("judge"), name, kind)
    body = F.substring(prompt, F.lit(len(tx.PROMPT_BEGIN) + 1), F.length(prompt) - len(tx.PROMPT_BEGIN) - len(tx.PROMPT_END))
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.passage(name, "intfloat/multilingual-e5-base", True).alias("asked"), tx.passage(kind, "intfloat/multilingual-e5-base", False).alias("passage"),
        tx.passage(kind, "other", False).alias("plain"), body.alias("body"), F.round(tx.yes_probability(F.col("p_size") / 10, F.col("p_retailprice") / 1000), 6).alias("p_yes"),
    )


# --- the catalogue's text views -----------------------------------------------------------------------

_ENTRIES = """e AS (SELECT 'R' || p_partkey AS regulation_id, h || lpad((p_partkey % 1000000)::VARCHAR, 6, '0') AS code, h AS heading, substr(h, 1, 2) AS chapter, p_partkey, p_brand, p_type, p_name,
  'group ' || h || ', ' || p_name || ' ' || p_brand AS descr, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'note ' || p_brand END AS expl FROM (SELECT *, lpad((p_size * 37)::VARCHAR, 4, '0') AS h FROM part))"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries with codes of ten digits or more, one for each, and the tree's nodes of most of them, of all headings and chapters."""
    heading = F.lpad((F.col("p_size") * 37).cast("string"), 4, "0")
    key = F.col("p_partkey").cast("string")
    code = F.concat(heading, F.when(F.length(key) > 6, key).otherwise(F.lpad(key, 6, "0")))
    part = table(spark, sf_dir, "part").withColumn("heading", heading).withColumn("code", code)
    entries = part.select(
        F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("regulation_id"), "code", F.concat(F.lit("  group "), "heading", F.lit(", "), "p_name", F.lit(" "), "p_brand").alias("description"),
        F.when(F.col("p_partkey") % 2 != 0, F.concat(F.lit("note "), "p_brand")).alias("explanation"),
    )
    label = lambda depth, text: F.struct(F.lit(depth).alias("depth"), text.alias("label"))
    top = lambda code, word: F.concat(F.lit(word), code, F.lit("; and more"))
    chapter = F.substring("heading", 1, 2)
    chain = F.array(label(1, top(chapter, "chapter ")), label(2, top(F.col("heading"), "heading ")), label(3, F.col("p_brand")), label(4, F.lit("")), label(5, F.split("p_type", " ")[0]))
    leaves = part.where("p_partkey % 7 <> 0").select("code", F.col("p_type").alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("gloss"), chain.alias("chain"))
    none = F.array().cast("array<struct<depth:int,label:string>>")
    upper = [part.select(c.alias("code")).distinct().select("code", top(F.col("code"), word).alias("label"), F.lit(None).cast("string").alias("gloss"), none.alias("chain")) for c, word in ((chapter, "chapter "), (F.col("heading"), "heading "))]
    return entries, leaves.unionByName(upper[0]).unionByName(upper[1])


def _joined_sql(*parts: str) -> str:
    return "concat_ws(' | ', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


@query(
    f"WITH {_ENTRIES}, pre AS (SELECT heading, CASE WHEN n < 2 THEN 0 ELSE {_LCP} END AS k FROM (SELECT heading, min('  ' || descr) AS lo, max('  ' || descr) AS hi, count(*) AS n FROM e GROUP BY 1)), "
    "n AS (SELECT e.*, k, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS leaf, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 3 <> 0 THEN '' ELSE p_name END AS gloss, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE [p_brand, string_split(p_type, ' ')[1]] END AS path FROM e JOIN pre USING (heading)), "
    "c AS (SELECT *, length(regexp_replace(substr(descr, 1, k), '[^ ,;:]*$', '')) AS cut FROM n), "
    "t AS (SELECT *, CASE WHEN k <= 0 OR k >= length(descr) THEN descr ELSE trim(regexp_replace(substr(descr, cut + 1), '^[ ,;:]+', '')) END AS tail FROM c), "
    "g AS (SELECT heading, count(*) AS n FROM t GROUP BY 1), v AS (SELECT heading, x, count(DISTINCT regulation_id) AS m FROM (SELECT heading, regulation_id, unnest(path) AS x FROM t) GROUP BY 1, 2), "
    "s AS (SELECT heading, coalesce(list(x) FILTER (WHERE m = n AND n > 1), []) AS shared FROM g LEFT JOIN v USING (heading) GROUP BY heading) "
    f"SELECT regulation_id AS doc_id, {_joined_sql(chr(39) + 'chapter ' + chr(39) + ' || chapter || ' + chr(39) + '; and more' + chr(39), chr(39) + 'heading ' + chr(39) + ' || heading || ' + chr(39) + '; and more' + chr(39), 'expl', 'descr')} AS coarse_text, "
    f"{_joined_sql(chr(39) + 'heading ' + chr(39) + ' || heading', 'array_to_string(path, ' + chr(39) + ' › ' + chr(39) + ')', 'leaf', 'CASE WHEN lower(gloss) <> lower(descr) THEN gloss ELSE ' + chr(39) * 2 + ' END', 'CASE WHEN tail <> descr THEN tail ELSE ' + chr(39) * 2 + ' END')} AS fine_text, "
    f"coalesce(nullif({_joined_sql('array_to_string(list_filter(path, lambda q: NOT list_contains(shared, q)), ' + chr(39) + ' › ' + chr(39) + ')', 'leaf', 'CASE WHEN tail <> descr THEN tail ELSE ' + chr(39) * 2 + ' END')}, ''), nullif(leaf, ''), nullif(tail, ''), descr) AS disc_text FROM t JOIN s USING (heading)"
)
def catalogue_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.catalogue(*_entries(spark, sf_dir))
    return rows.select(F.col("regulation_id").alias("doc_id"), "coarse_text", "fine_text", "disc_text")


@query(
    "SELECT count(*) AS entries, "
    + ", ".join(f"round(median(length({v})), 6) AS {v}_median, max(length({v}))::BIGINT AS {v}_max" for v in views.VIEWS)
    + ", (SELECT count(*) FROM part WHERE p_partkey % 7 = 0) AS no_path, (SELECT count(*) FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 3 <> 0) AS no_gloss "
    + f"FROM ({ORACLE['catalogue_views']})"
)
def catalogue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to know after a catalogue was made: lengths of its views, entries without a path or a gloss."""
    found = views.catalogue(*_entries(spark, sf_dir)).agg(*views.statistics())
    return found.withColumns({f"{v}_median": F.round(f"{v}_median", 6) for v in views.VIEWS})


_PLACED = """WITH rows AS (
  SELECT r_regionkey AS r, -1 AS n, -1 AS c, NULL AS code, r_name AS label FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, lpad(n_nationkey::VARCHAR, 2, '0'), n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, lpad(c_custkey::VARCHAR, 10, '0'), c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n, c) AS line_no FROM rows)"""


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.linked(tree.parsed(tree.sections(_geography(spark, sf_dir))))


@query(
    _PLACED + " SELECT p.r::VARCHAR AS file, p.line_no::BIGINT AS line_no, count(*) AS n, string_agg(q.line_no::VARCHAR, ',' ORDER BY q.line_no) AS children "
    "FROM placed p JOIN placed q ON p.r = q.r AND ((p.n = -1 AND q.n >= 0 AND q.c = -1) OR (p.n >= 0 AND p.c = -1 AND q.n = p.n AND q.c >= 0)) GROUP BY 1, 2"
)
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.children(_tree_rows(spark, sf_dir))
    return found.select("file", F.col("parent").cast("long").alias("line_no"), F.size("children").cast("long").alias("n"), F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query(
    _PLACED + ", d AS (SELECT r + 10 * k AS f, line_no, code, label || CASE WHEN k = 1 THEN ' again' ELSE '' END AS label FROM placed, (SELECT unnest([0, 1]) AS k) WHERE code IS NOT NULL) "
    "SELECT code, f::VARCHAR AS file, line_no::BIGINT AS line_no, label FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY f::VARCHAR, line_no) AS i FROM d) WHERE i = 1"
)
def first_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code is there twice; the first in file and line order counts."""
    nodes = _tree_rows(spark, sf_dir)
    again = nodes.withColumn("file", (F.col("file").cast("int") + 10).cast("string")).withColumn("label", F.concat("label", F.lit(" again")))
    return tree.by_code(again.unionByName(nodes)).select("code", "file", F.col("line_no").cast("long").alias("line_no"), "label")


# --- readers, sink, labels, gate ------------------------------------------------------------------------


@query(
    "WITH d AS (SELECT 'D' || c_custkey AS declaration_id, c_custkey, trim(c_name) || '. ' || c_mktsegment AS text FROM customer), r AS (SELECT declaration_id, c_custkey, k::INT AS rank, 'R' || (c_custkey % 100 + k) AS regulation_id, printf('%.6f', 1.0 / k) AS score, text FROM d, range(1, 4) g(k)) "
    "SELECT row_number() OVER (ORDER BY c_custkey DESC, rank) - 1 AS line, declaration_id, rank, regulation_id, score::DOUBLE AS score, text FROM r"
)
def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations as JSON lines with blank ones between, read in their order; a ranking of them as CSV, and that read again."""
    folder = store.new_path(spark, "files")
    customer = table(spark, sf_dir, "customer").orderBy(F.desc("c_custkey"))
    fields = F.struct(F.concat(F.lit("D"), F.col("c_custkey").cast("string")).alias("declaration_id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("G31_1"), F.col("c_mktsegment").alias("desc_extention"))
    customer.select(F.concat(F.to_json(fields), F.lit("\n  \n")).alias("value")).write.text(f"{folder}/d.jsonl")
    files.require(spark, f"{folder}/d.jsonl")
    given = store.materialise(files.declarations(spark, f"{folder}/d.jsonl"), "declarations")
    number = F.substring("declaration_id", 2, 20).cast("long")
    ranked = given.select("input_ord", "declaration_id", number.alias("n"), F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("rank"))
    ranked = ranked.select("input_ord", "declaration_id", "rank", F.concat(F.lit("R"), (F.col("n") % 100 + F.col("rank")).cast("string")).alias("regulation_id"), (1.0 / F.col("rank")).alias("score"))
    files.write_predictions(ranked, f"{folder}/out")
    lines = files.dump(spark, f"{folder}/out").where("line_no > 0 and value <> ''")
    # Files in the order of their names are one file: a row a file.
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", before.alias("shift"))
    lines = lines.join(F.broadcast(shifts), "file").select(F.expr("split(value, ',')").alias("f"), (F.col("line_no") - 1 + F.col("shift")).cast("long").alias("line"))
    read = files.predictions(spark, f"{folder}/out")
    placed = lines.select("line", F.col("f")[0].alias("declaration_id"), F.expr("try_cast(f[1] as int)").alias("rank"))
    return read.join(placed, ["declaration_id", "rank"]).join(given.select("declaration_id", "text"), "declaration_id").select("line", "declaration_id", "rank", "regulation_id", "score", "text")


@query(
    "SELECT 'R' || p_partkey AS regulation_id, lpad(p_partkey::VARCHAR, 10, '0') AS code, 'part ' || p_name AS description, CASE WHEN p_size % 2 = 0 THEN p_type END AS explanation, "
    "CASE WHEN p_size % 2 = 0 THEN 'part ' || p_name || '. ' || p_type ELSE 'part ' || p_name END AS text FROM part"
)
def regulations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes keep their zeros; a missing field is null; fields that are not asked for are left out."""
    path = store.new_path(spark, "regulations")
    code = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    fields = F.struct(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("regulation_id"), code.alias("code"), F.concat(F.lit("part "), "p_name").alias("description"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("explanation"), F.lit("x").alias("notes"))
    table(spark, sf_dir, "part").select(F.concat(F.to_json(fields), F.lit("\n")).alias("value")).write.text(path)
    return files.regulations(spark, path).select("*", tx.declaration_text(F.col("description"), F.col("explanation")).alias("text"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part has a label, and some second ones of a block; as JSON lines."""
    path = store.new_path(spark, "labels")
    key = F.col("p_partkey")
    named = lambda letter: F.concat(F.lit(letter), key.cast("string"))
    confidence = F.when(key % 5 == 0, "low").when(key % 2 == 0, "medium").otherwise("high")
    rows = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 or p_partkey % 30 = 1").select(named("D").alias("declaration_id"), named("R").alias("regulation_id"), confidence.alias("confidence"))
    rows.write.json(path)
    return files.labels(spark, path)


_LABELS_SQL = "l AS (SELECT p_partkey, 'R' || p_partkey AS r, CASE WHEN p_partkey % 5 = 0 THEN 'low' WHEN p_partkey % 2 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 30 = 1)"


@query(f"WITH {_LABELS_SQL} SELECT confidence, count(*) AS n FROM l GROUP BY 1")
def label_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confidences(_labels(spark, sf_dir))


@query(
    f"WITH {_LABELS_SQL}, b AS (SELECT p.p_partkey // 3 AS h, count(DISTINCT p.p_partkey) AS size, count(l.r) AS n FROM part p LEFT JOIN l USING (p_partkey) GROUP BY 1 HAVING count(DISTINCT p.p_partkey) = 3) "
    "SELECT (SELECT count(*) FROM l) AS n, (SELECT count(DISTINCT r) FROM l) AS \"different\", count(*) AS blocks, count(*) FILTER (WHERE n = 1) AS blocks_with_one FROM b"
)
def label_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    digits = 19  # of a long: four would be cut, and headings run into each other, from key 30,000 on
    regulations = table(spark, sf_dir, "part").select(F.concat(F.lit("R"), key.cast("string")).alias("regulation_id"), F.lpad(F.expr("p_partkey div 3").cast("string"), digits, "0").alias("code"))
    return evaluate.label_checks(_labels(spark, sf_dir), regulations, digits=digits)


@query(
    "SELECT 'columns' AS rule, NULL AS declaration_id, c AS detail, 'without columns' AS given FROM (SELECT unnest(['rank', 'score']) AS c) UNION ALL SELECT 'empty', NULL, '0', 'without rows' "
    "UNION ALL SELECT 'absent_declaration', n_name, n_name, 'without rows' FROM nation"
)
def gate_odd_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("declaration_id"))
    none = nation.select("declaration_id", F.lit(1).alias("rank"), F.col("declaration_id").alias("regulation_id"), F.lit(1.0).alias("score")).where("rank > 1")
    docs = nation.select(F.col("declaration_id").alias("regulation_id"))
    bare = evaluate.violations(none.select("declaration_id", "regulation_id"), nation, docs).withColumn("given", F.lit("without columns"))
    return bare.unionByName(evaluate.violations(none, nation, docs).withColumn("given", F.lit("without rows")))


# --- the whole ranking ----------------------------------------------------------------------------------

_ASKED = "asked AS (SELECT item_id, text || ' изделие ' || (item_id % 60) || ' мм' AS text FROM benchmark)"


@query(
    f"""WITH {_ASKED}, {_tfidf_sql('word', _TOKENS, 'asked')}, {_tfidf_sql('chars', _GRAMS, 'asked')}, {_rank_all_sql('word', 'r_word')}, {_rank_all_sql('chars', 'r_chars')},
st AS (SELECT query_id, doc_id, 3e0 / (60 + c.rank) + 1e0 / (60 + w.rank) AS score FROM r_chars c JOIN r_word w USING (query_id, doc_id)),
cand AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, doc_id) - 1 AS cand_pos FROM st QUALIFY cand_pos < 16),
ce AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, cand_pos) AS rank_ce FROM cand c JOIN documents USING (doc_id)),
f AS (SELECT query_id, doc_id, cand_pos, 1e0 / (61 + cand_pos) + 2e0 / (60 + rank_ce) AS f FROM ce),
adj AS (SELECT query_id, doc_id, cand_pos, f / max(f) OVER (PARTITION BY query_id) + 0.05::DOUBLE * CASE WHEN query_id % 60 > doc_id % 50 AND query_id % 60 <= doc_id % 50 + 20 THEN 1 ELSE -1 END AS score FROM f),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_pos) AS rank FROM adj QUALIFY rank <= 10)
SELECT query_id, rank, doc_id, round(min(score + (rank - 1) * 1e-9) OVER (PARTITION BY query_id ORDER BY rank) - (rank - 1) * 1e-9, 6) AS score FROM top"""
)
def rank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs of all pairs fused, 16 candidates reranked by a table of scores, adjusted by constraints, ten best, strictly falling."""
    asked = F.concat("text", F.lit(" изделие "), (F.col("item_id") % 60).cast("string"), F.lit(" мм"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("text"))
    documents = table(spark, sf_dir, "documents")
    low = F.col("doc_id") % 50
    wanted = F.concat(F.lit("изделие более "), low.cast("string"), F.lit(" мм, но не более "), (low + 20).cast("string"), F.lit(" мм"))
    docs = documents.select("doc_id", F.col("text").alias("coarse_text"), F.col("text").alias("fine_text"), wanted.alias("disc_text"))

    class ByLength:
        def score(self, pairs: DataFrame) -> DataFrame:
            lengths = documents.select("doc_id", F.col("n_chars").cast("double").alias("score"))
            return TableScorer(pairs.select("query_id", "doc_id").join(lengths, "doc_id")).score(pairs)

    config = ranking.Config(n_candidates=16, ce_weight=2.0, constraint_weight=0.05)
    return ranking.rank(queries, docs, config, ByLength()).select("query_id", "rank", "doc_id", rounded("score"))


_SIDES = "documents AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_type AS text FROM part), benchmark AS (SELECT DISTINCT p_size AS item_id, 'red widget ' || p_size AS text FROM part)"


@query(
    f"""WITH {_SIDES}, {_tfidf_sql('word', _TOKENS)}, {_rank_all_sql('word', 'r_word')},
v AS (SELECT q.item_id AS query_id, d.p_partkey AS doc_id, (q.item_id * d.p_size + 1e0) / (sqrt(q.item_id * q.item_id + 1e0) * sqrt(d.p_size * d.p_size + 1e0)) AS score FROM benchmark q, part d),
r_dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v),
st AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY 1e0 / (60 + rank) DESC, doc_id) AS rank FROM r_word),
fused AS (SELECT query_id, doc_id, 1e0 / (60 + s.rank) + 0.5::DOUBLE / (60 + d.rank) AS score FROM st s JOIN r_dense d USING (query_id, doc_id))
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10"""
)
def dense_fused_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 with a dense leg, as a catalogue of bounded size has it."""
    part = table(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" "), "p_type").alias("coarse_text"), F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("vector"))
    queries = part.select(F.col("p_size").cast("long").alias("query_id")).distinct().select("query_id", F.concat(F.lit("red widget "), F.col("query_id").cast("string")).alias("text"), F.array(F.col("query_id").cast("double"), F.lit(1.0)).alias("vector"))
    dense = dense_scores(queries.select(F.col("query_id").alias("id"), "vector"), docs.select(F.col("doc_id").alias("id"), "vector"))
    found = ranking.stage1(queries.drop("vector"), docs.drop("vector"), ranking.Config(weights={"word": 1.0}), dense)
    return found.where(F.col("rank") <= 10).select("query_id", "doc_id", "rank", rounded("score"))


# --- lemmas of unseen forms -----------------------------------------------------------------------

# Words of the documents in Cyrillic letters stand for stems; three declensions by the stem's last letter, forms by its length.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшщзы"
_BASE = ["а", "ь", ""]
_FORMS = [["ы", "е", "ами"], ["и", "ю", "ями"], ["ов", "у", "ом"]]
_WORDS_SQL = f"""w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
s AS (SELECT w, translate(w, '{_LATIN}', '{_CYRILLIC}') AS stem, (ascii(right(w, 1)) % 3)::INT AS class, (length(w) % 3)::INT AS form FROM w WHERE length(w) >= 4),
forms AS (SELECT w, stem || {_BASE}[class + 1] AS lemma, stem || {_FORMS}[class + 1][form + 1] AS token, ascii(w) % 2 = 0 AS known FROM s)"""


@query(
    f"""WITH {_WORDS_SQL},
given AS (SELECT DISTINCT token, lemma FROM forms WHERE known),
p AS (SELECT *, CASE WHEN len(same) = 0 THEN 0 WHEN list_position(same, false) > 0 THEN list_position(same, false) - 1 ELSE len(same) END AS st FROM
  (SELECT token, lemma, list_transform(range(1, least(length(token), length(lemma)) + 1), lambda i: substr(token, i, 1) = substr(lemma, i, 1)) AS same FROM given)),
pd AS (SELECT token, length(token) - st AS cut, substr(lemma, st + 1) AS add FROM p WHERE st >= 2),
ends AS (SELECT right(token, z) AS ending, cut, add FROM (SELECT *, unnest(range(greatest(cut, 1), least(6, length(token) - 2) + 1)) AS z FROM pd WHERE cut <= 6)),
c AS (SELECT ending, cut, add, count(*) AS n FROM ends GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY n DESC, cut, add) AS k FROM c) WHERE k = 1),
asked AS (SELECT DISTINCT token, lemma FROM forms WHERE NOT known AND token NOT IN (SELECT token FROM given)),
m AS (SELECT a.token, a.lemma, left(a.token, length(a.token) - r.cut) || r.add AS guess, row_number() OVER (PARTITION BY a.token, a.lemma ORDER BY z DESC) AS k
  FROM (SELECT *, unnest(range(1, least(6, length(token) - 2) + 1)) AS z FROM asked) a JOIN r ON r.ending = right(a.token, z) AND length(a.token) - r.cut >= 2)
SELECT token, lemma, guess FROM m WHERE k = 1"""
)
def lemma_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from half of the words' forms, applied to the forms of the other half."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where("length(w) >= 4").distinct()
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    kind, form, stem = (F.ascii(F.expr("right(w, 1)")) % 3), (F.length("w") % 3), F.translate("w", _LATIN, _CYRILLIC)
    inflected = F.when(kind == 0, pick(_FORMS[0], form)).when(kind == 1, pick(_FORMS[1], form)).otherwise(pick(_FORMS[2], form))
    forms = store.materialise(words.select(F.concat(stem, inflected).alias("token"), F.concat(stem, pick(_BASE, kind)).alias("lemma"), (F.ascii("w") % 2 == 0).alias("known")), "forms")
    given = forms.where("known").select("token", "lemma").distinct()
    asked = forms.where("not known").select("token", "lemma").distinct().join(given.select("token").distinct(), "token", "left_anti")
    return asked.join(lemmas.guessed(asked, lemmas.rules(given)).withColumnRenamed("lemma", "guess"), "token").select("token", "lemma", "guess")


# --- odd texts that parsing must take as they are, and samples of violations ------------------------

#: Text for each kind (# is the number), and the intervals that come of it: unit, lower bound, strict, upper bound, strict; the numbers added to #.
_ODD_INTERVALS = [
    ("азот #%", [("pct", 0, False, None, False)]),  # a comparator inside a word
    ("не свыше # кг", [("kg", 0, True, None, False)]),  # no negation of this word
    ("от # до 99 кг", []),  # the second comparator is taken for a unit
    ("более #, но не более 99 кг", [("kg", None, False, 99, False)]),  # a bound without a unit of its own
    ("не более # летний", [("year", None, False, 0, False)]),  # units by their beginning
    ("более 1 1# см3", []),  # a blank between thousands
    ("не более # мм, более 99 мм", [("mm", None, False, 0, False), ("mm", 99, True, None, False)]),  # an upper bound does not open
    ("не  более # кг", [("kg", 0, True, None, False)]),  # two blanks are no negation
    ("текстиль не менее # текстиль", [("tex", 0, False, None, False)]),
    ("менее #,5 годный", [("year", None, False, 0.5, True)]),
]
#: The same for quantities; their values are in the SQL.
_ODD_QUANTITIES = [("20#0 года", ["year"]), ("1 #00 см3", []), ("# мм2", ["mm"]), ("масса #,25 кг нетто, 5 %", ["kg", "pct"]), ("#об.%", ["pct_vol"]), ("# тыс", [])]


def _odd_text(kinds: list, key: Column, number: Column) -> Column:
    """The text of a row's kind with its number."""
    texts = F.element_at(F.array(*[F.lit(text) for text, _ in kinds]), (key % len(kinds) + 1).cast("int"))
    return F.replace(texts, F.lit("#"), number.cast("string"))


def _bound_sql(added: float | None) -> str:
    return "NULL::DOUBLE" if added is None else f"{added}::DOUBLE" if added == 99 else f"(p_size + {added})::DOUBLE"


@query(
    " UNION ALL ".join(
        f"SELECT p_partkey, {pos}::BIGINT AS pos, '{unit}' AS unit, {_bound_sql(lo)} AS lo, {ls} AS lo_strict, {_bound_sql(hi)} AS hi, {hs} AS hi_strict FROM part WHERE p_partkey % {len(_ODD_INTERVALS)} = {kind}"
        for kind, (_, found) in enumerate(_ODD_INTERVALS)
        for pos, (unit, lo, ls, hi, hs) in enumerate(found)
    )
)
def interval_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose reading surprises, kept as it is: what the patterns take is what counts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _odd_text(_ODD_INTERVALS, F.col("p_partkey"), F.col("p_size")).alias("text"))
    return constraints.interval_rows(parts).select(F.col("doc_id").alias("p_partkey"), F.col("pos").cast("long").alias("pos"), "unit", "lo", "lo_strict", "hi", "hi_strict")


@query(
    "SELECT p_partkey, 0::BIGINT AS pos, 'year' AS unit, ('20' || p_size || '0')::DOUBLE AS value FROM part WHERE p_partkey % 6 = 0 UNION ALL "
    "SELECT p_partkey, 0, 'mm', p_size FROM part WHERE p_partkey % 6 = 2 UNION ALL SELECT p_partkey, 0, 'kg', p_size + 0.25::DOUBLE FROM part WHERE p_partkey % 6 = 3 UNION ALL "
    "SELECT p_partkey, 1, 'pct', 5 FROM part WHERE p_partkey % 6 = 3 UNION ALL SELECT p_partkey, 0, 'pct_vol', p_size FROM part WHERE p_partkey % 6 = 4"
)
def quantity_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), _odd_text(_ODD_QUANTITIES, F.col("p_partkey"), F.col("p_size")).alias("text"))
    return constraints.quantity_rows(parts).select(F.col("query_id").alias("p_partkey"), F.col("pos").cast("long").alias("pos"), "unit", "value")


@query(f"SELECT rule, declaration_id, detail FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY declaration_id, detail) AS k FROM ({ORACLE['validate_gate']})) WHERE k <= 5")
def violation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each rule's violations, in order."""
    order = Window.partitionBy("rule").orderBy("declaration_id", "detail")
    found = QUERIES["validate_gate"](spark, sf_dir).withColumn("k", F.row_number().over(order))
    return found.where("k <= 5").drop("k")
