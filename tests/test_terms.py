"""Terms counted in arrays against postings, and legs of texts against legs of postings."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobs import match_catalogue
from lexigrove import queries, store
from lexigrove.functions import text as tx
from lexigrove.operators import products, retrieval, terms

ODD = ["", None, " ", "a", "the a, 12,5 x1", "Ёлка елка И в ёж", "aaaaaaaa aaaaaaaa b", "x" * 400, "İstanbul ΣΑΣ   straße", "\U0001f600\U0001f600 ok \U00010400\U00010400\U00010400", "1 2 3 10 10"]


def odd_texts(spark, n=120):
    rng = random.Random(5)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(300)] + ["common", "tariff", "code"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + rng.randrange(n // 2), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return spark.createDataFrame(rows + [(7, "aaaaaaaa again"), (None, "without id"), (None, "id without")], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["char", "word"])
def test_statistics_are_those_of_postings(spark, monkeypatch, kind, small):
    if small:
        for name, value in {"WORDS": 40, "PAIRS": 60, "HELD_TERMS": 30, "COUNT_BITS": 1}.items():
            monkeypatch.setattr(terms, name, value)
    texts = odd_texts(spark)
    rows = retrieval.text_postings(texts, "doc_id", "text", kind).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
    assert sorted(retrieval.term_statistics(texts, "doc_id", "text", kind).collect()) == sorted(rows.collect())


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("name", ["char", "word", "bm25"])
def test_legs_of_texts_are_those_of_postings(spark, monkeypatch, name, small):
    if small:
        for where, key, value in ((terms, "WORDS", 40), (terms, "PAIRS", 60), (products, "CELLS", 300), (products, "HELD", 20)):
            monkeypatch.setattr(where, key, value)
    texts = odd_texts(spark).where("doc_id is not null")
    asked = spark.createDataFrame([(1, "common w3 tariff w7"), (2, "aaaaaaaa елка"), (3, ""), (4, "nowhere")], "query_id long, text string")
    kind, size = ("char" if name == "char" else "word"), retrieval.corpus_size(texts)
    make = retrieval.bm25_leg if name == "bm25" else retrieval.tfidf_leg
    old = make(retrieval.text_postings(asked, "query_id", "text", kind), retrieval.text_postings(texts, "doc_id", "text", kind), size)
    new = retrieval.text_leg(asked, texts, "text", size, kind, name == "bm25")
    assert new.vectors is not None
    shown = lambda rows: {(r.query_id, r.doc_id): round(r.score, 9) for r in rows.collect()}
    want = shown(retrieval.pair_scores(old))
    assert shown(retrieval.pair_scores(new)) == want
    first = lambda leg: {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in retrieval.top(products.best(leg, 6), 6).collect()}
    assert first(new) == first(old)
    ids = texts.select("doc_id").distinct()
    pairs = asked.select("query_id").crossJoin(ids)
    ranks = lambda leg: sorted((r.query_id, r.doc_id, r["rank"]) for r in products.ranks_of(leg, pairs, retrieval.places(ids), ids.count()).collect())
    assert ranks(new) == ranks(old)


def test_vocabularies_too_large_to_send_are_joined(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SENT_WEIGHTS", 3)
    texts = odd_texts(spark).where("doc_id is not null")
    leg = retrieval.text_leg(spark.createDataFrame([(1, "common w3")], "query_id long, text string"), texts, "text", retrieval.corpus_size(texts), "word")
    assert leg.vectors is None and retrieval.top(products.best(leg, 3), 3).count() == 3


def test_no_row_for_a_term_of_a_document(spark, tmp_path, monkeypatch):
    """Neither the plans nor the tables on the way have one: a thousand copies of a text are no more rows than one."""
    texts = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("char_ngram_counts", "token_df_idf"):
        assert "Generate" not in queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    written, write = {}, store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, label, records=None: written.setdefault(label, write(df, label, records)))
    asked = spark.createDataFrame([(1, "two three")], "query_id long, text string")
    assert products.best(retrieval.text_leg(asked, texts, "text", retrieval.corpus_size(texts), "char"), 3).count() >= 3
    assert max(t.count() for t in written.values()) <= 1000


@pytest.mark.parametrize("name", ["char", "word", "bm25"])
def test_vocabularies_sent_in_passes(spark, monkeypatch, name):
    """More terms than are sent at once take several looks at the texts, never a row for a term of a document."""
    texts = odd_texts(spark).where("doc_id is not null")
    asked = spark.createDataFrame([(1, "common w3 tariff w7"), (2, "aaaaaaaa елка")], "query_id long, text string")
    leg = lambda: retrieval.text_leg(asked, texts, "text", retrieval.corpus_size(texts), "char" if name == "char" else "word", name == "bm25")
    shown = lambda rows: {(r.query_id, r.doc_id): round(r.score, 9) for r in rows.collect()}
    whole = shown(retrieval.pair_scores(leg()))
    monkeypatch.setattr(retrieval, "SENT_WEIGHTS", {"char": 300, "word": 40, "bm25": 2}[name])
    passes, one = [], terms._passed
    monkeypatch.setattr(terms, "_passed", lambda *a: passes.append(a) or one(*a))
    parted = leg()
    assert parted.vectors is not None and len(passes) > 1 and max(a[4].count() for a in passes) < sum(a[4].count() for a in passes)
    assert shown(retrieval.pair_scores(parted)) == whole


def test_terms_are_found_by_hash_and_name(spark):
    names = [f"t{k}" for k in range(50)] + ["елка", "\U0001f600", ""]
    rows = spark.createDataFrame([(n, float(k), k) for k, n in enumerate(names)], "term string, weight double, t long")
    known = terms.Known(rows.select("*", F.xxhash64("term").alias("h")).toArrow().sort_by("h"))
    clash = terms.Known(rows.select("*", F.xxhash64(F.lit("t3")).alias("h")).toArrow())
    for table, asked in ((known, ["елка", "t7", "absent", "\U0001f600", "", "t49"]), (clash, ["t3"])):
        want = [float(names.index(n)) if n in names else -1.0 for n in asked]
        assert [float(table.weight[k]) if k >= 0 else -1.0 for k in table.find(pa.array(asked))] == want
    assert known.find(pa.array([], pa.string())).tolist() == [] and terms.Known(rows.limit(0).select("*", F.xxhash64("term").alias("h")).toArrow()).find(pa.array(["a"])).tolist() == [-1]


def looks_at(monkeypatch):
    looks, dealt = [], terms._dealt
    monkeypatch.setattr(terms, "_dealt", lambda *a: looks.append(a) or dealt(*a))
    return looks


def test_all_legs_come_from_two_looks_at_the_texts(spark, tmp_path, monkeypatch):
    """However many legs are fused, texts are shuffled and cut twice: for the counts of terms and for the vectors."""
    texts = odd_texts(spark, 60).where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("lang", F.lit("en"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "common w3 tariff w7"), (2, "aaaaaaaa елка")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    looks = looks_at(monkeypatch)
    assert queries.QUERIES["rrf_fused_top10"](spark, str(tmp_path)).count() == 20 and len(looks) == 2
    match_catalogue.run(spark, str(tmp_path / "benchmark.parquet"), str(tmp_path / "documents.parquet"), str(tmp_path / "out"))
    assert len(looks) == 4


def test_legs_made_together_are_those_made_apart(spark, monkeypatch):
    texts = odd_texts(spark).where("doc_id is not null")
    asked = spark.createDataFrame([(1, "common w3 tariff w7"), (2, "aaaaaaaa елка"), (3, ""), (4, "nowhere")], "query_id long, text string")
    names, size = {"char": ("char", False), "word": ("word", False), "bm25": ("word", True)}, retrieval.corpus_size(texts)
    shown = lambda leg: {(r.query_id, r.doc_id): round(r.score, 9) for r in retrieval.pair_scores(leg).collect()}
    made = retrieval.text_legs(asked, texts, "text", size, names)
    apart = {name: shown(retrieval.text_leg(asked, texts, "text", size, *kind)) for name, kind in names.items()}
    assert {name: shown(leg) for name, leg in made.items()} == apart
    monkeypatch.setattr(retrieval, "SENT_WEIGHTS", 40)
    monkeypatch.setattr(retrieval, "PASSES", 100)
    looks = looks_at(monkeypatch)
    assert {name: shown(leg) for name, leg in retrieval.text_legs(asked, texts, "text", size, names).items()} == apart and len(looks) > 4


def test_tokens_of_words_are_those_of_the_text(spark):
    odd = ["a\u00a0bb\u202fcc,5,x 1.5.2", "ΟΔΟΣ\u00a0ёж12 Ё-Ё ёё", "x\u001cyy\u0085zz\u2028ww\u200bvv", "\n\tи из,12 12,и .55 5.", None, "\x00nul l"]
    texts = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    rows = texts.select("doc_id", F.explode(tx.tokenise(F.col("text"))).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("n"))
    assert sorted(terms.statistics(texts, "doc_id", "text", terms.tokens()).collect()) == sorted(rows.collect())


def test_packed_numbers_and_numbers_without_gaps(spark):
    numbers, each = np.arange(7, dtype=np.int64) * 1000, np.array([3, 0, 4, 0])
    column = terms.packed(numbers, each)
    for a, b, want in ((0, 4, range(7)), (1, 2, range(3, 7)), (3, 1, []), (0, 0, [])):
        t, n = terms.unpacked(column.slice(a, b))
        assert (t // 1000).tolist() == list(want) and n.tolist() == each[a : a + b].tolist()
    rows = terms.numbered(spark.range(1000).repartition(7), "numbered").collect()
    assert sorted(r.t for r in rows) == list(range(1000)) and {r.id for r in rows} == set(range(1000))


def test_words_are_those_that_spark_splits(spark):
    """At every white space that Java knows and at no other character, whatever Arrow takes for white space."""
    texts = [f"a{chr(c)}b c" for c in range(1, 0x3100)] + [" a  b ", "", "a", "\x1c", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: [w for w in r.words if w] for r in rows.select("id", tx.split_words(F.col("text")).alias("words")).collect()}
    lower = [r[0] for r in rows.orderBy("id").select(F.lower("text")).collect()]
    for some in ([k for k, t in enumerate(texts) if not set(t) & set("\x1c\x1d\x1e\x1f")], range(len(texts))):
        found = terms.split(pa.array([lower[k] for k in some]))
        assert {k: [w for w in v if w] for k, v in zip(some, found.to_pylist(), strict=True)} == {k: want[k] for k in some}
