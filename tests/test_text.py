from pyspark.sql import functions as F

from lexigrove.functions import text as tx


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return row.select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, tx.raw_tokens(F.col("t")), t="колесо 0,12 мас.% 5w-30 1598") == ["колесо", "0,12", "мас", "5w", "30", "1598"]
    assert one(spark, tx.tokenise(F.col("t")), t="Ёлка и к x ель") == ["елка", "ель"]
    assert one(spark, tx.tokenise(F.col("t")), t="") == []


def test_char_grams(spark):
    assert one(spark, tx.char_grams(F.col("t")), t="Ab  c") == [" ab", "ab ", " ab ", " c "]
    assert one(spark, tx.char_grams(F.col("t")), t="abc") == [" ab", "abc", "bc ", " abc", "abc ", " abc "]


def test_numbers(spark):
    assert one(spark, tx.numbers(F.col("t")), t="0,5 x7 8.25, 9") == [0.5, 8.25, 9.0]


def test_short_family(spark):
    assert one(spark, tx.short_family(F.col("t"), 10), t=" нефть; прочие") == "нефть"
    assert one(spark, tx.short_family(F.col("t"), 10), t="нефть сырая тяжелая") == "нефть…"
    assert one(spark, tx.short_family(F.col("t"), 5), t="нефтепродукты") == "нефте…"


def test_trim_to_word(spark):
    cut = tx.trim_to_word(F.col("t"), F.col("k"))
    assert one(spark, cut, t="трубы стальные", k=8) == "стальные"
    assert one(spark, cut, t="трубы стальные", k=0) == "трубы стальные"
    assert one(spark, cut, t="трубы", k=5) == "трубы"


def test_lemmas(spark):
    tokens = spark.createDataFrame([("трубы",), ("pipe",), ("колесо",)], "token string")
    lemmas = spark.createDataFrame([("трубы", "труба"), ("pipe", "x")], "token string, lemma string")
    assert {r.token for r in tx.lemmatise(tokens, lemmas).collect()} == {"труба", "pipe", "колесо"}


def test_join_and_declaration(spark):
    assert one(spark, tx.join_parts(F.lit("a"), F.col("t"), F.lit("b")), t="") == "a | b"
    assert one(spark, tx.declaration_text(F.lit("a "), F.col("t")), t=" b") == "a. b"
    assert one(spark, tx.passage(F.col("t"), "multilingual-e5-base", True), t="x") == "query: x"
