import itertools

from pyspark.sql import functions as F

from lexigrove.functions.quantities import unit
from lexigrove.operators import constraints as c


def intervals(spark, *texts):
    rows = c.interval_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    return [(r.unit, r.lo, r.lo_strict, r.hi, r.hi_strict) for r in rows]


def test_intervals(spark):
    assert intervals(spark, "более 0,05 мас.%, но не более 0,2 мас.%") == [("pct_mass", 0.05, True, 0.2, False)]
    assert intervals(spark, "не более 40 % хлопка и более 47 %") == [("pct", None, False, 40.0, False), ("pct", 47.0, True, None, False)]
    assert intervals(spark, "азот 5%") == [("pct", 5.0, False, None, False)]  # "от" inside a word
    assert intervals(spark, "не свыше 5 кг") == [("kg", 5.0, True, None, False)]
    assert intervals(spark, "от 5 до 10 кг") == []  # the first unit swallows the second comparator
    assert intervals(spark, "более 5, но не более 10 кг") == [("kg", None, False, 10.0, False)]
    assert intervals(spark, "более 1 500 см3", "", None) == []


def test_quantities_and_subjects(spark):
    rows = c.quantity_rows(spark.createDataFrame([(1, "Сера 0,12 мас.%, масса нетто 5 кг, летний 3 лет")], "query_id long, text string")).orderBy("pos").collect()
    assert [(r.unit, r.value) for r in rows] == [("pct_mass", 0.12), ("kg", 5.0), ("year", 3.0)]
    assert rows[0].subject == ["сера"] and rows[1].subject == ["сера", "мас", "масса", "нетто"]


def signal(spark, regulation, declaration):
    docs = spark.createDataFrame([(1, regulation)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, declaration)], "query_id long, text string")
    pairs = spark.createDataFrame([(7, 1)], "query_id long, doc_id long")
    return c.signal(pairs, c.interval_rows(docs), c.quantity_rows(queries)).first().signal


def test_signal(spark):
    between = "серы более 0,05 мас.%, но не более 0,2 мас.%"
    assert signal(spark, between, "серы 0,12 мас.%") == 1
    assert signal(spark, "серы не более 0,05 мас.%", "серы 0,12 мас.%") == -1
    assert signal(spark, between, "цвет синий") == 0
    assert signal(spark, "прочие", "серы 0,12 мас.%") == 0
    assert signal(spark, between, "серы 0,12 %") == 1  # any percentage, where none of the unit
    assert signal(spark, "масса нетто более 5 кг", "упаковка 1 кг, масса нетто 6 кг") == 1  # more subject words
    assert signal(spark, "более 5 кг", "6 кг, 1 кг") == 0  # a tie says nothing
    assert signal(spark, "более 5 кг и менее 3 мм", "6 кг, 9 мм") == -1


def test_verdict_is_one_of_three(spark):
    for bound, value in itertools.product(("более", "не более", "до", "ниже"), (1, 5, 9)):
        assert signal(spark, f"{bound} 5 кг", f"{value} кг") in (-1, 0, 1)


def test_units_by_order_of_preference(spark):
    raw = ["мас.%", " .мас. % сухих", "мм2", "м", "годы", "%об", ".,%;", "", None]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select(unit(F.col("raw")).alias("u")).collect()
    assert [r.u for r in rows] == ["pct_mass", "pct_mass", "mm", None, "year", "pct", "pct", None, None]


def test_catalogue_texts_are_parsed_by_many_tasks(spark, tmp_path):
    """One small file is not one task; quantities without subjects are the same quantities."""
    path = str(tmp_path / "docs")
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("более "), "id", F.lit(" кг")).alias("text")).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    found = c.interval_rows(docs)
    assert found.count() == 400 and found.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    rows = docs.select(F.col("doc_id").alias("query_id"), "text")
    bare = c.quantity_rows(rows, subjects=False)
    assert "subject" not in bare.columns and sorted(bare.collect()) == sorted(c.quantity_rows(rows).drop("subject").collect())


def test_signal_is_the_same_in_more_partitions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"масса более {i} кг") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"масса {i} кг") for i in range(40)], "query_id long, text string")
    pairs = spark.range(40).select(F.col("id").alias("query_id"), ((F.col("id") * 7) % 40).alias("doc_id"))
    monkeypatch.setattr(c.store, "PART_ROWS", 5)
    rows = c.signal(pairs, c.interval_rows(docs), c.quantity_rows(queries)).collect()
    assert {(r.query_id, r.signal) for r in rows} == {(i, 1.0 if i > i * 7 % 40 else -1.0) for i in range(40)}
