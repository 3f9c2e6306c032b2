import random

import pytest
from pyspark.sql import functions as F

from lexigrove import store
from lexigrove.operators import tree, views
from lexigrove.sources import files

DUMP = """шапка | не узел
ИЕРАРХИЯ ТН ВЭД
V | Минеральные продукты
27 | Топливо минеральное
2710 | Нефть и нефтепродукты; прочие
   | – газойли:
      2710194290 | – – серы не более 0,05 мас.% [газойли низкосернистые]
      2710194600 | – – серы более 0,05 мас.%, но не более 0,2 мас.% [a [b] c]
      2710194800 | — - прочие
строка без черты
   |
ПРИМЕЧАНИЯ
99 | не узел
ИЕРАРХИЯ ТН ВЭД
2710194800 | – повтор"""


def nodes(spark):
    rows = tree.lines(spark.createDataFrame([("f", DUMP)], "file string, value string"))
    return tree.with_labels(tree.linked(tree.parsed(tree.sections(rows))))


def test_tree(spark):
    found = {r.line_no: r for r in nodes(spark).collect()}
    assert sorted(found) == [2, 3, 4, 5, 6, 7, 8, 14]
    assert [found[k].depth for k in (2, 3, 4, 5, 6, 7, 8, 14)] == [0, 1, 2, 3, 4, 4, 4, 3]
    assert found[2].code is None and found[3].code == "27" and found[5].code is None
    assert found[5].label == "газойли" and found[6].gloss == "газойли низкосернистые" and found[7].gloss is None
    assert found[6].ancestors == [2, 3, 4, 5] and found[6].parent == 5 and found[14].ancestors == []
    assert [x.label for x in found[8].chain] == ["Минеральные продукты", "Топливо минеральное", "Нефть и нефтепродукты; прочие", "газойли"]
    assert {r.parent: r.children for r in tree.children(nodes(spark)).collect()}[5] == [6, 7, 8]


def test_ancestors_skip_closed_branches(spark):
    depths = [0, 1, 2, 3, 4, 4, 3, 5, 2]
    rows = spark.createDataFrame([("f", 1, i + 1, d) for i, d in enumerate(depths)], "file string, section int, line_no int, depth int")
    found = {r.line_no: r.ancestors for r in tree.linked(rows).collect()}
    assert found[8] == [1, 2, 3, 7] and found[9] == [1, 2]


def test_levels_have_no_limit(spark):
    rows = spark.createDataFrame([("f", 1, k, k) for k in range(40)] + [("f", 1, 40, 30)], "file string, section int, line_no int, depth int")
    found = {r.line_no: r.ancestors for r in tree.linked(rows).collect()}
    assert all(found[k] == list(range(k)) for k in range(40)) and found[40] == list(range(30))
    assert tree.linked(rows.limit(0)).count() == 0


def test_first_code_wins(spark):
    found = {r.code: r for r in tree.by_code(nodes(spark)).collect()}
    assert found["2710194800"].line_no == 8 and found["2710194800"].label == "прочие"


def test_prefix(spark):
    rows = spark.createDataFrame([("a", "труба стальная"), ("a", "труба медная"), ("b", "x"), ("c", "q"), ("c", "q"), ("d", ""), ("d", "z")], "g string, t string")
    assert {r.g: r.prefix_len for r in views.prefix_by_group(rows, "g", "t").collect()} == {"a": 6, "b": 0, "c": 1, "d": 0}


def test_shared(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("a", ["x", "z"]), ("b", ["x"])], "g string, p array<string>")
    found = {r.g: r.shared for r in views.shared_values(rows, "g", "p").collect()}
    assert found == {"a": ["x"], "b": []}
    assert spark.range(1).select(views.without(F.array(F.lit("y"), F.lit("x"), F.lit("y")), F.array(F.lit("x"))).alias("o")).first().o == ["y", "y"]


def test_catalogue(spark):
    entries = spark.createDataFrame(
        [("R1", "2710194290", "Газойли с серой до 0,05", None), ("R2", "2710194800", "Газойли прочие", "топливо"), ("R3", "9999999999", " соль ", None)],
        "regulation_id string, code string, description string, explanation string",
    )
    found = {r.regulation_id: r for r in views.catalogue(entries, tree.by_code(nodes(spark))).collect()}
    assert found["R1"].coarse_text == "Топливо минеральное | Нефть и нефтепродукты; прочие | Газойли с серой до 0,05"
    assert found["R1"].path == ["газойли"] and found["R1"].shared == ["газойли"]
    assert found["R1"].fine_text == "Нефть и нефтепродукты | газойли | серы не более 0,05 мас.% | газойли низкосернистые | с серой до 0,05"
    assert found["R1"].disc_text == "серы не более 0,05 мас.% | с серой до 0,05"
    assert found["R3"].disc_text == "соль" and found["R3"].coarse_text == "соль"


def random_dump(rng, n):
    """Lines of several sections with nodes of any depth, lines that are none, and nodes outside sections."""
    out = []
    for k in range(n):
        roll = rng.random()
        if roll < 0.02:
            out.append(rng.choice([f"{tree.BEGIN} {k}", f"  {tree.END[0]}", tree.END[1]]))
        elif roll < 0.1:
            out.append(rng.choice(["", "no node", "  "]))
        else:
            out.append(f"{rng.choice(['', '10', '0203', '0203110000', 'IV'])} | {'– ' * rng.randrange(6)}label {k}")
    return out


def stacked(lines):
    """(section, line) to its ancestors, by one stack a section, from parsed depths by line."""
    found, section, inside, stack = {}, 0, False, []
    for k, (value, depth) in enumerate(lines):
        bare = value.strip(" ")
        if bare.startswith(tree.BEGIN):
            section, inside, stack = section + 1, True, []
        elif bare.startswith(tree.END):
            inside = False
        elif inside and depth is not None:
            while stack and stack[-1][0] >= depth:
                stack.pop()
            found[section, k] = [i for _, i in stack]
            stack.append((depth, k))
    return found


def test_blocks_of_any_size_give_the_same_tree(spark):
    rng = random.Random(8)
    texts = {name: random_dump(rng, n) for name, n in (("a", 400), ("b", 90), ("c", 1), ("d", 0))}
    texts["a"] = [tree.BEGIN] + texts["a"]
    rows = spark.createDataFrame([(f, k, v) for f, own in texts.items() for k, v in enumerate(own)], "file string, line_no long, value string")
    depth = {(r.file, r.line_no): r.depth for r in tree.parsed(rows).collect()}
    want = {(f, *key): up for f, own in texts.items() for key, up in stacked([(v, depth.get((f, k))) for k, v in enumerate(own)]).items()}
    for block in (1, 7, 1 << 13):
        got = tree.linked(tree.parsed(tree.sections(rows, block)), block).collect()
        assert {(r.file, r.section, r.line_no): r.ancestors for r in got} == want
        assert all(r.parent == (r.ancestors[-1] if r.ancestors else None) for r in got)


def test_one_section_is_many_tasks(spark):
    """No window of the plan is over a file or section alone, but for a row a block."""
    rows = spark.range(40000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, tree.BEGIN).otherwise(F.concat(F.lit("0203 | "), F.repeat(F.lit("– "), (F.col("id") % 4).cast("int")), F.lit("x"))).alias("value"))
    linked = tree.linked(tree.parsed(tree.sections(rows, 1000)), 1000)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(key, "false")
        sizes = [r["count"] for r in linked.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("count"), F.max("ancestors")).collect()]
    finally:
        spark.conf.unset(key)
    assert sum(sizes) == 39999 and max(sizes) < 30000
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "line_no" in line]
    assert windows and all("block" in line for line in windows)


@pytest.mark.parametrize("end", ["\r\n", None])
def test_lines_of_files_that_are_cut_anywhere(spark, tmp_path, monkeypatch, end):
    rng = random.Random(9)
    for name in ("x", "y"):
        lines = ["".join(rng.choice("abé | –") for _ in range(rng.randrange(5))) for _ in range(5)]
        body = "".join(line + (end or rng.choice(["\n", "\r\n", "\r"])) for line in lines) + rng.choice(["", "last"])
        (tmp_path / f"{name}.txt").write_bytes(body.encode())
    size = max((tmp_path / f"{n}.txt").stat().st_size for n in ("x", "y"))
    whole = tree.lines(spark.read.text(str(tmp_path), wholetext=True).withColumn("file", F.col("_metadata.file_path"))).collect()
    want = {(r.file, r.line_no): r.value for r in whole}
    want = {(f, k): v for (f, k), v in want.items() if v or (f, k + 1) in want}  # nothing comes after a last line end
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    written = store.materialise

    def then_whole(*args):
        try:
            return written(*args)
        finally:  # what was written is not cut any more
            for k in keys:
                spark.conf.unset(k)

    monkeypatch.setattr(store, "materialise", then_whole)
    for cut in (1, 2, 3, 5, size // 2):
        spark.conf.set(keys[0], str(cut))
        spark.conf.set(keys[1], "1")
        assert {(r.file, r.line_no): r.value for r in files.dump(spark, str(tmp_path)).collect()} == want
