"""Nulls, repeated rows, hot keys, long texts, clashing names and empty tables, operator by operator."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove import store
from lexigrove.llm import chat, components, decontaminate, hnsw, html, mixing, neardup, secrets, shingles, tokens
from tests.llm.test_corpus import corpus, edited, prose


def test_near_duplicates_of_shared_ids(spark):
    """A document links by every text that its id has, in whatever order the rows come."""
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (7, edited(rng, a, 1)), (8, b), (8, b), (9, prose(rng, 60)), (9, None), (2, None)]
    want = {5: 5, 7: 5, 8: 5, 9: 9, 2: 2}
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        found = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == want and all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_a_large_family_and_its_excerpts(spark):
    """Hundreds of copies, excerpts of the original among themselves, and a passage that unlike documents share."""
    rng = random.Random(4)
    base = prose(rng, 300)
    own = base.split()
    texts = [edited(rng, base, rng.randrange(30)) for _ in range(150)] + [" ".join(own[s : s + n]) for s in range(0, 200, 4) for n in (60, 66)]
    texts += [" ".join(own[:100]) + " " + prose(rng, 70) for _ in range(60)]
    sets = [shingles.shingle_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [root(i) for i in range(len(texts))]


def test_keys_hold_ids(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    rows = spark.createDataFrame([(i, neardup._key(i, np.array([1, 2]))) for i in ids], "id long, key binary")
    assert rows.where(neardup.key_id(F.col("key")) != F.col("id")).count() == 0
    assert [r.id for r in rows.orderBy("key").collect()] == sorted(ids)


@pytest.mark.parametrize("left", [0, 7, 10**6])
def test_components(spark, monkeypatch, left):
    monkeypatch.setattr(components, "LEFT", left)
    rng = random.Random(left)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 200 + k) for k in range(50)] + [(3, 3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def least(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        return min(seen)

    got = {r.node: r.root for r in components.roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: least(x) for x in near if near[x] - {x}}
    assert components.roots(spark.createDataFrame([(1, 1)], "a long, b long")) is None


def test_mixing_equal_rows(spark):
    """Many equal rows are one entry, and rows of their own in the result."""
    rows = spark.range(40000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    others = spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.lit("four five").alias("text"), F.lit("b").alias("source"))
    frame = rows.union(others)
    began = time.time()
    got = mixing.copies(frame)
    seven = got.where("doc_id = 7").groupBy("copies").count().collect()
    assert time.time() - began < 60 and sum(r["count"] for r in seven) == 40000 and got.count() == 40300
    target = got.where("doc_id = 7").first().target
    assert abs(sum(3 * r["copies"] * r["count"] for r in seven) - target) <= 3 and max(r["copies"] for r in seven) - min(r["copies"] for r in seven) <= 1
    mixed = mixing.mix(frame)
    assert mixed.where("doc_id = 7").count() == sum(r["copies"] * r["count"] for r in seven)


def test_mixing_of_any_columns(spark):
    frame = spark.createDataFrame([(i, f"w{i} x", "s", {"k": i}, i, i, i) for i in range(50)] + [(None, "a b", None, {}, 1, 2, 3)], "doc_id long, text string, source string, m map<string,int>, mix_doc long, twin int, key int")
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.schema == frame.schema
    taken = {r.doc_id: r.copies for r in mixing.copies(frame).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
    assert all(r.m == {"k": r.doc_id} and r.mix_doc == r.twin == r.key == r.doc_id for r in mixed.where("doc_id is not null").collect())


def test_nearest_of_shared_ids(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [(100, v(1, 1)), (100, v(1, 1)), (100, v(5, 5)), (3, v(1, 1)), (3, v(2, 1)), (200, v(9, 9)), (200, v(-0.0, 9))]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    near = [(3, 0.0), (100, 0.0), (3, 1.0), (100, 4 * 2**0.5), (200, 65**0.5), (200, 8 * 2**0.5)]
    assert [got[100][k] for k in sorted(got[100])] == [(i, pytest.approx(s)) for i, s in near]
    assert sorted(got[200]) == [1, 2, 3, 4, 5, 6] and got[200][1][0] == 100


def test_graph_recall():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(3000, 24)), rng.normal(size=(8, 24))[rng.integers(8, size=2000)] + 0.05 * rng.normal(size=(2000, 24))])
    order, graphs = hnsw.build(x, rng)
    y = x[order]
    q = y[::50]
    ids, dist = hnsw.search(q, y, graphs[0], hnsw.descend(q, y, graphs[1:]), hnsw.EF_SEARCH)
    d = ((q[:, None, :] - y[None]) ** 2).sum(2)
    true = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) for a, b in zip(true.tolist(), ids.tolist(), strict=True)]) >= 9.8
    assert (np.diff(dist[:, :10], axis=1) >= 0).all()


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(5)
    item = prose(rng, 30)
    long = prose(rng, 20000) + " " + item + " " + prose(rng, 20000)
    rows = [(1, long), (1, long), (None, f"x {item} y"), (None, None), (4, " ".join([item] * 300)), (5, "clean words here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("row", F.lit(1))
    items = spark.createDataFrame([(0, item), (0, item), (1, item), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(frame, items).collect()}
    assert got == {(1, 0): (20000, 1.0), (1, 1): (20000, 1.0), (None, 0): (1, 1.0), (None, 1): (1, 1.0), (4, 0): (0, 1.0), (4, 1): (0, 1.0)}


def test_threshold_windows_are_found(spark):
    """Edited passages just above the threshold: the multi-index finds what an exact search does."""
    rng = random.Random(6)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(70)) for _ in range(40)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for e in range(1, 6):
            own = item.split()
            for at in rng.sample(range(6, 64), e):
                own[at] = f"edit{rng.randrange(10**6)}"
            w, o = item.split(), own
            a, b = ({tuple(x[i : i + 5]) for i in range(66)} for x in (w, o))
            if len(a & b) / len(a | b) >= 0.75:
                want.add((len(texts), k))
            texts.append(f"before it {' '.join(own)} after it")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus(spark, texts), benchmark).collect()}
    assert got == want and len(want) > 30


def test_html_of_any_kind_takes_linear_time():
    pages = ["<a '" * 300000, "<a '" * 300000 + ">", "<a '>'" * 200000, "<div>" * 150000 + "</x>" * 150000, "<div>" * 150000 + "</p>" * 150000, "</script " * 200000, "<" * 10**6, "<i>" * 150000 + "<p>" * 80000]
    began = time.time()
    for page in pages:
        html.blocks(page)
    assert time.time() - began < 30
    assert html.blocks("<p>foo<img src=x>bar <script>a</script>baz<wbr>q<hr>z</p>") == [(html.OPEN, "foobar bazq"), (html.OPEN, "z")]
    assert html.blocks("a<b 'c>d' e>f") == [(html.OPEN, "af")] and html.blocks("1 < 2 <b") == [(html.OPEN, "1 < 2 <b")]


def test_secrets_of_a_long_text(spark):
    rng = random.Random(7)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(4000)]
    frame = spark.createDataFrame([(1, " / ".join(hexes)), (1, " / ".join(hexes)), (None, "password=abcdefghijklmnop")], "doc_id long, text string").withColumn("spans", F.lit(0))
    began = time.time()
    got = secrets.find(frame).collect()
    assert time.time() - began < 60 and sorted((r.doc_id or 0, r.n_hex, r.n_assign) for r in got) == [(0, 0, 1), (1, 4000, 0), (1, 4000, 0)]


def test_chat_of_long_and_repeated_turns(spark):
    long = "word " * 200000
    turns = [(1, c, t, r, x) for c in (True, False) for t, r, x in [(0, "user", long), (1, "assistant", "a" if c else "b"), (1, "assistant", "a" if c else "b"), (2, None, None)]]
    frame = spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string").withColumn("prompt", F.lit(1))
    r = chat.format_preferences(frame).first()
    assert r.n_prompt_turns == 1 and r.prompt == f"<|user|>\n{long}<|end|>\n" and r.chosen.count("<|assistant|>\na") == 2 and r.rejected.count("<|assistant|>\nb") == 2


def _write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone_id long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda bad: " ".join(["vilebad" if bad and k in (3, 9) else word() for k in range(40)])
    rows = [(i, text(i % 5 == 0), "en", "s", i) for i in range(200)]
    labels = [(i, 0, int(i % 5 == 0)) for i in range(200)]
    item = " ".join(word() for _ in range(20))
    rows += [(None, text(True), "en", None, 1), (None, f"{word()} {item} {word()}", "en", "s", 1), (None, rows[1][1], "en", "s", 1), (300, rows[2][1], None, "s", 1)]
    rows += [(301, one := text(False), "en", "s", 5), (301, one, "en", "s", 5), (301, text(False), "en", "s", 6), (None, alone := text(False), "en", "s", 1), (None, alone, "en", "s", 1), (302, None, None, None, None)]
    _write(spark, tmp_path, rows, labels, [(0, item), (1, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "gone_id"]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {(r[0], r[1]) for r in rows if not (r[1] and ("vilebad" in r[1] or item in r[1])) and r[0] != 300}
    # Of a null id and a document with its text one stays, whichever name is smaller.
    assert len([x for x in left if x[1] == rows[1][1]]) == 1
    assert sorted(map(str, left)) == sorted(map(str, {x for x in kept if x[1] != rows[1][1]} | {x for x in left if x[1] == rows[1][1]}))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= {d for d, _ in left}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    _write(spark, tmp_path, [], [(1, 0, 1), (2, 0, 0)], [(0, "some item of words")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name


def test_scratch_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    result = neardup.near_duplicates(corpus(spark, ["a b c d e f", "a b c d e f", "x"]))
    assert result.count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert secrets.find(corpus(spark, ["password=abcdefghijklmnop"])).count() == 1 and len(list(tmp_path.iterdir())) == 2


def test_repeats_like_brute_force(spark):
    """On pages without an article: every stretch of DEPTH tokens that another page of the host has goes, and common whole blocks."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    fresh = lambda n: [rng.choice(words) + str(rng.randrange(999)) for _ in range(n)]
    shared = {h: [fresh(70) for _ in range(4)] for h in "ab"}
    common = {h: fresh(8) for h in "ab"}
    pages = []
    for h in "ab":
        for p in range(14):
            blocks = []
            for _ in range(rng.randrange(2, 6)):
                own = rng.choice(shared[h])
                at = rng.randrange(30)
                blocks.append(rng.choice([fresh(rng.randrange(1, 40)), fresh(5) + own[at : at + rng.randrange(10, 45)] + fresh(4), own[at : at + 31]]))
            if p % 3:
                blocks.insert(rng.randrange(len(blocks)), common[h])
            pages.append((h, blocks))
        pages.append(pages[-1])  # a mirror counts as one page with it
    rows = [(i, f"http://{h}.example/{i}", "<body>" + "".join(f"<div>{' '.join(b)}</div>" for b in blocks) + "</body>") for i, (h, blocks) in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    depth = html.DEPTH
    for i, (h, blocks) in enumerate(pages):
        others = {str(b): b for g, b in pages if g == h}
        here = others.pop(str(blocks))
        stream = [t for b in here for t in b]
        gone = [False] * len(stream)
        for other in others.values():
            theirs = [t for b in other for t in b]
            windows = {tuple(theirs[k : k + depth]) for k in range(len(theirs) - depth + 1)}
            for k in range(len(stream) - depth + 1):
                if tuple(stream[k : k + depth]) in windows:
                    gone[k : k + depth] = [True] * depth
        kept, at = [], 0
        for b in here:
            on = sum(b in other for other in [here, *others.values()])
            left = [t for t, g in zip(b, gone[at : at + len(b)], strict=True) if not g]
            at += len(b)
            if left and not (len(b) >= html.LEAST_BLOCK and on >= html.LEAST_PAGES and 2 * on >= len(others) + 1):
                kept.append(" ".join(left))
        assert got[i] == " ".join(kept), i


def test_order_of_an_id_that_many_rows_share(spark):
    rows = [(5, f"text {k % 30}") for k in range(40)] + [(None, f"n{k}") for k in range(9)] + [(k, "x") for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spread", F.lit(1))
    got = tokens.in_order(frame, 6).select("doc_id", "text", F.spark_partition_id().alias("part")).collect()
    hashed = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    assert [(r.doc_id, r.text) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1]))
    assert len({r.part for r in got if r.doc_id == 5}) > 2


def test_words_in_capitals_are_prose(spark):
    rng = random.Random(10)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [f"the words of an ordinary sentence, internationalisation and more AKIA{key(16)} again" for _ in range(300)]
    texts += ["THIS IS SHOUTED!! INTERNATIONALISATION!! VERANTWORTUNGSBEWUSSTSEIN", f"here is AKIA{key(11)}7"]
    got = {r.doc_id: r for r in secrets.find(corpus(spark, texts)).where("doc_id >= 300").collect()}
    assert got[300].n_inferred == 0 and got[301].n_inferred == 1 and got[301].n_access == 0
