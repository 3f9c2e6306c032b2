import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import decontaminate, hnsw, mixing, neardup, rangecoder, separators, shingles, tokenfiles, tokens, toxicity

WORDS = "the of and to in ether quartz lattice momentum vertex copper signal garden window letter marble ocean summer winter planet engine".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10**6))
    return " ".join(own)


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n long")


def reachable(texts):
    """Smallest reachable id by comparing all pairs."""
    sets = [shingles.shingle_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(spark):
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 120)
    texts = [prose(rng, rng.choice([6, 30, 90])) for _ in range(40)] + [None, "", " \t", "a", "A", "a b c", "a B  c", "a b c d"]
    texts += [edited(rng, base, rng.randrange(0, 14)) for _ in range(120)]
    texts += [passage + " " + prose(rng, rng.choice([15, 40])) for _ in range(60)] + [base.upper(), base, base]
    got = {r.doc_id: r for r in neardup.near_duplicates(corpus(spark, texts)).collect()}
    want, sizes = reachable(texts)
    assert [got[i].component_id for i in range(len(texts))] == want and [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_of_odd_rows(spark):
    frame = corpus(spark, ["a b c d e f", "a b c d e f"]).union(corpus(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long"))).union(corpus(spark, ["x"]))
    rows = neardup.near_duplicates(frame).collect()
    assert len(rows) == 4 and sorted((r.doc_id is None, r.component_id is None) for r in rows)[-1] == (True, True)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (6, 12, 20, 20, 45)] + ["one two", "", None, "the same the same the same the same the same"]
    texts = [prose(rng, 80) for _ in range(10)] + [None, "", "short one"]
    texts += [f"{prose(rng, 20)} {edited(rng, items[k], e)} {prose(rng, 9)}" for k in range(5) for e in (0, 1, 2)]
    texts += [items[4].upper(), items[4].rsplit(" ", 6)[0], "x one  TWO y", "the same the same the same the same the same the"]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(corpus(spark, texts), benchmark).collect()}
    want = {}
    grams = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4)))
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for k, item in enumerate(items):
            if (own := (item or "").lower().split()) and w:
                # An item of under five words is one shingle, whatever the document's own length.
                best = max(sum((a & b).values()) / sum((a | b).values()) for a in [grams(own)] for s in range(max(1, len(w) - len(own) + 1)) for b in [grams(w[s : s + len(own)])])
                if best >= 0.75:
                    want[d, k] = best
    assert got == pytest.approx(want)
    assert decontaminate.leaks(corpus(spark, texts).limit(0), benchmark).count() == 0 and decontaminate.leaks(corpus(spark, texts), benchmark.limit(0)).count() == 0


def waterfill(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        now = {k: left * w[k] / sum(w[j] for j in free) for k in free}
        over = {k for k in free if now[k] > most * sizes[k] + 1e-9}
        if not over:
            return target | now
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
        free -= over


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["b", "b", "b", "b", "a", "c", None, "d"]), "x") for i in range(700)]
    rows += [(700, None, "a", "x"), (701, " ", "z", "x"), (702, "one two", "e", "x"), (702, "one two", "e", "x"), (None, "one", "e", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.copies(frame).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.copies(frame.repartition(5)).collect()))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = waterfill(sizes)
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert r.taken <= 2 * r["size"]
    for s, n in sizes.items():
        assert abs(taken[n, round(want[s], 6)] - want[s]) <= 60
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(r.taken for r in got)
    assert mixing.copies(frame.limit(0)).count() == 0


def test_mixing_keeps_expectations(spark):
    frame = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 2}") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.copies(frame).toPandas()
    got["rate"] = got["target"] / got["source_size"]
    for _, own in got.groupby(["source_size", "size"]):
        assert abs(own["copies"].mean() / own["rate"].iat[0] - 1) < 0.12


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        own = prose(rng, 40).split()
        if toxic:
            own[3], own[20] = rng.choice(["vilebad", "vileworse", "vilemost"]), "nastything"
        rows.append((i, " ".join(own), "en"))
        labels.append((i, int(toxic)))
    rows += [(500, None, "en"), (501, "", "en"), (None, "vilebad nastything", "en"), (502, "word " * 20000 + "vilebad nastything", "en"), (502, "again", "en")]
    labels += [(None, 1), (7, None), (8, 1), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    frame = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit(1))
    got = toxicity.score(docs, frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held) and len(held) > 40
    assert toxicity.score(docs.limit(0), frame).count() == 0
    assert {r.score for r in toxicity.score(docs, frame.limit(0)).collect()} == {0.0}


def test_block_max_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    counts = [{int(t): int(rng.integers(1, 5)) for t in rng.choice(60, rng.integers(1, 9), replace=False)} for _ in range(500)]
    index = toxicity.Index(counts, [i % 2 for i in range(500)], list(range(500)), 60, (1.0, 1.0))
    dense = np.zeros((500, 60))
    for i, c in enumerate(counts):
        ids, w = index.vector(c)
        dense[i, ids] = w
    dense = dense[index.doc_ids]  # in the index's order
    nearest = [index.nearest([index.vector(c) for c in counts[:60]], 15)]
    monkeypatch.setattr(toxicity, "LAID_BYTES", 0)
    again = pickle.loads(pickle.dumps(index))
    assert not again.laid and index.laid
    nearest.append(again.nearest([index.vector(c) for c in counts[:60]], 15))
    assert not again.laid
    for found in nearest:
        for (ids, w), (rows, cos) in zip(map(index.vector, counts[:60]), found, strict=True):
            full = dense[:, ids] @ w
            assert cos == pytest.approx(np.sort(full)[::-1][:15], abs=1e-5) and full[rows] == pytest.approx(cos, abs=1e-5)
            # Of equal cosines those that stand first.
            tied = [(r, c) for r, c in zip(rows.tolist(), cos.tolist(), strict=True)]
            assert all(a[1] > b[1] or a[0] < b[0] for a, b in zip(tied, tied[1:], strict=False))


def test_index_of_many_terms_is_small():
    """20,000 terms and 6000 examples of 100 terms each: bytes that are sent, and no dense table of terms and examples."""
    rng = np.random.default_rng(5)
    counts = [dict.fromkeys(rng.choice(20_000, 100, replace=False).tolist(), 1) for _ in range(600)]
    index = toxicity.Index(counts, [i % 2 for i in range(600)], list(range(600)), 20_000, (1.0, 1.0))
    assert len(pickle.dumps(index)) < 600 * 100 * 9 + 20_000 * 4 * 11 + 100_000 + 20_000 * 8


def test_index_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SENT_BYTES", 100)
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string")
    with pytest.raises(ValueError, match="too large to be sent"):
        toxicity.score(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=8).round(3).tolist() for _ in range(600)]
    vectors[250:300] = [vectors[0]] * 50
    rows = [(i, v) for i, v in enumerate(vectors)] + [(700, None), (800, [0.0] * 8), (900, [float("nan")] + [1.0] * 7), (1000, [None] + [1.0] * 7), (1100, []), (1200, [1.0, 2.0]), (None, [1.0] * 8), (1300, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    x = np.array([np.float32(v) for v in vectors], np.float64)
    got = {}
    for r in hnsw.nearest(frame, shard_rows=150).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    assert set(got) == {0, 100, 200, 300, 400, 500}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert sorted(found) == list(range(1, 11)) and all(found[k].score == d[found[k].vec_id] for k in found)
        hits += len({r.vec_id for r in found.values()} & set(order))
    assert hits >= 54 and [got[0][k].vec_id for k in range(1, 11)] == list(range(250, 260))
    assert hnsw.nearest(frame.limit(0)).count() == 0


def test_range_coder():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, rangecoder.BLOCK, rangecoder.BLOCK + 1, 3 * rangecoder.BLOCK - 7):
        for ids in (rng.integers(0, 65536, n), np.zeros(n, int), np.resize([5, 6, 7, 500], n), (rng.zipf(1.3, n) % 49408)):
            data = rangecoder.pack(ids.astype(np.uint32), [3, None], np.array([n, 0]))
            back, docs, lengths = rangecoder.unpack(data)
            assert (back == ids).all() and docs == [3, None] and lengths.tolist() == [n, 0]
    data = bytearray(rangecoder.pack(rng.integers(0, 9, 5000).astype(np.uint32), [1], np.array([5000])))
    data[-40] ^= 255
    with pytest.raises((ValueError, IndexError)):
        rangecoder.unpack(bytes(data))
    assert len(rangecoder.pack(np.resize([5, 6, 7, 500], 40000).astype(np.uint32), [1], np.array([40000]))) < 8000


TEXTS = ["Hello World, it's 12 o'clock", None, "", "ÉCOLE İstanbul ŒUVRE", "a b c # #", "<|endoftext|> <|startoftext|>x", "long " * 30000, "same", "same", "ﬁne é \x1c z"]


def test_token_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    frame = spark.createDataFrame([(d, t, 1) for d, t in zip([5, 4, 3, 2, 1, 0, -7, 8, 8, None], TEXTS, strict=True)], "doc_id long, text string, start int")
    want, start = [], 0
    for d, t in sorted(zip([5, 4, 3, 2, 1, 0, -7, 8, 8, None], TEXTS, strict=True), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenfiles.round_trip(frame).orderBy("start").collect()]
    assert got == want
    assert tokenfiles.round_trip(frame.limit(0)).count() == 0


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    literal = Tokenizer.from_file(tokens.default_tokenizer())
    literal.encode_special_tokens = True
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, k int").repartition(3)
    rows = separators.token_counts(frame).orderBy("doc_no").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(literal.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert [r.doc_no for r in rows] == list(range(len(TEXTS))) and all(b.start == a.start + a.n_tokens + 1 for a, b in zip(rows, rows[1:], strict=False))
    assert separators.token_counts(frame.limit(0)).count() == 0


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(6)
    files, want, base, doc = [], [], 0, 0
    for part, n in enumerate((37, 0, 1, 64, 20)):
        ids = np.where(rng.random(n) < 0.12, 9, 1).astype("<u2")
        if part == 4:
            ids[:] = 1  # no separator in many blocks
        (tmp_path / f"f{part}").write_bytes(ids.tobytes())
        files.append((part, f"f{part}", n))
        first = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((part, doc, base + first, i - first, True))
                first, doc = i + 1, doc + 1
        if first < n:
            want.append((part, doc, base + first, n - first, False))
            doc += 1
        base += n
    frame = spark.createDataFrame(files, "part int, name string, n_ids long")
    got = [(r.part, r.doc_no, r.start, r.n_tokens, r.ended) for r in separators.scan(frame, f"file://{tmp_path}", eod=9, block=8).orderBy("doc_no").collect()]
    assert got == want


def test_memo_forgets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    memo = tokens.Pieces(tokens.default_tokenizer(), False)
    rng = random.Random(9)
    for _ in range(12):
        texts = [prose(rng, 12) for _ in range(4)]
        ids, lengths = memo.encode(pa.array(texts))
        want = [e.ids for e in memo.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(x) for x in want]


def test_toxicity_keeps_every_term_that_passes(spark):
    letters = "abcdefghijklmnopqrst"
    bad = [f"{a}{b}{a}{b}x" for a in letters[:10] for b in letters[10:]]
    rows = [(k, " ".join(bad) if k % 4 == 0 else f"calm{k} quiet words", int(k % 4 == 0)) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    vocabulary, _ = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    assert len(vocabulary.terms) > 4 * 20
    assert all(any(w in t for t in vocabulary.terms) for w in bad)
