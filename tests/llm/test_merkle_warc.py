"""The Merkle manifest against a plain tree, and WARC archives against a sequential reader of gzip files."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrove import store
from lexigrove.llm import merkle, tokens, warc


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Levels of a tree, the root's last."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, k, own):
    """(siblings level by level, the root folded from ``own`` at place k)."""
    proof = []
    for level in levels[:-1]:
        run = level[k // 8 * 8 : k // 8 * 8 + 8]
        proof += [d for i, d in enumerate(run) if i != k % 8]
        run[k % 8] = own
        own, k = h(*run), k // 8
    return proof, own


def expected(rows):
    """Rows of ``proofs`` for (doc_id, source, lang, n_chars, text), texts claimed in lower case where 3 divides the crc32."""
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {lang: sorted((r for r in rows if r[2] == lang), key=order) for lang in langs}
    trees = {lang: tree([leaf(r) for r in by[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for k, r in enumerate(by[lang]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            claimed = leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))) if changed else leaf(r)
            (near, own), (far, _) = climb(trees[lang], k, claimed), climb(top, at, "")
            folded = climb(top, at, own)[1]
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], h(*near, *far), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def prove(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int")
    return sorted((tuple(r) for r in merkle.proofs(frame, merkle.lowered(F.col("doc_id"), F.col("text"))).collect()), key=repr)


def documents(rng, n, langs):
    return [(i * 7 - 50, rng.choice(["a", None, ""]), rng.choice(langs), rng.randrange(100), rng.choice(["Some Text", "no capitals", "É", "", None, "x" * 50 + str(i)])) for i in range(n)]


@pytest.mark.parametrize("bits", [merkle.BLOCK_BITS, 3])
def test_proofs_like_a_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = documents(rng, 700, ["en"] * 20 + [None, "", "de", "é", "-", "="] + [f"l{k}" for k in range(12)]) + [(10**6, "s", "one", 1, "A single One")]
    assert prove(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_proofs_of_one_language(spark, n):
    rows = documents(random.Random(n), n, ["en"])
    assert prove(spark, rows) == expected(rows)


def test_proofs_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "T"), (5, "s", "en", 1, "Twice"), (5, "s", "en", 1, "Twice"), (5, "s", "en", 1, "other"), (2**62, "s", "en", -1, "X" * 200_000)]
    assert prove(spark, rows + [(9, "s", "de", 3, "Same")] * 40) == expected(rows + [(9, "s", "de", 3, "Same")] * 40)
    assert prove(spark, []) == [] and merkle.proofs(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).columns == [c.split()[0] for c in merkle.RESULT.split(", ")]


def test_tampering_is_found_and_nothing_else(spark):
    rows = documents(random.Random(3), 200, ["en", "de"])
    for r in prove(spark, rows):
        text = next(x[4] for x in rows if x[0] == r[0])
        assert r[-1] == (text is None or zlib.crc32(str(r[0]).encode()) % 3 != 0 or text == text.lower() or text == "É")
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.proofs(frame).where("not verified").count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def records(data):
    """(headers, block) of a whole archive, one after the other."""
    out, plain = [], gzip.decompress(data)
    while plain:
        head, _, plain = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        out.append((fields, plain[:n]))
        assert plain[n : n + 4] == b"\r\n\r\n"
        plain = plain[n + 4 :]
    return out


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, sha1 string, size int")


def web(rng, n):
    texts = ["", None, "<p>é</p>", "a" * 3000, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"] + ["".join(rng.choice("<>abc é\n") for _ in range(rng.randrange(3000))) for _ in range(n // 2)]
    return [(i, rng.choice(["http://h/ü x\r\ny", None, "", f"http://h/{i}?q=1"]), rng.choice(texts)) for i in rng.sample(range(10 * n), n)]


def expected_pages(rows):
    top = {}
    for i, _, t in rows:
        top[t or ""] = max((i for j, _, u in rows if (u or "") == (t or "") for i in [-1 if j is None else j]))
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        first = top[t or ""] == (-1 if i is None else i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top[t or ""]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [warc.HOT, 1])
def test_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = web(random.Random(1), 150) + [(None, "u", "only"), (None, "u", "a" * 3000), (3000, None, "long " * 100_000)]
    assert sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=repr) == expected_pages(rows)
    assert warc.round_trip(pages(spark, [])).count() == 0
    twice = [(7, "u", "same"), (7, "v", "same"), (3, "u", "same")]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, twice)).collect()) == [(3, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_archives_hold_whole_payloads(spark):
    rows = web(random.Random(2), 120)
    with store.scratch(spark):
        folder = store.new_path(spark, "warc-test")
        manifest = warc.write(pages(spark, rows), folder, most=20_000).collect()
        assert len(manifest) > 4 and sum(m.n_records for m in manifest) == len(rows)
        seen, files = {}, {}
        for m in manifest:
            files[m.name] = data = tokens.read_range(folder, m.name)
            assert len(data) == m.n_bytes
            for fields, block in records(data):
                if fields["WARC-Type"] != "warcinfo":
                    seen[fields["WARC-Record-ID"]] = fields, block.partition(b"\r\n\r\n")[2]
        stored = {f["WARC-Record-ID"]: p for f, p in seen.values() if f["WARC-Type"] == "response"}
        for i, _, t in rows:
            fields, payload = seen[f"<urn:x-page:{i}>"]
            assert (payload if fields["WARC-Type"] == "response" else stored[fields["WARC-Refers-To"]]) == (t or "").encode()
        # However a file is split, every record is read by one range.
        frame = spark.createDataFrame(manifest, warc.MANIFEST)
        for split in (1000, 7919, 1 << 20):
            got = warc.read(frame, folder, split, payload=True).collect()
            assert sorted((r.page_id, r.record_type, bytes(r.payload)) for r in got) == sorted((int(k[12:-1]), f["WARC-Type"], p) for k, (f, p) in seen.items())
        few = pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")])
        assert sorted((r.page_id, r.refers_to) for r in warc.round_trip(few, least=3).collect()) == [(1, None), (2, None), (3, 4), (4, None)]


def test_members_of_every_split():
    rng = random.Random(4)
    one = lambda k: warc.page_record(k, f"http://h/{k}", rng.randbytes(rng.randrange(300)).hex().encode(), "00" * 20, k % 3 == 0, 1)
    junk = warc.MAGIC + b"\0" * 30 + gzip.compress(b"not an archive") + warc.MAGIC[:2] + b"WARC/1."
    # Members that are not records, and the magic alone, stand between records and in an extra field of one.
    parts = [one(0), one(1), junk, one(2), one(3), junk, one(4)]
    data = b"".join(parts)
    ids = ["<urn:x-page:%d>" % k for k in range(5)]
    read = lambda at, n: data[at : at + n]
    for split in (1, 2, 3, 17, 100, 1000, len(data)):
        got = [(o, f["warc-record-id"]) for s in range(0, len(data), split) for o, f, _ in warc.members(read, len(data), s, min(len(data), s + split))]
        assert [i for _, i in got] == ids and [o for o, _ in got] == [data.index(p) for p in parts if p != junk]
    cut = data[: len(data) - 5]
    with pytest.raises(ValueError, match="damaged record"):
        list(warc.members(lambda at, n: cut[at : at + n], len(cut), 0, len(cut)))
    with pytest.raises(ValueError, match="digest"):
        warc.page_of(*next((f, b) for _, f, b in warc.members(read, len(data), 0, len(data)) if f["warc-type"] == "response"))
