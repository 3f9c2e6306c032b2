"""The suffix array of op1: its order and runs against brute force, and what long repeats decide on pages with articles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import html

PARSED = "row long, site long, signature long, wanted int, zones array<int>, texts array<string>"
A, J, D = html.ARTICLE, html.JUNKED, html.DOUBTED


def windows(zones, texts, depth):
    """(inside, window) of a page, by the definition."""
    streams = []
    for zone, text in zip(zones, texts, strict=True):
        inside = zone in html.INSIDE
        if not streams or streams[-1][0] != inside:
            streams.append((inside, []))
        streams[-1][1].extend(text.split())
    return [(inside, tuple(s[k : k + depth])) for inside, s in streams for k in range(len(s) - depth + 1)]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_runs_like_brute_force(spark, batch):
    rng, depth = random.Random(int(batch)), 6
    lines = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(3, 15))) for _ in range(8)]
    rows = []
    for row in range(60):
        zones = [rng.choice([A, A, J, D]) for _ in range(rng.randrange(6))]
        rows.append((row, row % 2, row // 2 % 25, A, zones, [rng.choice([*lines, "a " * rng.randrange(1, 30)]) for _ in zones]))
    parsed = spark.createDataFrame(rows, PARSED).repartition(3)
    want, out, within = {}, {}, {}
    for _, site, signature, _, zones, texts in rows:
        for inside, window in windows(zones, texts, depth):
            want.setdefault((site, window), set()).add(signature)
            (within if inside else out).setdefault((site, window), set()).add(signature)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for bits in (html._shared(parsed, depth), np.full(16, 2**64 - 1, np.uint64)):
            found = parsed.mapInPandas(html.stretches(depth, bits), html._STRETCHES)
            array = html.suffix_array(found, depth)
            key = lambda r: (r.site, r.anchor, bytes(r.suffix), r.signature, not r.outside)
            parts = array.withColumn("part", F.spark_partition_id()).collect()
            for p in {r.part for r in parts}:
                keys = [key(r) for r in parts if r.part == p]
                assert keys == sorted(keys)
            pieces = array.mapInPandas(html.runs(depth), html._RUNS)
            got = pieces.groupBy("site", "suffix").agg(F.sum("pages").alias("on"), F.sum("inside").alias("within"), F.sum("outside").alias("out")).collect()
            deciding = sorted((r.site, r.on, r.within, r.out) for r in got if r.on >= html.LEAST_PAGES or r.out > 1)
            assert deciding == sorted((k[0], len(v), len(within.get(k, ())), len(out.get(k, ()))) for k, v in want.items() if len(v) >= html.LEAST_PAGES or len(out.get(k, ())) > 1)
            names = {t: int(c) >> 32 for t, c in zip("abcde", html._codes(list("abcde"), {}), strict=True)}
            sums = {(k[0], b"".join(names[t].to_bytes(4, "big") for t in k[1])): len(v) for k, v in want.items() if len(v) >= html.LEAST_PAGES}
            assert {(r.site, bytes(r.suffix)): r.on for r in got if r.on >= html.LEAST_PAGES} == sums
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_repeats_decide_inside_articles(spark):
    some = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    notice, quotation, teased = some("notice", 36), some("quoted", 40), some("teased", 50)
    share = "tell all your friends about this very page"
    rows = []
    for k in range(6):
        own = teased if k == 0 else some(f"own{k}x", 20)
        inner = f'<p>{own}</p><p>{quotation}</p><div id="share">{share}</div><section id="notice-period">{some(f"law{k}x", 9)}</section><p>more{k} {notice}</p>'
        rows.append((k, f"http://h.com/{k}", f"<body><article><h1>Title {k}</h1>{inner}</article><aside>{teased}</aside><footer>{notice}</footer></body>"))
    # Nothing of this host repeats on half of its pages, whatever others have.
    rows += [(6 + k, f"http://o.com/{k}", f'<body><article><p>{some(f"o{k}x", 5)} {notice if k < 2 else ""}</p><div id="share">{share if k < 2 else "x"}</div></article><footer>{notice if k < 2 else k}</footer></body>') for k in range(6)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        own = teased if k == 0 else some(f"own{k}x", 20)
        assert got[k] == f"Title {k} {own} {quotation} {some(f'law{k}x', 9)} more{k}"
        assert got[6 + k] == f"{some(f'o{k}x', 5)} {notice + ' ' + share if k < 2 else 'x'}"
