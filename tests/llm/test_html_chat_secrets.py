import hashlib
import random
import re

from lexigrove.llm import chat, html, secrets

SHELL = "<html><head><title>T</title><style>p{{}}</style></head><body><nav>Home About</nav>{}<footer>Foot</footer><script>x('</p>')</script></body></html>"


def text_of(page):
    return " ".join(t for z, t in html.blocks(page) if z == html.ARTICLE)


def test_blocks():
    assert text_of(SHELL.format("<article><h1>A &amp;amp; b</h1><p><b>One<br><p>two\n three&nbsp;x</p><aside>no</aside></article>")) == "A &amp; b One two three x"
    assert text_of('<article><p>keep</p><div class="comments"><p>no</p></div><div class="ad-slot">no</div><form>no</form><!-- no --><p>a<i>b</i>c') == "keep abc"
    assert text_of('<section id="comments"><article class="comment">no</article></section><article>yes</article>') == "yes"
    assert text_of('<article class="has-sidebar"><header class="article-header"><h1>t</h1></header>x<div hidden>no</div></article>') == "t x"
    assert text_of('<div class="post-content"><p>x &lt;b&gt; &#233; &hearts;</p></div>') == "x <b> é ♥"
    assert html.blocks(None) == [] and html.blocks("") == [] and text_of("<article>a > b < c <x") == "a > b < c <x"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "extra") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")


def test_suffix_array_decides_without_markup(spark):
    notice = "<div>all rights reserved by the owners of this very site</div>"
    rows = [(f"http://h.com/{k}", f"<body>{notice}<div>unique words of page number {k} only here number {k}</div></body>") for k in range(3)]
    rows += [("http://other.com/", f"<body>{notice}</body>"), (None, None), ("x", "")]
    rows += [("http://m.com/1", "<body><p>one two three four five six seven</p></body>"), ("http://m.com/2", "<body><p>one two three four five six seven</p></body>")]
    got = {r.page_id: r for r in html.main_text(pages(spark, *rows)).collect()}
    assert got[1].text == "unique words of page number 1 only here number 1"
    assert got[3].text.startswith("all rights") and got[4].text == "" and got[5].text == "" and got[5].n_chars == 0
    assert got[6].text == got[7].text == "one two three four five six seven"  # mirrors are one page
    assert len(got) == len(rows) and html.main_text(pages(spark, ("u", "x")).limit(0)).count() == 0


def test_articles_that_repeat_stay(spark):
    same = SHELL.format("<article><p>one two three four five six seven</p></article>")
    assert {r.text for r in html.main_text(pages(spark, ("http://h/1", same), ("http://h/2", same + " "))).collect()} == {"one two three four five six seven"}


def test_only_long_repeats_go(spark):
    phrase = "as we said in the last report"
    licence = " ".join(f"clause{k}" for k in range(40))
    body = lambda k: f"<h2>Introduction</h2><p>first words {k}</p><p>Yes.</p><p>{phrase} and more words {k}</p><p>{licence} own{k}</p>"
    rows = [(f"http://h.com/{k}", f"<body>{body(k)}</body>") for k in range(4)]
    got = {r.page_id: r.text for r in html.main_text(pages(spark, *rows)).collect()}
    assert got == {k: f"Introduction first words {k} Yes. {phrase} and more words {k} own{k}" for k in range(4)}
    mirrors = [(f"http://m.com/{k}", f"<body><nav>menu {k}</nav><main><p>{licence}</p></main></body>") for k in range(2)]
    assert {r.text for r in html.main_text(pages(spark, *mirrors)).collect()} == {licence}
    # A block on few of a host's pages is text, on half of them it is a notice.
    notice = "some words that stand on two of eight pages"
    few = [(f"http://f.com/{k}", f"<body><p>page {k}</p>{f'<p>{notice}</p>' * (k < 2)}</body>") for k in range(8)]
    half = [(u.replace("f.com", "g.com"), f"<body><p>page {k}</p>{f'<p>{notice}</p>' * (k < 4)}</body>") for k, (u, _) in enumerate(few)]
    got = [r.text for r in html.main_text(pages(spark, *few, *half)).orderBy("page_id").collect()]
    assert got == [f"page {k} {notice}" if k < 2 else f"page {k}" for k in range(8)] + [f"page {k}" for k in range(8)]


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "q"), (1, 0, "user", "hi"), (1, 1, "assistant", "bb"), (2, 0, None, None), (2, 0, "user", "x"), (None, 0, "user", "x"), (5, 0, "user", "z"), (5, 0, "user", "z")]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n int")
    got = {r.pair_id: r for r in chat.format_preferences(chat.neighbours(frame)).collect()}
    assert set(got) == {0, 1, 2}
    r = got[0]
    assert r.n_prompt_turns == 1 and r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen.startswith("<|assistant|>\na<|end|>\n<|user|>\nq")
    span = lambda text, mask: [text[int(a) : int(b)] for a, b in (m.split(":") for m in mask.split(",") if m)]
    assert span(r.chosen, r.chosen_mask) == ["a<|end|>"] and span(r.rejected, r.rejected_mask) == ["bb<|end|>"]
    assert got[1].rejected == "" and got[1].prompt == "" and got[2].rejected.count("z") == 2 and got[2].rejected_mask == ""
    assert chat.format_preferences(chat.neighbours(frame.limit(0))).count() == 0


def base(text):
    kinds = ("assign", "access", "hex")
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(text) if len(m[0]) >= 16]
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(spark):
    keys = ["".join("0123456789abcdef"[(7 * i * j + i + j * j) % 16] for j in range(20)) for i in range(40)]
    texts = [f"é password = '{k}' end" for k in keys] + ["secret: token:abcdefghijklmnopq", "AKIA" + "B2" * 9 + " AKIAX", "deadbeefdeadbeef", None, "", "x" * 5000, "TOKEN=ABCDEFGHIJKLMNOP password=short"]
    hidden = keys[3][:10].upper() + keys[4][:10].upper()
    texts.append(f"an ordinary-looking word, 12.34.56.78.90.12 and {hidden}")
    frame = spark.createDataFrame([(i % 44, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = secrets.find(frame).collect()
    assert len(got) == len(texts)
    want = sorted((i % 44, hashlib.sha256(base(t or "").encode()).hexdigest()) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        own = [x for x in r.spans.split(",") if x and not x.startswith("inferred")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r.base_sha256 and len(own) == r.n_assign + r.n_access + r.n_hex
    assert secrets.find(frame.limit(0)).count() == 0


def test_formats_are_learned():
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    formats = secrets.Formats({"hex": [some(20) for _ in range(300)]}, ["the", "nomenclature", "declaration", "wheel", "internationalisation"])
    fresh = some(20)
    assert formats.margin(fresh) > 0 and formats.margin("internationalisation") < 0 and formats.margin("12.34.56.78.90.12.34") < 0
    assert secrets.infer(__import__("collections").Counter()) is None


def test_candidates_touch_no_base_span():
    text = "token=0123456789abcdefXYZ other_run-of.chars=__ " + "q" * 12
    found = secrets.base_spans(text)
    assert all(text[s : s + len(r)] == r and re.fullmatch(r"[A-Za-z0-9+/_.=-]{12,}", r) for s, r in secrets.candidates(text, found))
    assert [r for _, r in secrets.candidates(text, found)] == ["other_run-of.chars", "q" * 12]


def test_credentials_behind_names_and_beside_base_spans(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    fresh = [key() for _ in range(5)]
    lines = [f"client_key={fresh[0]}", f"see vault/{fresh[1]} now", f"label.{fresh[2]}", f"two {fresh[3]}/{fresh[4]}", "an ordinary day"]
    frame = spark.createDataFrame(list(enumerate(lines + [f"prose words secret: {key()} follow" for _ in range(400)])), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find(frame).where("doc_id < 5").collect()}
    for k, names in enumerate([fresh[:1], fresh[1:2], fresh[2:3], fresh[3:], []]):
        want = [f"inferred:{lines[k].index(n)}:{lines[k].index(n) + len(n)}" for n in names]
        assert got[k].spans.split(",") == (want or [""]) and got[k].n_inferred == len(want)
    text = f"{fresh[0]}_0123456789abcdef-{fresh[1]}"
    assert secrets.candidates(text, [(25, 2, 41, "0123456789abcdef")]) == [(0, fresh[0]), (42, fresh[1])]


def test_background_counts_all_words(spark, monkeypatch):
    text = "Eine été 2024-01-31 a/b token=abcdefghijklmnop zz"
    own = secrets.base_spans(text)
    left = text.replace("token=abcdefghijklmnop", " ").split()
    want = secrets.Background.of(left)
    assert secrets.Background.counted(secrets.symbol_pairs(text, own)).pairs == want.pairs == secrets.Background.counted(secrets.symbol_pairs(text, own, 3)).pairs
    assert want.pairs["$", "d"] == 1 and want.pairs["d", "-"] == 2 and want.pairs["h", "/"] == 1 and want.pairs["$", "o"] == 1 and ("$", "$") not in want.pairs
    seen = []
    made = secrets.Formats
    monkeypatch.setattr(secrets, "Formats", lambda learned, prose: seen.append(prose) or made(learned, prose))
    secrets.find(spark.createDataFrame([(k, text) for k in range(7000)] + [(7000, None), (7001, "")], "doc_id long, text string"))
    assert (seen[0] == 7000 * secrets.symbol_pairs(text, own)).all()
