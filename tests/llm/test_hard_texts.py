"""Letters that a tokenizer takes apart, names inside articles, and very long runs."""

import base64
import random
import time

import pyarrow as pa

from lexigrove.llm import html, secrets, tokens

MARKS = [chr(c) for c in range(33, 127)]
#: Letters with several parts, letters that lower case or composition changes, combining marks, joiners and spaces.
ODD = "İ ı ̇ ́ ̸ क़ য় ẞ ß ﬁ ŉ ǰ ΐ é é ﷺ שּׁ ª º ː ʰ 中 ｱ K Å ſ ᾳ Σ ς ‍ ² ½ Ⅷ     i A z 1 's '".split(" ")


def same_ids(memo, texts):
    ids, lengths = memo.encode(pa.array(texts))
    at, wrong = 0, []
    for text, n, want in zip(texts, lengths.tolist(), memo.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        if ids[at : at + n].tolist() != want.ids:
            wrong.append(text)
        at += n
    return wrong


def test_cuts_change_no_ids():
    memo = tokens.Pieces(tokens.default_tokenizer(), False)
    assert memo.apart
    rng = random.Random(1)
    texts = ["İ. Kaya", "İ!", "DENİ-1", "İ", "İ1", "1İ", "क़!", "!क़", "", None]
    texts = [t for t in texts if t is not None] + [f"{m}{c}{m} {c}{m}{c}" for c in ODD for m in MARKS]
    texts += ["".join(rng.choice(ODD if rng.random() < 0.6 else MARKS) for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    letters = [c for c in map(chr, range(128, 0x20000)) if c.isalpha()]
    texts += [f"{c}! {c}1{c}.{c}" for c in letters[:: len(letters) // 4000]]
    assert same_ids(memo, texts) == []


def test_names_inside_articles_drop_no_text():
    text = lambda page: " ".join(t for z, t in html.blocks(page) if z == html.ARTICLE)
    assert text('<article><h2 id="side-effects">Side effects</h2><p>nausea</p></article>') == "Side effects nausea"
    assert text('<article><h2 id="related-work" class="menu">Related work</h2><p>none</p></article>') == "Related work none"
    assert text('<article><section id="notice-period"><p>a month</p></section><div id="social-impact">none</div></article>') == "a month none"
    assert text('<article><p>the <b class="menu-item">soup</b> was <span class="ad">hot</span></p></article>') == "the soup was hot"
    kept = '<article><p>one</p><div class="share-buttons">no</div><div class="ad">no</div><ul class="comment-list"><li>no</ul><aside>no</aside><nav>no</nav><div role="search">no</div><p>two'
    assert text(kept) == "one two"
    # Outside of articles names decide as before.
    assert text('<div id="side-bar">no</div><article>yes</article>') == "yes" and html.blocks('<div id="sidebar">no</div>') == [(html.JUNKED, "no")]


def test_headings_and_ids_like_brute_force():
    """Random articles whose ids come from their headings give the headings and paragraphs in order."""
    rng = random.Random(5)
    words = sorted(html.JUNK_NAMES) + "effects work period impact soup method results of the house".split()
    for _ in range(300):
        want, made = [], []
        for _ in range(rng.randint(1, 5)):
            title = [rng.choice(words) for _ in range(rng.randint(1, 3))]
            body = " ".join(rng.choice(words) for _ in range(5))
            name, level = "-".join(title), rng.randint(1, 6)
            made.append(rng.choice([f'<h{level} id="{name}" class="{name}">{" ".join(title)}</h{level}><p id="p-{name}">{body}</p>', f'<section id="{name}"><h{level}>{" ".join(title)}</h{level}><div>{body}</div></section>']))
            want += [" ".join(title), body]
        page = f"<body><nav>Home</nav><article>{''.join(made)}</article><footer>Foot</footer></body>"
        assert [t for z, t in html.blocks(page) if z == html.ARTICLE] == want


def test_paragraphs_close_under_many_inline_elements():
    opened = "<b><i>" * 40
    assert [t for _, t in html.blocks(f'<article><p class="ad">{opened}no<p>yes</article>')] == ["no", "yes"]
    began = time.time()
    html.blocks("<p><td>" + "<b>" * 100_000 + "x<hr>" * 100_000)
    assert time.time() - began < 20


def test_long_runs_are_scanned_in_linear_time():
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    formats = secrets.Formats({"assign": [key() for _ in range(300)], "hex": ["%032x" % rng.getrandbits(128) for _ in range(300)]}, ["the", "house", "stands"] * 50)
    for run in (base64.b64encode(rng.randbytes(3_000_000)).decode(), "-".join("%012x" % rng.getrandbits(48) for _ in range(60_000))):
        began = time.time()
        spans = formats.spans(run)
        assert time.time() - began < 30 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        # The same choice as by comparing each span with all that were taken before.
        short = run[:3000]
        pieces = [m.span() for m in secrets.PIECE.finditer(short)]
        parts = {(0, len(short))} | {(s, e) for i, (s, _) in enumerate(pieces) for _, e in pieces[i:] if e - s <= formats.longest or e == pieces[i][1]}
        scored = [((e - s + 1) * m, s, e) for s, e in parts if e - s >= 12 and (m := formats.margin(short[s:e])) > 0]
        best = []
        for _, s, e in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
            if all(e <= a or b <= s for a, b in best):
                best.append((s, e))
        assert formats.spans(short) == sorted(best)
