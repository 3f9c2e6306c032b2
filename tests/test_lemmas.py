"""Lemmas by endings: the rules, words held out, and what must stay as it is."""

import random

from pyspark.sql import functions as F

from lexigrove.operators import lemmas
from lexigrove.plans import ranking as plan

#: Declensions: the lemma's ending, and those of its other forms.
NOUNS = {
    "а": ["ы", "е", "у", "ой", "ам", "ами", "ах"],
    "ь": ["и", "ью", "ям", "ями", "ях"],
    "ие": ["ия", "ию", "ием", "ии", "иям", "иями"],
    "ок": ["ка", "ку", "ком", "ки", "ков", "ками"],
    "ый": ["ого", "ому", "ым", "ая", "ую", "ые", "ых", "ыми"],
}
STEMS = "машин труб проволок бумаг муфт плит пласт стал мебел модел издели соединени покрыти оборудовани порош кус пот стальн медн шерстян хлопков желез резинов готов".split()


def dictionary(rng):
    """(token, lemma) of invented nouns and adjectives, a stem in one declension."""
    letters = "бвгдзклмнпрстфхч"
    rows = []
    for k in range(300):
        stem = "".join(rng.choice(letters) + rng.choice("аоуие") for _ in range(rng.randint(1, 3))) + rng.choice(letters)
        base = list(NOUNS)[k % len(NOUNS)]
        rows += [(stem + e, stem + base) for e in [base, *NOUNS[base]]]
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, "token string, lemma string")


def test_held_out_forms(spark):
    rng = random.Random(2)
    rows = dictionary(rng)
    own = sorted({lemma for _, lemma in rows})
    held = set(rng.sample(own, len(own) // 5))
    known, asked = [r for r in rows if r[1] not in held], [r for r in rows if r[1] in held]
    got = {r.token: r.lemma for r in lemmas.guessed(make(spark, asked), lemmas.rules(make(spark, known))).collect()}
    truth = {}
    for token, lemma in asked:
        truth.setdefault(token, set()).add(lemma)
    right = sum(got.get(t) in want for t, want in truth.items())
    assert right > 0.9 * len(truth) and right > 2 * sum(t in want for t, want in truth.items())  # against every token as its own lemma


def test_longest_ending_and_most_frequent_paradigm(spark):
    rows = [("машины", "машина"), ("трубы", "труба"), ("плиты", "плита"), ("столы", "стол"), ("цветы", "цвет"), ("коты", "кот"), ("кроты", "крот"), ("сроты", "срот")]
    found = {r.ending: (r.cut, r.add) for r in lemmas.rules(make(spark, rows)).collect()}
    # Of all in -ы more have none in the lemma; in -бы and -ны no ending has two tokens; -ты and longer ones agree with -ы.
    assert found == {"ы": (1, "")}
    rows += [("рубы", "руба"), ("клубы", "клуба")]
    found = {r.ending: (r.cut, r.add) for r in lemmas.rules(make(spark, rows)).collect()}
    assert found == {"ы": (1, ""), "бы": (1, "а")} or found == {"ы": (1, "а"), "ты": (1, "")}
    rows += [("балконы", "балкон"), ("вагоны", "вагон")]
    got = {r.token: r.lemma for r in lemmas.guessed(spark.createDataFrame([("дубы",), ("лимоны",), ("абвы",)], "token string"), lemmas.rules(make(spark, rows))).collect()}
    assert got == {"дубы": "дуба", "лимоны": "лимон", "абвы": "абв"}


def test_what_stays(spark):
    rows = dictionary(random.Random(3))
    asked = spark.createDataFrame([("steel",), ("12",), ("x5",), ("да",), (None,), ("машинами",), (rows[5][0],)], "token string")
    given = make(spark, [*rows, (None, "x"), ("y", None), ("машинами", "особое"), ("pipes", "pipe")])
    out = {r.token: r.lemma for r in lemmas.extended(given.where("token is not null and lemma is not null"), asked).collect()}
    assert out["машинами"] == "особое" and out[rows[5][0]] in {b for a, b in rows if a == rows[5][0]}
    assert not {"steel", "12", "x5", "да", None} & out.keys()
    assert lemmas.rules(given.limit(0)).count() == 0 and lemmas.guessed(asked, lemmas.rules(given.limit(0))).count() == 0
    long = spark.createDataFrame([("а" * 100_000 + "ами",)], "token string")
    assert lemmas.guessed(long, lemmas.rules(given.where("token is not null"))).count() <= 1


def test_ranking_meets_forms_that_no_dictionary_has(spark):
    rows = [(s + e, s + b) for s, b in (("машин", "а"), ("плит", "а"), ("муфт", "а")) for e in [b, *NOUNS[b]]]
    docs = spark.createDataFrame([(1, "труба стальная"), (2, "колесо"), (3, "плита")], "doc_id long, coarse_text string")
    queries = spark.createDataFrame([(1, "трубами")], "query_id long, text string")
    known = lemmas.extended(make(spark, rows), lemmas.tokens_of([(docs, "coarse_text"), (queries, "text")]))
    assert {r.token: r.lemma for r in known.collect()}["трубами"] == "труба"
    config = plan.Config(weights={"word": 1.0}, n_candidates=3)
    best = plan.legs(queries, docs, ["word"], lemmas=known)["word"]
    assert best.queries.select(F.count("term")).first()[0] == 1 and plan.stage1(queries, docs, config, lemmas=known).where("rank = 1").first().doc_id == 1
    assert plan.legs(queries, docs, ["word"], lemmas=make(spark, rows))["word"].queries.count() == 0
