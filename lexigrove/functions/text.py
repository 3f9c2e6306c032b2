"""Text normalisation and tokenisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[а-яёa-z0-9]+(?:[.,][0-9]+)?"
#: Word forms that carry no meaning in nomenclature texts.
STOPWORDS = (
    "и или в во на с со из для не но а также том числе прочие прочий прочая прочее "
    "кроме если иной иные указанный указанном порядке данной данном данная этой этом "
    "только более менее чем как так что при по от до за над под их его ее к у о об "
    "включая включенные поименованные месте другом виде видов товарной позиции "
    "подсубпозиции субпозиции группы группе раздела примечании дополнительном "
    "евразийского экономического союза являются являющиеся имеющие имеющий"
).split()


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends; null becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """No-break space to space, ё to е, lower case."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "\u00a0ёЁ", " еЕ"))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalise(text), F.lit(WORD), F.lit(0))


def drop_stopwords(tokens: Column) -> Column:
    """Without stop words and tokens of one character."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def tokenise(text: Column, stopwords: bool = True) -> Column:
    """Tokens whose lemma is themselves: exact for text without Cyrillic; see ``lemma_rows``."""
    return drop_stopwords(raw_tokens(text)) if stopwords else raw_tokens(text)


def lemmatise(tokens: DataFrame, lemmas: DataFrame, token: str = "token") -> DataFrame:
    """Replace ``token`` by its entry in ``lemmas`` (token, lemma), where it has Cyrillic letters and an entry.

    A dictionary table takes the place of a morphological analyser, with guesses by word endings for what it
    lacks (``operators.lemmas.extended``); each token is looked up by an equi-join. Stop words are dropped afterwards, since they are compared with lemmas.
    """
    known = lemmas.select(F.col("token").alias("_token"), "lemma")
    joined = tokens.join(known, (tokens[token] == known["_token"]) & tokens[token].rlike("[а-яё]"), "left")
    return joined.withColumn(token, F.coalesce("lemma", token)).drop("_token", "lemma")


def lemma_rows(texts: DataFrame, key: str, text: str, lemmas: DataFrame) -> DataFrame:
    """(key, term): the lemmas of every text's tokens, a row a token, without stop words and single characters."""
    rows = texts.select(key, F.explode(raw_tokens(F.col(text))).alias("term"))
    found = lemmatise(rows, lemmas, "term")
    return found.where((F.length("term") > 1) & ~F.col("term").isin(*STOPWORDS))


def numbers(text: Column) -> Column:
    """Every number of the text that no word character, comma or point precedes, comma decimals included."""
    found = F.regexp_extract_all(normalise(text), F.lit(r"(?<![\p{L}\p{N}_,.])(\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def split_words(text: Column) -> Column:
    """Lower-case runs without white space, and '' where white space begins or ends the text."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")


def words_of(text: Column) -> Column:
    """The words that character n-grams are taken from: lower-case runs without white space."""
    return F.filter(split_words(text), lambda w: w != "")


def word_grams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of a word that has a blank at both ends already."""
    at = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[at(n) for n in range(low, high + 1)])


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words that have a blank added at both ends."""
    # Padded first, so that no gram builds its word anew.
    padded = F.transform(words_of(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: word_grams(p, low, high)))


def short_family(label: Column, limit: int = 110) -> Column:
    """Up to the first ; or (, and if longer than ``limit`` cut there without the last part of a word, with …"""
    head = strip(F.get(F.split(F.coalesce(label, F.lit("")), "[;(]", 2), F.lit(0)))
    cut = F.concat(F.regexp_replace(F.substring(head, 1, limit), " [^ ]*$", ""), F.lit("…"))
    return F.when(F.length(head) <= limit, head).otherwise(cut)


def trim_to_word(text: Column, start: Column) -> Column:
    """The text from ``start``, backed off to the boundary before it; all of it if nothing is left or cut."""
    head = F.regexp_replace(F.substring(text, F.lit(1), start), "[^ ,;:]*$", "")
    rest = F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), "^[ ,;:]+", "")
    return F.when((start <= 0) | (start >= F.length(text)), text).otherwise(strip(rest))


def join_parts(*parts: Column) -> Column:
    """Non-empty parts with ' | ' between."""
    return F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts])


def declaration_text(name: Column, more: Column) -> Column:
    return F.when(strip(more) != "", F.concat(strip(name), F.lit(". "), strip(more))).otherwise(strip(name))


def passage(text: Column, model: str, query: bool) -> Column:
    """E5 models want a prefix that tells queries from passages."""
    return F.concat(F.lit("query: " if query else "passage: "), text) if "e5" in model.lower() else text


#: The chat template around a causal reranker's question, as its model was trained on.
PROMPT_BEGIN = (
    "<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. "
    'Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
)
PROMPT_END = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
TASK = (
    "Given a customs goods declaration, judge whether the candidate TN VED tariff code is the correct classification for it. "
    "Pay attention to numeric thresholds, negations, condition (new/used) and material composition."
)
PROMPT_BODY = "<Instruct>: %s\n<Query>: %s\n<Document>: %s"


def rerank_prompt(task: Column, query: Column, document: Column) -> Column:
    """The question about a pair, inside the chat template."""
    body = F.format_string(PROMPT_BODY, task, query, document)
    return F.concat(F.lit(PROMPT_BEGIN), body, F.lit(PROMPT_END))


def yes_probability(no: Column, yes: Column) -> Column:
    """Softmax over two logits: the weight of the second."""
    return 1.0 / (1.0 + F.exp(no - yes))
