"""Secrets in texts: fixed patterns, and formats learned from what they find.

The fixed patterns give base spans of three kinds. Their matched credentials are labelled examples,
from which a probabilistic automaton is inferred for each kind: a prefix tree of the examples' character
classes, whose states are merged where their outgoing frequencies are statistically compatible
(Hoeffding bound, states in breadth-first order, merges folded into a deterministic automaton); each
state then learns which characters of a class it has, so that a fixed beginning is one. What
is left of every long run of credential characters outside base spans is then scored by the likelihood of its
format, as a whole and in the pieces between its separators (a name or a path can stand before a
credential), and what looks like an example more than like prose, in whatever case, is added as a span of kind ``inferred``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store

# The patterns, their kinds in order, and the least length of a match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "inferred")
LEAST = {"assign": 12, "access": 18, "hex": 16}
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PIECE = re.compile(r"[^=/._+-]+")
#: What every ``assign`` match contains, in lower case.
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Labelled credentials that are learned from, a kind. They are those of the smallest hashes among all.
EXAMPLES = 500
#: Confidence parameter of the compatibility test.
ALPHA = 0.05

_CLASS = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "H" for c in "ABCDEF"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_TO_CLASS = str.maketrans(_CLASS)
_SMALL = str.maketrans("HU", "hl")
END = "$"
#: The background's symbols: the ends of words, the classes, the separators, and one for all other characters.
SYMBOLS = END + "dhlHU+/_.=-" + "o"
#: Symbol of every code point up to the last white space; higher ones are like the last entry.
_SYMBOL = np.array([0 if chr(c).isspace() else SYMBOLS.index(_CLASS.get(chr(c), chr(c))) if c < 128 and (chr(c) in _CLASS or chr(c) in "+/_.=-") else len(SYMBOLS) - 1 for c in range(0x3002)], np.int64)


def symbol_pairs(text: str, base: list[tuple[int, int, int, str]], step: int = 1 << 20) -> np.ndarray:
    """Counts of neighbouring symbols in all words outside base spans; entry a * len(SYMBOLS) + b is a before b."""
    n = len(SYMBOLS)
    total = np.zeros(n * n, np.int64)
    before = 0
    for at in range(0, len(text), step):
        points = np.frombuffer(text[at : at + step].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _SYMBOL[np.minimum(points, len(_SYMBOL) - 1)]
        for s, _, e, _ in base:
            codes[max(0, s - at) : max(0, e - at)] = 0
        total += np.bincount(np.concatenate(([before], codes[:-1])) * n + codes, minlength=n * n)
        before = int(codes[-1])
    total[before * n] += 1
    total[0] = 0
    return total


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns' matches, by start and kind."""
    found = []
    if any(w in text.lower() for w in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # A greedy run is a maximal run, so asking for its length at once gives the same matches.
    found += [(m.start(), 2, m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, run) of what the base spans leave of the long runs of credential characters, if long enough itself."""
    out = []
    k = 0
    covered: list[list[int]] = []
    for s, _, e, _ in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    for m in RUN.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        left, at, j = [], m.start(), k
        while j < len(covered) and covered[j][0] < m.end():
            left.append((at, covered[j][0]))
            at = covered[j][1]
            j += 1
        for s, e in [*left, (at, m.end())]:
            run = text[s:e].rstrip(".=-_/") if s < e else ""
            start = s + len(run) - len(run := run.lstrip(".=-_/"))
            if len(run) >= LEAST["assign"]:
                out.append((start, run))
    return out


#: Characters of each class.
_SIZE = Counter(_CLASS.values())


class Automaton:
    """A deterministic probabilistic automaton over character classes, whose states also tell how likely each character of a class is."""

    def __init__(self, counts: list[dict[str, int]], moves: list[dict[str, int]], floor: float):
        self.logs = [{a: math.log(n / sum(c.values())) for a, n in c.items()} for c in counts]
        self.moves, self.floor = moves, floor
        self.chars: list[dict[str, float]] = [{} for _ in counts]

    def spell(self, words: Counter) -> None:
        """Learn the characters of the examples, state by state, half an example of each added."""
        seen: list[Counter] = [Counter() for _ in self.moves]
        for word, n in words.items():
            state = 0
            for c in word:
                seen[state][c] += n
                state = self.moves[state][_CLASS.get(c, c)]
        for state, own in enumerate(seen):
            total = Counter()
            for c, n in own.items():
                total[_CLASS.get(c, c)] += n
            size = lambda k: _SIZE.get(k, 1)
            # By how much a character is likelier here than any of its class; a blank and the class stand for those not seen.
            self.chars[state] = {c: math.log((n + 0.5) * size(k) / (total[k] + 0.5 * size(k))) for c, n in own.items() for k in [_CLASS.get(c, c)]}
            self.chars[state] |= {" " + k: math.log(0.5 * size(k) / (n + 0.5 * size(k))) for k, n in total.items()}

    def score(self, word: str, chars: str | None = None) -> float:
        """Mean log likelihood a symbol, the end included; minus infinity for an unseen move.

        ``word`` is a class string. With its characters, how these differ from even odds in their classes counts too.
        """
        state, total = 0, 0.0
        for k, a in enumerate(word):
            if a not in self.logs[state]:
                return -math.inf
            total += self.logs[state][a]
            if chars is not None:
                own = self.chars[state]
                total += own[chars[k]] if chars[k] in own else own.get(" " + a, 0.0)
            state = self.moves[state][a]
        return (total + self.logs[state].get(END, -math.inf)) / (len(word) + 1)


def infer(words: Counter, alpha: float = ALPHA) -> Automaton | None:
    """The automaton of a multiset of class strings; None without examples.

    Its floor is the score that 99 of 100 examples reach.
    """
    if not words:
        return None
    counts: list[dict[str, int]] = [defaultdict(int)]
    moves: list[dict[str, int]] = [{}]
    for word, n in sorted(words.items()):
        state = 0
        for a in word:
            counts[state][a] += n
            if a not in moves[state]:
                moves[state][a] = len(moves)
                moves.append({})
                counts.append(defaultdict(int))
            state = moves[state][a]
        counts[state][END] += n
    bound = math.sqrt(0.5 * math.log(2.0 / alpha))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = sum(counts[p].values()), sum(counts[q].values())
            if not n or not m:
                continue
            width = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(counts[p].get(a, 0) / n - counts[q].get(a, 0) / m) > width for a in counts[p].keys() | counts[q].keys()):
                return False
            todo += [(moves[p][a], moves[q][a]) for a in moves[p].keys() & moves[q].keys()]
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree under ``q`` to ``p``."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for a, n in counts[q].items():
                counts[p][a] += n
            for a, t in moves[q].items():
                if a in moves[p]:
                    todo.append((moves[p][a], t))
                else:
                    moves[p][a] = t

    red, edges = [0], deque((0, a) for a in sorted(moves[0]))
    while edges:
        p, a = edges.popleft()
        q = moves[p][a]
        if q in red:
            continue
        for r in red:
            if compatible(r, q):
                moves[p][a] = r
                before = set(moves[r])
                fold(r, q)
                edges.extend((r, b) for b in sorted(moves[r].keys() - before))
                break
        else:
            red.append(q)
            edges.extend((q, b) for b in sorted(moves[q]))
        if not edges:  # a fold can hang new trees under states that were done
            edges.extend((r, b) for r in red for b in sorted(moves[r]) if moves[r][b] not in red)
    number = {r: k for k, r in enumerate(red)}
    made = Automaton([dict(counts[r]) for r in red], [{a: number[t] for a, t in moves[r].items()} for r in red], 0.0)
    scores = sorted(s for w, n in words.items() for s in [made.score(w)] * n)
    made.floor = scores[len(scores) // 100]
    return made


class Background:
    """Class bigrams of prose, every bigram possible."""

    def __init__(self, pairs: Counter):
        firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            firsts[a] += n
        self.pairs, self.firsts = dict(pairs), dict(firsts)

    @classmethod
    def of(cls, words: list[str]) -> Background:
        return cls.counted(sum((symbol_pairs(w, []) for w in words), np.zeros(len(SYMBOLS) ** 2, np.int64)))

    @classmethod
    def counted(cls, counts: np.ndarray) -> Background:
        n = len(SYMBOLS)
        return cls(Counter({(SYMBOLS[k // n], SYMBOLS[k % n]): int(c) for k, c in enumerate(counts) if c}))

    def score(self, word: str) -> float:
        logs = [math.log((self.pairs.get((a, b), 0) + 0.5) / (self.firsts.get(a, 0) + 0.5 * len(SYMBOLS))) for a, b in zip(END + word, word + END, strict=True)]
        return sum(logs) / len(logs)


class Formats:
    """The automata of the kinds against the background of prose."""

    def __init__(self, examples: dict[str, list[str]], prose: list[str] | np.ndarray):
        """``prose``: words, or their counts of ``symbol_pairs``."""
        self.automata: dict[str, Automaton] = {}
        for kind, words in examples.items():
            if made := infer(Counter(e.translate(_TO_CLASS) for e in words)):
                made.spell(Counter(words))
                scores = sorted(made.score(e.translate(_TO_CLASS), e) for e in words)
                made.floor = scores[len(scores) // 100]
                self.automata[kind] = made
        self.background = Background.counted(prose) if isinstance(prose, np.ndarray) else Background.of(prose)
        self.known: dict[str, tuple[float, list[Automaton]]] = {}
        self.found: dict[str, list[tuple[int, int]]] = {}
        #: Joined pieces are credentials of a learned format up to this length.
        self.longest = max((len(e) for words in examples.values() for e in words), default=0)

    def margin(self, run: str) -> float:
        """By how much the run's format is likelier under the best automaton than as prose; -inf if below all floors."""
        word = run.translate(_TO_CLASS)
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            prose = self.background.score(word)
            if not ("h" in word or "l" in word):
                # A word in capitals is as much prose as in small letters, of which there is more to learn from.
                prose = max(prose, self.background.score(word.translate(_SMALL)))
            # Few formats can come about at all; only these are worth a look at the characters.
            self.known[word] = prose, [a for a in self.automata.values() if a.score(word) > -math.inf]
        prose, able = self.known[word]
        good = [s for a in able if (s := a.score(word, run)) >= a.floor]
        return max(good) - prose if good else -math.inf

    def spans(self, run: str) -> list[tuple[int, int]]:
        """(start, end) in ``run`` of what is likelier as a credential than as prose, apart from each other.

        The run as a whole, every piece between separators, and neighbouring pieces joined up to the
        longest example compete by the logarithm of their likelihood ratio; the best come first.
        """
        if run not in self.found:
            if len(self.found) > 50_000:
                self.found.clear()
            pieces = [m.span() for m in PIECE.finditer(run)]
            parts = {(0, len(run))}
            for i, (s, e) in enumerate(pieces):
                parts.add((s, e))
                for k in range(i + 1, len(pieces)):
                    if pieces[k][1] - s > self.longest:
                        break
                    parts.add((s, pieces[k][1]))
            scored = [((e - s + 1) * m, s, e) for s, e in parts if e - s >= LEAST["assign"] and (m := self.margin(run[s:e])) > 0]
            best: list[tuple[int, int]] = []  # by start
            for _, s, e in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
                k = bisect.bisect(best, (s, e))
                if (k == 0 or best[k - 1][1] <= s) and (k == len(best) or e <= best[k][0]):
                    best.insert(k, (s, e))
            self.found[run] = best
        return self.found[run]


_SCANNED = "doc_id long, base array<struct<start:long,kind:int,end:long>>, values array<string>, starts array<long>, runs array<string>, pairs array<long>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            base = base_spans(text)
            runs = candidates(text, base)
            if text:
                pairs += symbol_pairs(text, base)
            rows.append([doc_id, [{"start": s, "kind": k, "end": e} for s, k, e, _ in base], [f"{KINDS[k]}:{v}" for _, k, _, v in base], [s for s, _ in runs], [r for _, r in runs], None])
        if rows:
            rows[-1][-1] = pairs.tolist()  # the batch's counts travel with one of its rows
        yield pd.DataFrame(rows, columns=["doc_id", "base", "values", "starts", "runs", "pairs"]).astype({"doc_id": "Int64"})


def find(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Secrets of every document: (doc_id, n_assign, n_access, n_hex, n_inferred, base_sha256, spans).

    ``docs``: doc_id and text; more columns are ignored. Null and empty texts have no spans, and the
    hash of the empty string. Rows of the same doc_id each get a result. Spans are kind:start:end in
    code points, end exclusive, by start and then by kind. Texts of any length are scanned whole. Without any base match nothing is learned
    and nothing added; an empty table gives an empty result. The background of prose is counted over all words of all texts outside base spans.
    """
    with store.scratch(docs.sparkSession):  # what was scanned holds credentials in clear and goes at the end
        scanned = store.materialise(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scan, _SCANNED), "secrets-scan"
        )
        labelled = scanned.where("size(values) > 0").select(F.explode("values").alias("v")).distinct()
        learned = {}
        for kind in KINDS[:3]:
            some = labelled.where(F.col("v").startswith(kind + ":")).orderBy(F.xxhash64("v"), "v").limit(examples).collect()
            learned[kind] = [r.v[len(kind) + 1 :] for r in some]
        pairs = np.zeros(len(SYMBOLS) ** 2, np.int64)
        for r in scanned.where("pairs is not null").select(F.posexplode("pairs").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
            pairs[r.k] = r.n
        formats = Formats(learned, pairs)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for doc_id, base, starts, runs in zip(batch["doc_id"], batch["base"], batch["starts"], batch["runs"], strict=True):
                    spans = [(b["start"], b["kind"], b["end"]) for b in base]
                    own = Counter(k for _, k, _ in spans)
                    show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
                    more = [(int(s) + a, 3, int(s) + b) for s, r in zip(starts, runs, strict=True) for a, b in formats.spans(r)]
                    rows.append((doc_id, own[0], own[1], own[2], len(more), hashlib.sha256(show(spans).encode()).hexdigest(), show(spans + more)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_inferred", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

        scored = scanned.select("doc_id", "base", "starts", "runs").mapInPandas(
            score, "doc_id long, n_assign long, n_access long, n_hex long, n_inferred long, base_sha256 string, spans string"
        )
        return store.kept(scored, "secrets-found")
