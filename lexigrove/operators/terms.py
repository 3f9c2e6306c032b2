"""Terms of many texts, counted where the texts are.

A pair of a document and a term is no row of any table. Texts are shuffled once, by id, unless their ids are known to be different; tasks cut them at white space
some thousand documents at a time, number the different words, cut each of these into its terms once, and count in
arrays. Terms of several kinds come from the same words in the same look at the texts. What leaves
a task is a row for each different term (``statistics``) or for each document, with the numbers of the terms that are asked for (``vectors``).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx

# What runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a block of documents, and pairs of a word's term and a document that are sorted at once, about.
WORDS, PAIRS = 1 << 21, 1 << 18
#: Different terms that a task holds before it adds up what it has.
HELD_TERMS = 1 << 20
#: Rows of a batch that goes to tasks.
RECORDS = 1000
#: Bytes of text that a task puts in the order of ids, about.
SORTED = 64 << 20
#: Bits of a packed count.
COUNT_BITS = 20
#: Logarithms of so many numbers are looked up.
LOGS = 1 << 12


Cut = tuple[pa.Array, np.ndarray, np.ndarray]


def _cut_by(terms: Callable[[str], list[str]], words: list[str]) -> Cut:
    cut = [terms(w) for w in words]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
    named = pa.array([t for c in cut for t in c], pa.string()).dictionary_encode()
    return named.dictionary, starts, named.indices.to_numpy().astype(np.int64)


def _joined(words: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), by)[0].as_py()


@dataclass(frozen=True)
class Kind:
    """``cut``: from different words (``text.split_words``) to (names of their terms, where each word's terms begin, their numbers)."""

    cut: Callable[[pa.Array], Cut]


def tokens() -> Kind:
    """The terms of ``text.tokenise``: no token has white space in it, so they are those of the words."""
    stop, find = pa.array(tx.STOPWORDS), re.compile(tx.WORD + "|\n").findall

    def cut(words: pa.Array) -> Cut:
        """All words at once, a line each."""
        found = pa.array(find(_joined(words, "\n").replace("ё", "е")), pa.string())
        ends = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
        keep = ~ends & (pc.utf8_length(found).to_numpy() > 1) & ~pc.is_in(found, stop).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(np.bincount(np.cumsum(ends)[keep], minlength=len(words)))])
        named = found.filter(pa.array(keep)).dictionary_encode()
        return named.dictionary, starts, named.indices.to_numpy().astype(np.int64)

    return Kind(cut)


def grams(low: int = 3, high: int = 5) -> Kind:
    """The terms of ``text.char_grams``."""

    bits = 63 // high

    def one(word: str) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1)] if word else []

    def cut(words: pa.Array) -> Cut:
        """All words at once: a gram is a number made of its characters' places in the alphabet of the words."""
        points = np.frombuffer((" " + _joined(words, "  ") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        there = np.zeros(int(points.max()) + 1, bool)
        there[points] = True
        alphabet = np.flatnonzero(there)
        if len(alphabet) >= 1 << bits or alphabet[0] == 0 or not len(words):
            return _cut_by(one, words.to_pylist())
        code = np.cumsum(there)[points].astype(np.int64)
        length = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
        begin = np.cumsum(length) - length
        many = {n: np.where(length > 2, np.maximum(length - n + 1, 0), 0) for n in range(low, high + 1)}
        starts = np.concatenate([[0], np.cumsum(sum(many.values()))])
        key, at = np.empty(starts[-1], np.int64), starts[:-1].copy()
        for n, each in many.items():
            if total := int(each.sum()):
                window = sum(code[k : len(code) - n + 1 + k] << (bits * k) for k in range(n))
                place = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
                key[np.repeat(at, each) + place] = window[np.repeat(begin, each) + place]
            at += each
        coded = pa.array(key).dictionary_encode()
        different = coded.dictionary.to_numpy()
        spelled = np.zeros((len(different), high), np.uint32)
        for k in range(high):
            own = (different >> (bits * k)) & ((1 << bits) - 1)
            spelled[:, k] = np.where(own > 0, alphabet[own - 1], 0)
        names = pa.array(spelled.view(f"<U{high}").reshape(-1).tolist(), pa.string())
        return names, starts, coded.indices.to_numpy().astype(np.int64)

    return Kind(cut)


def _parts(texts: DataFrame, text: str) -> int:
    """Partitions in which texts are about ``SORTED`` bytes."""
    return (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SORTED


def _dealt(texts: DataFrame, key: str, text: str, apart: bool = False) -> DataFrame:
    """(id, text in lower case), rows of an id in one task and beside each other. ``apart``: no two rows have the same id."""
    rows = texts.select(F.col(key).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    if apart:
        return rows
    parts = _parts(rows, "text")
    # The session's number of partitions, more where these would grow with the texts.
    dealt = rows.repartition(parts, "id") if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("id")
    return dealt.sortWithinPartitions("id")


def split(texts: pa.Array) -> pa.Array:
    """The words of ``text.split_words``, from texts in lower case."""
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # white space to Arrow, not to Java
        return pc.split_pattern_regex(texts, "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    return pc.utf8_split_whitespace(texts)


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether a row has another id than the one before it."""
    if len(ids) < 2:
        return np.ones(len(ids), bool)
    a, b = ids[1:], ids[:-1]
    other = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    both = (pc.is_null(a).to_numpy(zero_copy_only=False)) & (pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.concatenate([[True], other & ~both])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(ids, number of the document of each word, words) of whole documents, about ``WORDS`` words at a time."""

    def made(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
        ids, words = table.column(0).combine_chunks(), table.column(1).combine_chunks()
        first = _changes(ids)
        times = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        return ids.filter(pa.array(first)), np.repeat(np.cumsum(first) - 1, times), words.flatten()

    waiting: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        words = split(batch.column(1))
        waiting.append(pa.table({"id": batch.column(0), "words": words}))
        n += len(words.flatten())
        if n >= WORDS:
            table = pa.concat_tables(waiting)
            ends = np.flatnonzero(_changes(table.column(0).combine_chunks()))
            stop = int(ends[-1])
            if stop:
                yield made(table.slice(0, stop))
            waiting = [table.slice(stop)]
            n = len(waiting[0].column(1).combine_chunks().flatten())
    if waiting:
        yield made(pa.concat_tables(waiting))


def _repeated(doc: np.ndarray, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The block's different words, and (document, number of the word, times) by document: repeated words are counted before they are cut up."""
    coded = words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair = np.sort(doc * n + coded.indices.to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
    return coded.dictionary, pair[first] // n, pair[first] % n, np.diff(np.append(first, len(pair)))


def _some(d: np.ndarray, w: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of documents' words (begin, end, how many terms each has, where these are), whole documents, about ``PAIRS`` terms at a time."""
    size = starts[w + 1] - starts[w]
    total = np.cumsum(size)
    edges = [0]
    while edges[-1] < len(d):
        begun = total[edges[-1] - 1] if edges[-1] else 0
        k = int(np.searchsorted(total, begun + PAIRS, "right"))
        k = int(np.searchsorted(d, d[k], "left")) if k < len(d) else len(d)
        edges.append(k if k > edges[-1] else int(np.searchsorted(d, d[edges[-1]], "right")))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        each = size[a:b]
        if whole := int(each.sum()):
            yield a, b, each, np.repeat(starts[w[a:b]] - (np.cumsum(each) - each), each) + np.arange(whole)


def _different(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])


def _bits(n: int) -> int:
    """Bits of the numbers below ``n``."""
    return max(1, int(n - 1).bit_length())


def _spread(d: np.ndarray, w: np.ndarray, starts: np.ndarray, number: np.ndarray, n_terms: int) -> np.ndarray:
    """How many of the documents have each term."""
    df, wide = np.zeros(n_terms, np.int64), number.astype(np.int32) if n_terms < 1 << 31 else number
    for a, b, each, at in _some(d, w, starts):
        own = d[a:b] - d[a]
        bits = _bits(int(own[-1]) + 1)
        short = bits + _bits(n_terms) < 32
        key = ((wide if short else number)[at] << bits) | np.repeat(own.astype(np.int32) if short else own, each)
        key.sort()
        df += np.bincount(key[_different(key)] >> bits, minlength=n_terms)
    return df


def _counts(d: np.ndarray, w: np.ndarray, times: np.ndarray, starts: np.ndarray, number: np.ndarray, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, number of the term, times), some documents at a time, by document and term."""
    bits = _bits(n_terms)
    for a, b, each, at in _some(d, w, starts):
        key = np.repeat((d[a:b] - d[a]) << bits, each) | number[at]
        most = int(times[a:b].max())
        if most < 1 << COUNT_BITS and bits + _bits(int(d[b - 1] - d[a]) + 1) + COUNT_BITS < 64:
            packed = (key << COUNT_BITS) | np.repeat(times[a:b], each)
            packed.sort()
            key, count = packed >> COUNT_BITS, packed & ((1 << COUNT_BITS) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key, count = key[order], np.repeat(times[a:b], each)[order]
        own = np.flatnonzero(_different(key))
        yield d[a] + (key[own] >> bits), key[own] & ((1 << bits) - 1), np.add.reduceat(count, own)


def statistics(texts: DataFrame, key: str, text: str, kind: Kind) -> DataFrame:
    """(term, df, n): documents that have the term, and how often all of them have it. Rows that share an id are one document."""
    return statistics_of(texts, key, text, {"": kind}).select("term", "df", "n")


def statistics_of(texts: DataFrame, key: str, text: str, kinds: dict[str, Kind], apart: bool = False) -> DataFrame:
    """(kind, term, df, n): ``statistics`` of several kinds by one look at the texts. ``apart``: no two rows have the same id."""
    cuts = {name: kind.cut for name, kind in kinds.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {name: [] for name in cuts}
        size = dict.fromkeys(cuts, 0)

        def added(name: str) -> pa.Table:
            found = pa.concat_tables(held[name]).group_by("term").aggregate([("df", "sum"), ("n", "sum")])
            return found.select(["term", "df_sum", "n_sum"]).rename_columns(["term", "df", "n"])

        def out(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.add_column(0, "kind", pa.repeat(pa.scalar(name), table.num_rows)).to_batches(max_chunksize=100_000)

        for _, doc, words in _blocks(batches):
            different, d, w, times = _repeated(doc, words)
            whole = np.bincount(w, times, len(different))
            for name, cut in cuts.items():
                names, starts, number = cut(different)
                n = np.bincount(number, np.repeat(whole, np.diff(starts)), len(names)).astype(np.int64)
                held[name].append(pa.table({"term": names, "df": _spread(d, w, starts, number, len(names)), "n": n}))
                size[name] += len(names)
                if size[name] > 2 * HELD_TERMS:
                    held[name] = [added(name)]
                    size[name] = held[name][0].num_rows
                    if size[name] > HELD_TERMS:  # hardly any term comes again: on they go
                        yield from out(name, held[name][0])
                        held[name], size[name] = [], 0
        for name in cuts:
            if held[name]:
                yield from out(name, added(name))

    rows = _dealt(texts, key, text, apart).mapInArrow(count, "kind string, term string, df long, n long")
    return rows.groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


class Known:
    """Terms with weights and numbers, in the order of their hashes; ``find`` takes no time that grows with how many there are, as a table of them made for each block would."""

    def __init__(self, rows: pa.Table):
        """``rows``: (term, weight, t, h) by h, which is Spark's ``xxhash64``."""
        self.h, self.names, self.weight = rows.column("h").to_numpy(), rows.column("term").combine_chunks(), rows.column("weight").to_numpy()
        self.number = pc.fill_null(rows.column("t"), -1).to_numpy()

    def find(self, terms: pa.Array) -> np.ndarray:
        """The places of the terms, -1 where unknown; terms that share a hash are told apart by name."""
        h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms.to_pylist()), np.uint64, len(terms)).view(np.int64)
        out, left = np.full(len(terms), -1), np.arange(len(terms))
        at = np.searchsorted(self.h, h)
        while len(left):
            there = at < len(self.h)
            there[there] = self.h[at[there]] == h[left[there]]
            left, at = left[there], at[there]
            same = pc.equal(self.names.take(pa.array(at)), terms.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[same]] = at[same]
            left, at = left[~same], at[~same] + 1
        return out


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``t``, numbers from 0 without gaps, written, because the numbers could differ when they are computed again."""
    written = store.materialise(rows.withColumn("at", F.monotonically_increasing_id()), label).withColumn("part", F.shiftright("at", 33))
    # One row a partition.
    sizes = sorted(written.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0] + [r.n for r in sizes]).tolist()
    starts = rows.sparkSession.createDataFrame([(r.part, k) for r, k in zip(sizes, before, strict=False)], "part long, start long")
    own = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("start") + own).alias("t"))


def logs(n: np.ndarray, power: int = 1) -> np.ndarray:
    """1 + ln n of counts, to a power."""
    if not len(n) or (most := int(n.max())) >= LOGS:
        return (1 + np.log(n)) ** power
    return ((1 + np.log(np.maximum(np.arange(most + 1), 1))) ** power)[n]


def packed(numbers: np.ndarray, each: np.ndarray) -> pa.Array:
    """A column of bytes: ``each`` of the numbers in a row, four bytes a number. Spark copies such a column whole, lists of numbers one by one."""
    ends = np.concatenate([[0], np.cumsum(each)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(numbers, np.int32))]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of ``packed``, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    if ends[-1] == ends[0]:
        return np.empty(0, np.int32), np.zeros(len(column), np.int64)
    return np.frombuffer(data, np.int32, int(ends[-1] - ends[0]) // 4, int(ends[0])), np.diff(ends) // 4


def entries(vectors: DataFrame) -> DataFrame:
    """(doc_id, t, tf), a row each, of ``vectors``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, each = unpacked(batch.column(1))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), each)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(t.astype(np.int64)), pa.array(unpacked(batch.column(2))[0].astype(np.int64))], ["doc_id", "t", "tf"])

    return vectors.select("doc_id", "t", "tf").mapInArrow(rows, f"doc_id {dict(vectors.dtypes)['doc_id']}, t long, tf long")


def vectors(texts: DataFrame, key: str, text: str, kind: Kind, known: DataFrame, rest: float | None, label: str = "vectors", passes: int = 1) -> DataFrame:
    """(doc_id, scale, t, tf), written: the asked terms of each document that has any, by number, and how often it has them, as ``packed``.

    ``known``: (term, weight, t) of the terms that can be asked for or have a weight of their own, t null if not asked; ``rest``: the weight of all other
    terms. ``scale`` is the norm of the whole document's (1 + ln tf) * weight, or, with ``rest`` None, the number of its terms.

    With several ``passes`` each takes its part of the known terms over all texts, so that no more are sent at once, and a document's parts are added up.
    """
    if passes > 1:
        part = lambda g: known.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == g)
        found = [_passed(texts, key, text, kind, part(g), rest, f"{label}-part", g) for g in range(passes)]
        rows = reduce(DataFrame.unionByName, found)
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _parts(texts, text))
        added = rows.repartition(parts, "doc_id").groupBy("doc_id").agg(F.sum("scale").alias("scale"), F.collect_list(F.struct("t", "tf")).alias("parts"))
        joined = lambda c: F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p[c])).alias(c)
        scale = F.col("scale") if rest is None else F.sqrt("scale")
        return store.materialise(added.select("doc_id", scale.alias("scale"), joined("t"), joined("tf")).where(F.length("t") > 0), label, records=RECORDS)
    return _passed(texts, key, text, kind, known, rest, label, None)


@dataclass(frozen=True)
class Side:
    """Terms of a kind, with ``known`` and ``rest`` as in ``vectors``."""

    kind: Kind
    known: DataFrame
    rest: float | None


def vectors_of(texts: DataFrame, key: str, text: str, sides: dict[str, Side], label: str = "vectors", nth: int | None = None, apart: bool = False) -> DataFrame:
    """(doc_id, and norm_, size_, t_ and tf_ with the name of each side), written: ``vectors`` of several kinds by one look at the texts. ``apart``: no two rows have the same id.

    The norm is null where a side has no ``rest``. A document has a row if it has an asked term of any side.

    If this is the ``nth`` of several passes: a row of every document that has terms, its norm without the root and only with what
    this pass knows, its size only in the first one; the first one takes all terms for others, the known ones' difference from that is added.
    """
    id_type, context = dict(texts.dtypes)[key], texts.sparkSession.sparkContext
    sent, made = {}, {}
    for name, side in sides.items():
        table = side.known.select("term", F.col("weight").cast("double").alias("weight"), "t", F.xxhash64("term").alias("h")).toArrow()
        sent[name] = context.broadcast(table.sort_by("h"))
        made[name] = side.kind.cut, side.rest
    columns = [f"{c}_{name}" for name in sides for c in ("norm", "size", "t", "tf")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for name, (_, rest) in made.items():
            known = Known(sent[name].value)
            # What a term adds to a norm; the place -1 is that of all others.
            square = np.append(known.weight, rest or 0.0) ** 2 - (0.0 if not nth else (rest or 0.0) ** 2)
            if nth:
                square[-1] = 0.0
            tables[name] = known, square, np.append(known.number, -1)
        for ids, doc, words in _blocks(batches):
            different, d, w, times = _repeated(doc, words)
            n, out = len(ids), {}
            has = np.zeros(n, bool)
            for name, (cut, rest) in made.items():
                known, square, number = tables[name]
                names, starts, own = cut(different)
                at = known.find(names)
                adds, asked = square[at], number[at].astype(np.int32)
                wanted = asked >= 0
                norm, each = np.zeros(n), np.zeros(n, np.int64)
                size = np.bincount(d, times * np.diff(starts)[w], n) if not nth else np.zeros(n)
                t_parts, tf_parts = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
                for docs, t, tf in _counts(d, w, times, starts, own, len(names)):
                    low, high = int(docs[0]), int(docs[-1]) + 1
                    docs = docs - low
                    if rest is not None:
                        norm[low:high] = np.bincount(docs, logs(tf, 2) * adds[t], high - low)
                    if nth is not None:
                        has[low + docs] = True
                    keep = np.flatnonzero(wanted[t])
                    each[low:high] = np.bincount(docs[keep], minlength=high - low)
                    t_parts.append(asked[t[keep]])
                    tf_parts.append(tf[keep].astype(np.int32))
                has |= each > 0
                out[name] = norm, size, each, np.concatenate(t_parts), np.concatenate(tf_parts)
            rows = np.flatnonzero(has)
            if not len(rows):
                continue
            arrays = [ids.take(pa.array(rows))]
            for name, (norm, size, each, t, tf) in out.items():
                norm = norm[rows] if nth is not None else np.sqrt(norm[rows])
                arrays += [pa.array(norm) if made[name][1] is not None else pa.nulls(len(rows), pa.float64()), pa.array(size[rows]), packed(t, each[rows]), packed(tf, each[rows])]
            yield from pa.Table.from_arrays(arrays, ["doc_id", *columns]).to_batches(max_chunksize=RECORDS)

    types = ", ".join(f"`{c}` {'double' if c[:4] in ('norm', 'size') else 'binary'}" for c in columns)
    rows = _dealt(texts.where(F.col(key).isNotNull()), key, text, apart)
    try:
        return store.materialise(rows.mapInArrow(look, f"doc_id {id_type}, {types}"), label, records=RECORDS)
    finally:
        for s in sent.values():
            s.destroy()


def of_side(vectors: DataFrame, name: str, scale: str) -> DataFrame:
    """(doc_id, scale, t, tf) of a side of ``vectors_of``; ``scale``: norm or size."""
    return vectors.select("doc_id", F.col(f"{scale}_{name}").alias("scale"), F.col(f"t_{name}").alias("t"), F.col(f"tf_{name}").alias("tf"))


def _passed(texts: DataFrame, key: str, text: str, kind: Kind, known: DataFrame, rest: float | None, label: str, nth: int | None) -> DataFrame:
    """The vectors of one side by one look at the texts, the ``nth`` of several or the only one."""
    return of_side(vectors_of(texts, key, text, {"own": Side(kind, known, rest)}, label, nth), "own", "size" if rest is None else "norm")
