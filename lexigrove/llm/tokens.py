"""Token ids of whole texts for Python tasks, and files of them in the shared folder.

White space always separates what the tokenizer sees, so a text's ids are those of its
white-space-delimited pieces in a row. Where the tokenizer lowers case and cuts between letters and other
characters by itself, ASCII letters are lowered and such cuts made before (not at apostrophes, which can begin
a word of their own, not at letters that the tokenizer turns into more than letters, such as a capital I with a dot,
and not in texts that may spell a special token), so that fewer pieces are distinct.
Pieces are split off and numbered by Arrow, each distinct piece is tokenized once a worker, and ids are
gathered by number. The memo outlives a task where workers are reused.
"""

from __future__ import annotations

import contextlib
import os
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers at most before it starts anew.
REMEMBERED = 600_000
#: Documents of a part of the corpus.
ROWS = 8192
#: Pieces whose ids are gathered at once.
GATHERED = 1 << 16
#: Bytes of text that are tokenized at once, if it is more than one document.
TEXT_BYTES = 16 << 20


def default_tokenizer() -> str:
    """The public vocabulary that the queries use; executors find it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII digits and marks other than an apostrophe.
_MARK = r"[!-&(-@\[-`{-~]"
#: Text whose tokenization shows whether a tokenizer lowers case and cuts there.
_PROBE = "Ab1c.D,e_F(g)2h"


def _cuts(normalise: Callable[[str], str]) -> tuple[str, str]:
    """Pattern and replacement that part a letter from a mark beside it, in either order. A character takes part in one cut.

    A letter that ``normalise`` turns into anything but letters (U+0130 becomes i and a combining dot, which would join
    a mark behind it) is left with its neighbours.
    """
    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalpha()]
    odd = [c for c, made in zip(letters, normalise(" ".join(letters)).split(" "), strict=True) if not made.isalpha()]
    letter = rf"[^\PL{''.join(rf'\x{{{ord(c):x}}}' for c in odd)}]"
    return rf"({letter})({_MARK})|({_MARK})({letter})", r"\1\3 \2\4"


#: Words of Latin letters that no Unicode normalisation changes and that stay letters in lower case.
_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def _light(tokenizer: Any) -> Any:
    """A tokenizer with the same model that takes words of Latin letters as they stand; None if its ids are others."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    made = Tokenizer(tokenizer.model)
    made.normalizer = normalizers.Lowercase()
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    letters = [c for c in map(chr, range(97, 0x250)) if _LATIN.fullmatch(c)]
    probe = " ".join(letters + [a + b for a, b in zip(letters, letters[1:], strict=False)] + ["nomenclature", "überprüfung", "évaluation"])
    return made if made.encode(probe, add_special_tokens=False).ids == tokenizer.encode(probe, add_special_tokens=False).ids else None


class Pieces:
    """Ids of distinct pieces in one flat pool."""

    def __init__(self, path: str, literal: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # True: the strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.apart = ids(_PROBE) == ids("ab 1 c . d , e _ f ( g ) 2 h")
        self.cuts = _cuts(self.tokenizer.normalizer.normalize_str) if self.apart else ("", "")
        self.light = _light(self.tokenizer) if self.apart else None
        self.marks = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Drop the pieces that one batch only has had; most pieces of a large corpus occur once."""
        words = list(self.number)
        keep = np.flatnonzero(self.uses[: len(words)] > 1)
        if len(keep) > REMEMBERED // 2:
            keep = keep[:0]
        starts, lengths = self.starts[keep], self.lengths[keep]
        ids = self.pool[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        self.clear()
        self._add([words[i] for i in keep.tolist()], ids, lengths)

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.number), len(words)
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while len(self.starts) < n + k:
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + k] = lengths
        self.used += len(ids)
        self.number.update(zip(words, range(n, n + k), strict=True))

    def learn(self, words: list[str]) -> None:
        # A piece of letters only is one word of the tokenizer, whose last id ends a word: many go in one call.
        latin, plain, rest = [], [], []
        for w in words:
            (latin if self.light and _LATIN.fullmatch(w) else plain if w.isalpha() else rest).append(w)
        for tokenizer, own in ((self.light, latin), (self.tokenizer, plain)):
            for i in range(0, len(own), 2000):
                some = own[i : i + 2000]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends[ids])
                if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                    self._add(some, ids, np.diff(ends, prepend=-1))
                else:  # some letter changes into several characters
                    rest += some
        for i in range(0, len(rest), 2000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest[i : i + 2000], add_special_tokens=False)]
            self._add(rest[i : i + 2000], np.array([t for ids in found for t in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def cut(self, texts: pa.Array) -> pa.Array:
        """The texts in lower case (ASCII) and with spaces at cuts, where that changes no ids."""
        if not self.apart:
            return texts
        made = pc.replace_substring_regex(pc.ascii_lower(texts), *self.cuts)
        for mark in self.marks:
            made = pc.if_else(pc.match_substring(texts, mark), texts, made)
        return made

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. A null text counts as empty."""
        split = pc.ascii_split_whitespace(self.cut(pc.fill_null(texts, "")))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.number.get, words))
        new = [w for w, k in zip(words, found, strict=True) if k is None]
        if new:
            if len(self.number) + len(new) > REMEMBERED:
                self.forget()
                new = [w for w in words if w not in self.number]
            self.learn(new)
            found = list(map(self.number.__getitem__, words))
        distinct = np.array(found, np.int64)
        self.uses[distinct] += 1
        own = distinct[numbered.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[own]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.empty(total[-1], np.uint32)
        base = self.starts[own] - total[:-1]
        for a in range(0, len(own), GATHERED):  # as much at a time as caches hold
            b = min(len(own), a + GATHERED)
            place = np.arange(total[a], total[b])
            place += np.repeat(base[a:b], lengths[a:b])
            self.pool.take(place, out=ids[total[a] : total[b]], mode="clip")
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids, np.diff(total[at])


def pieces(path: str, literal: bool = False) -> Pieces:
    """The worker's memo for a tokenizer file."""
    memo: Any = sys.modules.setdefault("_lexigrove_pieces", types.ModuleType("_lexigrove_pieces"))
    found = getattr(memo, "known", None)
    if found is None or found[0] != (path, literal):
        found = memo.known = ((path, literal), Pieces(path, literal))
    return found[1]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` documents and about ``TEXT_BYTES`` of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_BYTES, "right"))
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def ended(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each document."""
    last = np.cumsum(lengths + 1) - 1
    own = np.ones(len(ids) + len(lengths), bool)
    own[last] = False
    out = np.empty(len(own), np.uint32)
    out[own], out[last] = ids, end
    return out, lengths + 1


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writing(uri: str, name: str) -> Iterator[Any]:
    """A stream for a file that is put in place by a rename at the end, so that a task that runs twice leaves one."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        yield f
    system.move(aside, f"{folder}/{name}")


def write_file(uri: str, name: str, data: bytes) -> None:
    with writing(uri, name) as f:
        f.write(data)


def read_range(uri: str, name: str, start: int = 0, length: int | None = None) -> bytes:
    system, folder = open_folder(uri)
    with system.open_input_file(f"{folder}/{name}") as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def in_order(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) in partitions of about ``rows`` documents by ascending doc_id, null first.

    Rows of one doc_id are ordered by a hash of their text and then the text. Where more of them than a partition has share an
    id, the hash is part of the ranges too, so that they are not one partition; else the ranges need no text.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, most = source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    parts = max(1, -(-(total or 0) // rows))
    spread = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), spread.asc()]
    ranged = source.repartitionByRange(parts, *(order if (most or 0) > rows else order[:1]))
    return ranged.sortWithinPartitions(*order, "text")
