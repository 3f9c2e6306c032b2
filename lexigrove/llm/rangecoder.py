"""An adaptive context-mixing range coder for token ids.

A file's ids are cut into blocks, each coded on its own from the same first state and with a checksum. The
state that every block resets to is the file's order-0 model, the frequencies of its ids, which the header
holds: a block of some thousand ids cannot learn an alphabet of tens of thousands by itself. What
adapts in a block are the contexts. A table by the two ids before and one by the id before hold the id that last
followed and how often it did so in a row; the order-2 prediction is the candidate if it has held before, else the
order-1 one. Two adaptive estimates that the candidate is right, by the runs in both tables and by
the order-0 weight of the id before, are mixed with a weight that follows whichever has erred less.
An id that is not the candidate is coded by its order-0 frequency.

All blocks of a file advance together, one id a step, so that a step is a few dozen array operations
over all blocks. The coder has a low end of 48 bits with carry and a range of at least 32 bits; an id takes
at most 28 bits of it and is followed by moving whole 16-bit words out. All arithmetic is on integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block.
BLOCK = 2048
#: Blocks that advance together at most.
LANES = 8192
#: Ids are below this, and the order-0 frequencies add up to it.
LIMIT = 1 << 16
MAGIC = b"LXGRCM03"

_S1, _S2 = 1 << 8, 1 << 9
_I = np.int32
_LOW = np.uint64((1 << 32) - 1)
_FULL = np.uint64((1 << 48) - 1)
_U = np.uint64
#: The run of a symbol that has followed once more.
_RUN = np.array([1, 2, 3, 4, 5, 6, 7, 7], _I)


class Alphabet:
    """The ids of a file and their frequencies, which add up to ``LIMIT``. Symbols are places among the ids."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        #: 0 to 7 by how common a symbol is.
        self.weight = np.minimum(np.log2(freq.astype(np.float64)) * 0.75, 7).astype(_I)

    @classmethod
    def of(cls, ids: np.ndarray) -> Alphabet:
        times = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
        if len(times) > LIMIT:
            raise ValueError(f"ids must be below {LIMIT}")
        own = np.flatnonzero(times)
        freq = 1 + times[own] * (LIMIT - len(own)) // max(1, int(times.sum()))
        freq[np.argmax(freq)] += LIMIT - freq.sum()
        return cls(own, freq)

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        place = np.zeros(int(self.ids[-1]) + 1, np.uint16)  # symbols are below LIMIT
        place[self.ids] = np.arange(len(self.ids))
        return place[ids]

    def pack(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").tobytes() + (self.freq - _U(1)).astype("<u2").tobytes(), 9)

    @classmethod
    def unpack(cls, data: bytes) -> Alphabet:
        raw = zlib.decompress(data)
        n = len(raw) // 6
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.uint32), np.frombuffer(raw, "<u2", n, 4 * n).astype(np.int64) + 1)


class _Model:
    """The adaptive part; what a step needs of it is laid out by lane."""

    def __init__(self, lanes: int, weight: np.ndarray):
        lane = np.arange(lanes, dtype=np.int64)
        self.one, self.two = np.zeros(lanes * _S1, _I), np.zeros(lanes * _S2, _I)  # symbol << 3 | run
        self.base1, self.base2, self.lane64 = lane * _S1, lane * _S2, lane * 64
        self.pa, self.pb = np.full(lanes * 64, 4096, _I), np.full(lanes * 64, 4096, _I)
        self.mix = np.full(lanes, 8, _I)
        self.prev1, self.hash1 = np.zeros(lanes, _I), np.zeros(lanes, _I)
        self.weight, self.step = weight << 3, 0

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of the first n lanes and the odds of 4096 that they are right."""
        a = self.prev1[:n]
        # Products of 32 bits wrap alike everywhere.
        h = a * _I(40503)
        self.h = h
        self.i1 = self.base1[:n] + ((h >> 5) & (_S1 - 1))
        self.i2 = self.base2[:n] + ((h + self.hash1[:n] >> 4) & (_S2 - 1))
        e1, e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.p1, self.p2, self.c1, self.c2 = e1 >> 3, e2 >> 3, e1 & 7, e2 & 7
        self.sa = self.lane64[:n] + (self.c2 << 3 | self.c1)
        self.sb = self.lane64[:n] + (self.weight.take(a) | self.c1)
        self.xa, self.xb = self.pa.take(self.sa), self.pb.take(self.sb)
        # Estimates stay between 0 and 65504, so that odds are 1 to 4095.
        odds = (self.xb * 16 + (self.xa - self.xb) * self.mix[:n] >> 8) + 1
        return np.where(self.c2 > 0, self.p2, self.p1), odds.astype(np.uint64)

    def update(self, own: np.ndarray, hit: np.ndarray) -> None:
        n = len(own)
        goal = hit * _I(65535)
        ea, eb = goal - self.xa, goal - self.xb
        self.pa[self.sa] = self.xa + (ea >> 5)
        self.pb[self.sb] = self.xb + (eb >> 5)
        self.step += 1
        if self.step & 3 == 0:
            w = self.mix[:n]
            w += np.sign(np.abs(eb) - np.abs(ea))
            np.clip(w, 0, 16, out=w)
        fresh = own << 3
        self.one[self.i1] = fresh + _RUN.take(self.c1) * (self.p1 == own)
        self.two[self.i2] = fresh + _RUN.take(self.c2) * (self.p2 == own)
        np.multiply(self.h, _I(30983), out=self.hash1[:n])
        self.prev1[:n] = own


def _cut(symbols: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Groups of blocks as (steps x lanes) and the number of symbols of the last lane."""
    out = []
    for start in range(0, len(symbols), BLOCK * LANES):
        part = symbols[start : start + BLOCK * LANES]
        lanes = -(-len(part) // BLOCK)
        last = len(part) - (lanes - 1) * BLOCK
        out.append((np.concatenate([part, np.zeros(lanes * BLOCK - len(part), np.uint16)]).reshape(lanes, BLOCK).T.copy(), last))
    return out


def encode_blocks(ids: np.ndarray, alphabet: Alphabet) -> list[bytes]:
    """The code of each block of the ids."""
    coded: list[bytes] = []
    for steps, last in _cut(alphabet.symbols(ids)):
        lanes = steps.shape[1]
        model = _Model(lanes, alphabet.weight)
        low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
        out, pos = np.zeros((lanes, 2 * BLOCK + 8), np.uint16), np.zeros(lanes, np.int64)
        for t in range(BLOCK if lanes > 1 else last):
            n = lanes if t < last else lanes - 1
            own, lo, sp = steps[t, :n].astype(_I), low[:n], span[:n]
            guess, odds = model.predict(n)
            hit = own == guess
            r = sp >> _U(12)
            cut = r * odds
            unit = (r << _U(12)) - cut >> _U(16)
            lo += np.where(hit, _U(0), cut + alphabet.cum.take(own) * unit)
            sp[:] = np.where(hit, cut, alphabet.freq.take(own) * unit)
            over = np.flatnonzero(lo > _FULL)
            if len(over):
                lo[over] &= _FULL
                back = pos[over] - 1
                while len(over):
                    out[over, back] += np.uint16(1)
                    again = out[over, back] == 0
                    over, back = over[again], back[again] - 1
            short = np.flatnonzero(sp <= _LOW)
            while len(short):
                x = lo[short]
                at = pos[short]
                out[short, at] = x >> _U(32)
                pos[short] = at + 1
                lo[short] = (x & _LOW) << _U(16)
                x = sp[short] << _U(16)
                sp[short] = x
                short = short[x <= _LOW]
            model.update(own, hit)
        for lane in range(lanes):
            x = int(low[lane])
            tail = np.array([x >> 32, x >> 16 & 0xFFFF, x & 0xFFFF], "<u2")
            coded.append(out[lane, : pos[lane]].astype("<u2").tobytes() + tail.tobytes())
    return coded


def decode_blocks(coded: list[bytes], total: int, alphabet: Alphabet) -> np.ndarray:
    """The ids of consecutive blocks that hold ``total`` ids."""
    out = np.empty(total, np.uint32)
    slots = np.repeat(np.arange(len(alphabet.ids), dtype=_I), alphabet.freq.astype(np.int64))
    for g in range(0, len(coded), LANES):
        group = coded[g : g + LANES]
        lanes, start = len(group), g * BLOCK
        last = min(BLOCK, total - start - (lanes - 1) * BLOCK)
        words = np.zeros((lanes, max(map(len, group)) // 2 + 4), np.uint16)
        for lane, b in enumerate(group):
            words[lane, : len(b) // 2] = np.frombuffer(b, "<u2")
        first = words[:, :3].astype(np.uint64)
        value = first[:, 0] << _U(32) | first[:, 1] << _U(16) | first[:, 2]
        pos, span = np.full(lanes, 3, np.int64), np.full(lanes, _FULL)
        model = _Model(lanes, alphabet.weight)
        steps = np.zeros((BLOCK, lanes), np.uint16)
        for t in range(BLOCK if lanes > 1 else last):
            n = lanes if t < last else lanes - 1
            v, sp = value[:n], span[:n]
            guess, odds = model.predict(n)
            r = sp >> _U(12)
            cut = r * odds
            hit = v < cut
            unit = (r << _U(12)) - cut >> _U(16)
            rest = np.where(hit, _U(0), v - cut)
            # Quotients up to 2**16 of numbers below 2**48 are exact in doubles.
            symbol = slots.take(np.minimum((rest / unit).astype(_I), LIMIT - 1))
            own = np.where(hit, guess, symbol)
            v[:] = np.where(hit, v, rest - alphabet.cum.take(symbol) * unit)
            sp[:] = np.where(hit, cut, alphabet.freq.take(symbol) * unit)
            short = np.flatnonzero(sp <= _LOW)
            while len(short):
                at = pos[short]
                v[short] = v[short] << _U(16) | words[short, at]
                pos[short] = at + 1
                x = sp[short] << _U(16)
                sp[short] = x
                short = short[x <= _LOW]
            steps[t, :n] = own
            model.update(own, hit)
        flat = steps.T.reshape(-1)[: (lanes - 1) * BLOCK + last]
        out[start : start + len(flat)] = alphabet.ids[flat]
    return out


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A file: magic, counts, the zlib-packed tables of documents and of ids, the table of blocks, the blocks' codes.

    Little-endian. Counts: documents, ids, bytes of the document table, bytes of the id table, blocks. The document
    table has every doc_id (int64, 0 for null), whether it is null (uint8) and its number of ids (uint32); the id
    table the distinct ids as differences (uint32) and their frequencies less 1 (uint16). The block
    table has each block's number of ids, of code bytes, and the crc32 of its ids as uint32.
    """
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "<u1").tobytes() + lengths.astype("<u4").tobytes()
    table = zlib.compress(table)
    alphabet = Alphabet.of(ids)
    shown = alphabet.pack()
    coded = encode_blocks(ids, alphabet)
    block = lambda i: ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()
    entries = b"".join(struct.pack("<III", len(b) // 4, len(c), zlib.crc32(b)) for i, c in enumerate(coded) for b in [block(i)])
    return MAGIC + struct.pack("<QQQQQ", len(doc_ids), len(ids), len(table), len(shown), len(coded)) + table + shown + entries + b"".join(coded)


def unpack(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, doc_ids, lengths) of a file; a block that fails its checksum is an error."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_table, n_shown, n_blocks = struct.unpack_from("<QQQQQ", data, 8)
    at = 48 + n_table
    table = zlib.decompress(data[48:at])
    doc_ids = np.frombuffer(table, "<i8", n_docs)
    null = np.frombuffer(table, "<u1", n_docs, 8 * n_docs)
    lengths = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    alphabet = Alphabet.unpack(data[at : at + n_shown])
    at += n_shown
    entries = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    at += 12 * n_blocks
    ends = at + np.cumsum(entries[:, 1], dtype=np.int64)
    ids = decode_blocks([data[e - n : e] for e, n in zip(ends.tolist(), entries[:, 1].tolist(), strict=True)], n_ids, alphabet)
    for i, (n, _, crc) in enumerate(entries.tolist()):
        if zlib.crc32(ids[i * BLOCK : i * BLOCK + n].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return ids, [None if z else int(d) for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], lengths
