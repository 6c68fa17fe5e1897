"""Byte-level BPE on numpy arrays: token counts and token ids without a Python object per word.

Texts are cut into pre-tokens as the public pattern of the rank files says, with array
operations over character classes. Pre-tokens that the process has met are found in a
direct-mapped table by their 64-bit hash. The others are merged rank-synchronously: a batch of
pre-tokens is one ragged array of symbols, and in each turn every sequence applies its
lowest-rank pair at the same time as all others; sequences without a pair left are
done. The symbols that survive are the tokens.

The vocabulary is a file of ranks (base64 token, rank); its path is a parameter and
the file is never copied. Cases: null and empty texts have no tokens; a null doc_id stays null; rows that repeat are
counted each; an empty table gives no rows; other columns are ignored, whatever their names. Very long texts are never
cut: one is a slice of its own, and a pre-token of any length is merged whole.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import long_ids, mix, powers, slices

RANKS = os.environ.get("SYNAPTA_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
EOS = 50256

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_NONE = np.int64(1 << 40)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, _OTHER, np.uint8)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            text = "".join(map(chr, range(lo, hi)))
            for kind, p in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(p, text):
                    table[lo + m.start() : lo + m.end()] = kind
        _classes = table
    return _classes


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, as byte places; data is UTF-8 and offs are the documents' bounds."""
    if not len(data):
        return np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(code)
    kind = classes()[code]
    bound = np.zeros(n + 1, bool)
    bound[np.searchsorted(at, offs)] = True
    start = bound[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before a word: a space goes with the word, another one stands alone
    run = np.flatnonzero(start[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~bound[1:n]) + 1
    start[run] = code[run - 1] != 32
    start[run - 1] = True
    # contractions
    a = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~bound[1:n])
    if len(a):
        c1 = code[a + 1]
        c2 = np.where((a + 2 < n) & ~bound[np.minimum(a + 2, n)], code[np.minimum(a + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        size = np.where(one, 2, np.where(two, 3, 0))
        a, size = a[size > 0], size[size > 0]
        start[a + 1] = False
        after = a + size
        after = after[after < n]
        start[after] = True
    return at[start]


class Ranks:
    """Ranks of single bytes, and of every pair of tokens that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.top = max(ranks.values())
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        p = np.array(pairs, np.int64)
        key, rank = p[:, 0] << 20 | p[:, 1], p[:, 2]
        self.mask = (1 << 20) - 1
        while self.mask < 4 * len(key):
            self.mask = self.mask * 2 + 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, np.int64)
        slot = self.slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.ranks[slot[placed]] = rank[placed]
            key, rank, slot = key[~placed], rank[~placed], (slot[~placed] + 1) & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def of(self, a, b) -> np.ndarray:
        """The rank of each pair; _NONE where they make no token."""
        key = a << 20 | b
        slot = self.slot(key)
        out = np.full(len(key), _NONE, np.int64)
        found = self.keys[slot]
        hit = found == key
        out[hit] = self.ranks[slot[hit]]
        open_ = np.flatnonzero(~hit & (found != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            open_, slot = open_[go], slot[go]
        return out

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply merges to ragged sequences: (tokens of all in order, tokens of each)."""
        count = np.zeros(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        seq = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(sym), _NONE, np.int64)  # of each symbol with the next
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.of(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            length = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, length)
                count[seq[first[over]]] = length[over]
                done.append((seq[gone], sym[gone]))
                sym, seq, rank = sym[~gone], seq[~gone], rank[~gone]
                length, least = length[~over], least[~over]
                if not len(sym):
                    break
            lowest = np.flatnonzero(rank == np.repeat(least, length))
            at = self._choose(sym, seq, rank, lowest)
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            at = place[at]
            for k in (at, at[at > 0] - 1):  # ranks of the merged symbols with their neighbours
                rank[k] = _NONE
                k = k[k + 1 < len(sym)]
                k = k[seq[k] == seq[k + 1]]
                rank[k] = self.of(sym[k], sym[k + 1])
        if not done:
            return np.zeros(0, np.int64), count
        s = np.concatenate([d[0] for d in done])
        return np.concatenate([d[1] for d in done])[np.argsort(s, kind="stable")], count

    def _choose(self, sym, seq, rank, lowest):
        """Of places of the lowest rank, those that are merged now: the leftmost of each
        sequence, and the others too if no merge makes a pair of a still lower rank."""
        new = np.concatenate([[True], seq[lowest[1:]] != seq[lowest[:-1]]])
        if new.all():
            return lowest
        # occurrences that overlap take turns, from the left
        head = np.concatenate([[True], (lowest[1:] != lowest[:-1] + 1) | new[1:]])
        start = np.maximum.accumulate(np.where(head, lowest, 0))
        free = (lowest - start) % 2 == 0
        lowest, new = lowest[free], new[free]
        m = rank[lowest]
        n, none = len(sym), np.int64(-1)
        left, right = np.maximum(lowest - 1, 0), np.minimum(lowest + 2, n - 1)
        before = np.where((lowest > 0) & (seq[left] == seq[lowest]), sym[left], none)
        after = np.where((lowest + 2 < n) & (seq[right] == seq[lowest]), sym[right], none)
        worst = np.full(len(lowest), _NONE, np.int64)
        for a, b in ((before, m), (m, after), (m, m)):
            ok = (a >= 0) & (b >= 0)
            worst[ok] = np.minimum(worst[ok], self.of(a[ok], b[ok]))
        first = np.flatnonzero(new)
        lower = np.minimum.reduceat(np.where(worst < m, 0, 1), first) == 0
        return lowest[new | ~np.repeat(lower, np.diff(np.append(first, len(lowest))))]


class Encoder:
    """Encodes slices of documents; keeps the pre-tokens it has met in a direct-mapped table."""

    BITS = 20
    LIMIT = 1 << 23

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.clear()

    def id_bytes(self, eos: int | None) -> int:
        """Bytes that hold any id."""
        return 2 if max(self.ranks.top, eos or 0) < 1 << 16 else 4

    def clear(self) -> None:
        n = 1 << self.BITS
        self.key = np.zeros(n, np.uint64)
        self.first = np.zeros(n, np.int64)
        self.size = np.full(n, -1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def slice(self, data: np.ndarray, offs: np.ndarray):
        """(first, size) of each pre-token's ids in self.ids, and the documents' bounds in pre-tokens."""
        if len(self.ids) > self.LIMIT:
            self.clear()
        starts = pre_tokens(data, offs)
        bounds = np.searchsorted(starts, offs)
        if not len(starts):
            return starts, starts, bounds
        ends = np.append(starts[1:], len(data))
        p, q = powers(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
        size = ends - starts
        h = mix(((total[ends] - total[starts]) * q[starts]) ^ size.astype(np.uint64))
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        first, count = self.first[slot], self.size[slot]
        miss = np.flatnonzero((self.key[slot] != h) | (count < 0))
        if len(miss):
            _, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            which = miss[at]
            s = size[which]
            inside = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            raw = data[np.repeat(starts[which], s) + inside]
            ids, n = self.ranks.merge(self.ranks.byte[raw], s)
            f = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            where = slot[which]
            self.key[where], self.first[where], self.size[where] = h[which], f, n
            # two new ones may share a slot; the one that was written last has to be whole
            first[miss], count[miss] = f[back], n[back]
        return first, count, bounds

    def documents(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in order, ids of each)."""
        first, count, bounds = self.slice(data, offs)
        upto = np.concatenate([[0], np.cumsum(count)])
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1], count)
        return self.ids[np.repeat(first, count) + inside], np.diff(upto[bounds])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) of every row; a null doc_id stays null."""

    def run(batches):
        e = encoder(ranks)
        for b in batches:
            ids = long_ids(b.column(0))
            for lo, data, offs in slices(b.column(1)):
                _, count, bounds = e.slice(data, offs)
                upto = np.concatenate([[0], np.cumsum(count)])
                yield pa.record_batch([ids.slice(lo, len(offs) - 1), pa.array(np.diff(bounds)), pa.array(np.diff(upto[bounds]))], names=["doc_id", "n_pre_tokens", "n_tokens"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long")


def encoded(texts, ranks: str, eos: int | None):
    """Yield (ids of documents, all tokens, tokens of each) for slices of (doc_id, text) batches; eos ends each document."""
    e = encoder(ranks)
    for b in texts:
        ids = long_ids(b.column(0))
        for lo, data, offs in slices(b.column(1)):
            flat, n = e.documents(data, offs)
            if eos is not None:
                whole = np.empty(len(flat) + len(n), np.uint32)
                last = np.cumsum(n + 1) - 1
                rest = np.ones(len(whole), bool)
                rest[last] = False
                whole[rest], whole[last] = flat, eos
                flat, n = whole, n + 1
            yield ids.slice(lo, len(n)), flat, n


def token_ids(docs: DataFrame, ranks: str = RANKS, eos: int | None = EOS) -> DataFrame:
    """(part, before, doc_id, n, ids): tokens as little-endian integers of 16 bits or, where the vocabulary has more, 32 (``Encoder.id_bytes``).

    part is the partition, before the tokens of its earlier rows: with the partitions'
    totals that gives global offsets.
    """

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        size = encoder(ranks).id_bytes(eos)
        for ids, flat, n in encoded(batches, ranks, eos):
            upto = np.concatenate([[0], np.cumsum(n)])
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(upto * size), pa.py_buffer(flat.astype(f"<u{size}"))])
            yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(before + upto[:-1]), ids, pa.array(n), raw.cast(pa.binary())], names=["part", "before", "doc_id", "n", "ids"])
            before += int(upto[-1])

    return _texts(docs).mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")
