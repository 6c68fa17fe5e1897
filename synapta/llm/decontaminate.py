"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The test strings are all passages of ``NGRAM`` words of every benchmark item, and the
whole item where it is shorter. Texts and patterns are normalised alike: lower case (ASCII and
Latin-1), ASCII punctuation as white space, one space between words and at both ends.

Search looks at windows of m bytes, m being the shortest pattern's length. A table by the
hash of a window's last B bytes says how far the window may move without skipping an
occurrence; where it says 0, the buckets of those B bytes name the patterns whose
first m bytes end so, and direct comparison of the pattern's bytes confirms an
occurrence. Many windows move at a time: a slice of text is divided into lanes, and a turn
moves each lane's window. Patterns too short for a useful table form a group of their own.

The pattern tables are built from the benchmark, which the driver reads in
pieces of ``PIECE`` bytes; each piece is one pass with its own tables, so what is sent to
executors is bounded whatever the size of the benchmark. A process builds the tables of a piece once and keeps
them for its next tasks. Texts aren't shuffled.

Cases: null and blank texts and items have no occurrence; items that repeat are found
under each of their ids; a null item_id or doc_id is reported as null; extra columns are ignored by
``occurrences`` and kept by ``remove``; an empty benchmark or table gives no occurrence. Very long texts are searched whole; passages that overlap count each. Rows that
share a doc_id are reported each, and ``remove`` judges every row by its own text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACE, long_ids, normalised, slices
from .tokens import _texts

NGRAM = 13
PIECE = 32_000_000
LANE = 1024
SHORT = 12
_SEP = 1


def flatten(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised documents between separators, one space around each word, and where each begins."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    out = np.full(len(data) + 3 * n, 32, np.uint8)
    out[np.arange(len(data)) + 3 * doc + 2] = normalised(data)
    begin = offs[:-1] + 3 * np.arange(n)
    out[begin] = _SEP
    space = SPACE[out]
    out[space] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return out[keep], (np.cumsum(keep) - 1)[begin]


class Group:
    """Shift table and buckets of patterns of at least m bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.b = min(8, self.m)
        self.bits = max(12, min(22, (len(patterns) * 16).bit_length()))
        self.cut = np.uint64((1 << 8 * self.b) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        for j in range(self.m - self.b + 1):
            block = np.zeros((len(patterns), 8), np.uint8)
            block[:, : self.b] = heads[:, j : j + self.b]
            block = block.view(np.uint64)[:, 0]
            np.minimum.at(self.shift, self.hash(block), self.m - self.b - j)
        order = np.argsort(block, kind="stable")
        self.suffix, self.first = np.unique(block[order], return_index=True)
        self.order, self.first = order, np.append(self.first, len(order))

    def hash(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray, raw: bytes):
        """(place, pattern) of every occurrence."""
        n = len(text)
        if n < self.m:
            return
        eight = np.ndarray((n,), "<u8", buffer=np.append(text, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        lanes = np.arange(self.m, n + 1, LANE)  # ends of the first window of each lane
        stop = np.append(lanes[1:], n + 1)
        hits = []
        while len(lanes):
            block = eight[lanes - self.b] & self.cut
            step = self.shift[self.hash(block)]
            zero = np.flatnonzero(step == 0)
            if len(zero):
                hits.append((lanes[zero], block[zero]))
            lanes = lanes + np.maximum(step, 1)
            go = lanes < stop
            lanes, stop = lanes[go], stop[go]
        if not hits:
            return
        end, block = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
        k = np.searchsorted(self.suffix, block)
        ok = (k < len(self.suffix)) & (self.suffix[np.minimum(k, len(self.suffix) - 1)] == block)
        for e, k in zip(end[ok].tolist(), k[ok].tolist()):
            at = e - self.m
            for p in self.order[self.first[k] : self.first[k + 1]].tolist():
                if raw.startswith(self.patterns[p], at):
                    yield at, p


class Matcher:
    """Test strings of benchmark items, by groups of similar length."""

    def __init__(self, items: list[tuple[int | None, str | None]], ngram: int):
        found: dict[bytes, set] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if not len(raw):
                continue
            flat, _ = flatten(raw, np.array([0, len(raw)]))
            w = flat[1:].tobytes().split()
            for i in range(max(1, len(w) - ngram + 1) if w else 0):
                found.setdefault(b" " + b" ".join(w[i : i + ngram]) + b" ", set()).add(item)
        short = {p for p in found if len(p) < SHORT}
        some = [sorted(x) for x in (short, found.keys() - short) if x]
        self.groups = [Group(x) for x in some]
        self.items = [[sorted(found[p], key=lambda i: (i is not None, i)) for p in x] for x in some]

    def count(self, data: np.ndarray, offs: np.ndarray) -> dict:
        """(document, item): occurrences of the item's test strings."""
        flat, begin = flatten(data, offs)
        raw, counts = flat.tobytes(), {}
        for group, items in zip(self.groups, self.items):
            found = list(group.find(flat, raw))
            doc = np.searchsorted(begin, np.array([f[0] for f in found], np.int64), "right") - 1
            for d, (_, p) in zip(doc.tolist(), found):
                for item in items[p]:
                    counts[d, item] = counts.get((d, item), 0) + 1
        return counts


def _pieces(benchmark: DataFrame):
    """Items in lists of about PIECE bytes of text."""
    items, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        items.append((r[0], r[1]))
        size += len(r[1] or "")
        if size > PIECE:
            yield items
            items, size = [], 0
    if items:
        yield items


def _passes(docs: DataFrame, benchmark: DataFrame, ngram: int, run_with, schema: str) -> DataFrame:
    spark, out = docs.sparkSession, None
    for items in _pieces(benchmark):
        sent = _send(docs, items)
        found = docs.mapInArrow(run_with(sent, ngram), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


_built: dict[tuple[str, int], Matcher] = {}


def _matcher(sent, ngram: int) -> Matcher:
    """This process's tables of a piece; those of the last two pieces are kept."""
    name, value = sent
    if (name, ngram) not in _built:
        while len(_built) > 1:
            del _built[next(iter(_built))]
        _built[name, ngram] = Matcher(value.value, ngram)
    return _built[name, ngram]


def _send(docs: DataFrame, items: list) -> tuple:
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)


def _occurrences_udf(sent, ngram):
    def run(batches):
        m = _matcher(sent, ngram)
        for b in batches:
            ids = long_ids(b.column(0))
            for lo, data, offs in slices(b.column(1)):
                counts = m.count(data, offs)
                if counts:
                    at = pa.array([lo + d for d, _ in counts], pa.int64())
                    yield pa.record_batch([ids.take(at), pa.array([i for _, i in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["doc_id", "item_id", "n_hits"])

    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, item_id, n_hits): how often test strings of the item occur in the document."""
    return _passes(_texts(docs), benchmark, ngram, _occurrences_udf, "doc_id long, item_id long, n_hits long")


def _clean_udf(sent, ngram, at: int):
    def run(batches):
        m = _matcher(sent, ngram)
        for b in batches:
            keep = np.ones(len(b), bool)
            for lo, data, offs in slices(b.column(at).cast(pa.string())):
                for d, _ in m.count(data, offs):
                    keep[lo + d] = False
            yield b.filter(pa.array(keep))

    return run


def remove(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """Documents without a passage of the benchmark; columns stay as they are."""
    at = docs.columns.index("text")
    for items in _pieces(benchmark):
        sent = _send(docs, items)
        docs = docs.mapInArrow(_clean_udf(sent, ngram, at), docs.schema)
    return docs
