"""Suffix-array dedup by bucket-pointer refinement: passages that repeat across documents.

Suffixes start at words and are told apart by their first ``min_words`` words.

1. Initial buckets: the suffix at a word is in the bucket of its first q words (q is 8 for 50 words).
   Buckets are sorted, and a bucket with a single document is finished: the windows of ``min_words`` words
   that it stands for don't repeat and are dropped.
2. Each round refines the buckets of the windows that are left by the bucket at a later offset:
   q -> 2q -> 4q -> ... -> ``min_words``. What a round looks up are the refined identifiers that the
   last round left, never the text. The refined buckets are sorted again, and those with a single document
   go with their windows before the next round.
3. After the last round a bucket is a passage. Its first document learns that it
   is the first; documents learn which of their buckets are single; all others repeat.

Before the last round a window is stood for by the least of its identifiers (local minimisers), so that few
suffixes are sorted; wherever the window repeats, its least identifier does. Identifiers are 64-bit names of content, so they agree across partitions without
a renumbering, and results are exact up to 64-bit collisions.

A bucket is never gathered: sorting it means aggregating its least and greatest document, before
and after the shuffle, and its one message goes to its least document. A passage in a
third of all documents is one row a task. Texts cross the network once, then windows that are left once a round.

Cases: null or blank texts and texts under ``min_words`` words have no
passage. Very long texts are read whole, in slices. Ties go to the smallest doc_id, then the earliest word. Rows that share a
doc_id are one document, which doesn't repeat itself across documents: equal texts count once, and the spans of texts that
differ are listed together and cut each from its own. Rows with a
null doc_id are passed through by ``remove`` and never reported. Extra columns are ignored
by ``repeated_spans`` and kept by ``remove``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pair, slices, words

MIN_WORDS = 50
_STATE = "doc_id long, h long, starts array<int>, sizes array<int>, ids binary"
_CHUNK = 4_000_000


def rounds(min_words: int) -> list[int]:
    """Words by which buckets are told apart, round by round."""
    q = 1
    while q < 8 and q * 3 <= min_words:
        q *= 2
    sizes = [q]
    while sizes[-1] < min_words:
        sizes.append(min(2 * sizes[-1], min_words))
    return sizes if len(sizes) > 1 else sizes * 2  # passages of one word: nothing to refine


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Identifiers of the n-grams at every word, n a power of 2; the last n - 1 wrap and are invalid."""
    size, ids = 1, h
    while size < n:
        ids = pair(ids, np.roll(ids, -size))
        size *= 2
    return ids


def _slide(x: np.ndarray, w: int, f, forward: bool) -> np.ndarray:
    """Over w entries from each on (or up to each), their minimum or maximum."""
    pad, size = (np.uint64(2**64 - 1) if f is np.minimum else np.uint64(0)), 1
    while size < w:
        step = min(size, w - size)
        y = np.full_like(x, pad)
        if step < len(x):
            if forward:
                y[:-step] = x[step:]
            else:
                y[step:] = x[:-step]
        x = f(x, y)
        size += step
    return x


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Windows:
    """Sequences of q-gram identifiers around windows of min_words words: those that still may repeat.

    seq is each identifier's sequence; of each sequence, ``begin`` and ``end`` are its bounds among the identifiers,
    ``pos`` its first word and ``row`` its row of the batch.
    """

    def __init__(self, ids, q: int, min_words: int, seq, begin, end, pos, row):
        self.ids, self.q, self.min_words = ids, q, min_words
        self.seq, self.begin, self.end, self.pos, self.row = seq, begin, end, pos, row
        self.w = min_words - q + 1

    @staticmethod
    def of_texts(data, offs, q: int, min_words: int) -> Windows:
        _, _, doc, h = words(data, offs)
        n = len(offs) - 1
        first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        return Windows(_grams(h, q), q, min_words, doc, first[:-1], np.maximum(first[1:] - q + 1, first[:-1]), np.zeros(n, np.int64), np.arange(n))

    @staticmethod
    def of_states(b: pa.RecordBatch, q: int, min_words: int) -> Windows:
        starts, sizes = b.column("starts"), b.column("sizes").flatten().to_numpy()
        length = sizes + (min_words - q)
        begin = np.cumsum(length) - length
        ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint64)
        seq = np.repeat(np.arange(len(length)), length)
        return Windows(ids, q, min_words, seq, begin, begin + length, starts.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(b)), starts.value_lengths().to_numpy()))

    def least(self) -> np.ndarray:
        """For each place, the least of the w identifiers of the window that begins there; 0 where none does."""
        last, place = self.end[self.seq], np.arange(len(self.ids))
        least = _slide(np.where(place < last, self.ids, np.uint64(2**64 - 1)), self.w, np.minimum, True)
        least[place + self.w > last] = 0
        return least

    def sampled(self) -> np.ndarray:
        """Places whose buckets are sorted: in the last round all, before it those that are the least of a window."""
        if self.w == 1:
            return np.arange(len(self.ids))
        return np.flatnonzero((_slide(self.least(), self.w, np.maximum, False) == self.ids) & (np.arange(len(self.ids)) < self.end[self.seq]))

    def single(self, dead: np.ndarray, dead_row: np.ndarray, min_docs: int) -> np.ndarray:
        """Which windows can't repeat: their least identifier is of a bucket with a single document, or, with min_docs 1, a single place.

        Only the least will do: a window that repeats has it sampled wherever it is, and other identifiers perhaps not.
        """
        row, least = self.row[self.seq].astype(np.uint64), self.least()
        gone = _member(least, dead)
        at = np.flatnonzero(gone)
        name = pair(least[at], row[at])
        gone[at] = _member(name, pair(dead, dead_row.astype(np.uint64)))
        if min_docs < 2 and len(at):
            at = np.flatnonzero(_member(self.ids, dead))
            word = self.pos[self.seq[at]] + at - self.begin[self.seq[at]]
            places = np.unique(np.stack([pair(self.ids[at], row[at]), word.astype(np.uint64)]), axis=1)
            names, times = np.unique(places[0], return_counts=True)
            at = np.flatnonzero(gone)
            gone[at] = ~_member(pair(least[at], row[at]), names[times > 1])
        return gone

    def refined(self, gone: np.ndarray, q: int) -> Windows:
        """Without the windows that are gone, and refined to buckets of q words."""
        live = (np.arange(len(self.ids)) + self.w <= self.end[self.seq]) & ~gone
        step = q - self.q
        ids = pair(self.ids, np.roll(self.ids, -step)) if step else self.ids
        at = np.flatnonzero(live)
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (self.seq[at[1:]] != self.seq[at[:-1]])]) if len(at) else np.zeros(0, bool)
        first = at[new]
        length = np.diff(np.append(np.flatnonzero(new), len(at))) + (self.min_words - q)
        begin = np.cumsum(length) - length
        seq = np.repeat(np.arange(len(first)), length)
        old = self.seq[first]
        return Windows(ids[first[seq] + np.arange(len(seq)) - begin[seq]], q, self.min_words, seq, begin, begin + length, self.pos[old] + first - self.begin[old], self.row[old])

    def batch(self, doc_id: pa.Array, h: pa.Array) -> pa.RecordBatch:
        """One row for each row of the batch that has a window left."""
        some, runs = np.unique(self.row, return_counts=True)
        length = self.end - self.begin
        bounds = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(some)), runs), length, minlength=len(some)))]).astype(np.int64) * 8
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.ids))])
        k = pa.array(some)
        return pa.record_batch([doc_id.take(k), h.take(k), _lists(self.pos.astype(np.int32), runs), _lists((length - (self.min_words - self.q)).astype(np.int32), runs), ids.cast(pa.binary())], names=["doc_id", "h", "starts", "sizes", "ids"])

    def names(self, doc_id: pa.Array) -> pa.RecordBatch:
        at = self.sampled()
        return pa.record_batch([pa.array(self.ids[at].view(np.int64)), doc_id.take(pa.array(self.row[self.seq[at]]))], names=["bucket", "doc_id"])


def _chunks(b: pa.RecordBatch):
    """A batch of states in pieces of about _CHUNK bytes of identifiers."""
    size = np.cumsum(pc.binary_length(b.column("ids")).to_numpy())
    lo = 0
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _CHUNK, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers, row) of a column of lists."""
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def _name_texts_udf(q: int, min_words: int):
    def run(batches):
        for b in batches:
            for lo, data, offs in slices(b.column("text")):
                yield Windows.of_texts(data, offs, q, min_words).names(b.column("doc_id").slice(lo, len(offs) - 1))

    return run


def _first_round_udf(text: str, sizes: list[int], min_words: int, min_docs: int):
    def run(batches):
        for b in batches:
            for lo, data, offs in slices(b.column(text)):
                c = b.slice(lo, len(offs) - 1)
                t = Windows.of_texts(data, offs, sizes[0], min_words)
                yield t.refined(t.single(*_flat(c.column("dead")), min_docs), sizes[1]).batch(c.column("doc_id"), c.column("h"))

    return run


def _windows(c: pa.RecordBatch, sizes: list[int], min_words: int, min_docs: int) -> Windows:
    """Windows of states, refined round by round; dead0, dead1, ... are what the rounds found."""
    t = Windows.of_states(c, sizes[0], min_words)
    for k, q in enumerate(sizes[1:]):
        t = t.refined(t.single(*_flat(c.column(f"dead{k}")), min_docs), q)
    return t


def _name_udf(sizes: list[int], min_words: int, min_docs: int):
    def run(batches):
        for b in batches:
            for c in _chunks(b):
                yield _windows(c, sizes, min_words, min_docs).names(c.column("doc_id"))

    return run


def _buckets(named: DataFrame) -> DataFrame:
    """The sorted buckets: least and greatest document of each."""
    return named.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


def _named_documents(buckets: DataFrame, name: str) -> DataFrame:
    return buckets.where("lo = hi").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list("bucket").alias(name))


def _rounds(texts: DataFrame, text: str, sizes: list[int], min_words: int, min_docs: int) -> DataFrame:
    """Windows that the first round left, with what all later rounds found.

    texts: partitioned by doc_id, with the columns doc_id, h and, under any name, text. Columns dead0, dead1, ... are
    the buckets with a single document; of the last round, ``dead`` are those, and ``first`` the buckets whose first document it is.
    """
    some = texts.select("doc_id", F.col(text).alias("text")).where(F.length("text") >= 2 * min_words - 1)
    dead = _named_documents(_buckets(some.mapInArrow(_name_texts_udf(sizes[0], min_words), "bucket long, doc_id long")), "dead")
    parted = texts.repartition("doc_id")
    state = parted.join(dead, "doc_id", "left").mapInArrow(_first_round_udf(text, sizes[:2], min_words, min_docs), _STATE).repartition("doc_id")
    for k in range(len(sizes) - 1):
        buckets = _buckets(state.mapInArrow(_name_udf(sizes[1 : k + 2], min_words, min_docs), "bucket long, doc_id long"))
        if k < len(sizes) - 2:
            state = state.join(_named_documents(buckets, f"dead{k}"), "doc_id", "left")
    single = F.col("lo") == F.col("hi")
    told = buckets.groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.when(single, F.col("bucket"))).alias("dead"), F.collect_list(F.when(~single, F.col("bucket"))).alias("first"))
    return state.join(told, "doc_id", "left")


def _places(c: pa.RecordBatch, sizes: list[int], min_words: int, min_docs: int):
    """(row, first word, is it the first of its bucket) of each window that repeats, in order."""
    t = _windows(c, sizes, min_words, min_docs)
    gone = t.single(*_flat(c.column("dead")), min_docs)
    row, pos = t.row[t.seq], t.pos[t.seq] + np.arange(len(t.ids)) - t.begin[t.seq]
    ids, of = _flat(c.column("first"))
    name = pair(t.ids, row.astype(np.uint64))
    mine = pair(ids, of.astype(np.uint64))
    if min_docs < 2:  # buckets of one document have their first place in it, too
        ids, of = _flat(c.column("dead"))
        mine = np.concatenate([mine, pair(ids, of.astype(np.uint64))])
    kept = np.zeros(len(name), bool)
    at = np.flatnonzero(_member(name, mine))
    kept[at[np.unique(name[at], return_index=True)[1]]] = True
    live = np.flatnonzero(~gone)
    return row[live], pos[live], kept[live]


def _unite(row: np.ndarray, pos: np.ndarray, min_words: int) -> np.ndarray:
    """Where runs of windows that touch or overlap begin."""
    if not len(pos):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + min_words)]))


def _spans_udf(sizes: list[int], min_words: int, min_docs: int):
    def run(batches):
        for b in batches:
            for c in _chunks(b):
                row, pos, kept = _places(c, sizes, min_words, min_docs)
                first = _unite(row, pos, min_words)
                if not len(first):
                    continue
                # words that only a later copy covers: the gain of each later copy over the later copy before it
                gain = np.zeros(len(pos), np.int64)
                later = np.flatnonzero(~kept)
                r, p = row[later], pos[later]
                gain[later] = np.concatenate([[min_words], np.where(r[1:] == r[:-1], np.minimum(p[1:] - p[:-1], min_words), min_words)]) if len(later) else 0
                last = np.append(first[1:], len(pos)) - 1
                cols = [pa.array(pos[first].astype(np.int32)), pa.array((pos[last] + min_words).astype(np.int32)), pa.array(np.add.reduceat(gain, first).astype(np.int32))]
                yield pa.record_batch([c.column("doc_id").take(pa.array(row[first])), *cols], names=["doc_id", "start_word", "end_word", "n_removed"])

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_docs: int = 2) -> DataFrame:
    """Every maximal run of words covered by passages of ``min_words`` words that repeat.

    Returns (doc_id, start_word, end_word, n_removed): words [start, end) of the
    document; n_removed of them lie in passages whose first place is elsewhere.
    min_docs 2 (default) wants passages of two documents; 1 also counts repeats
    within one document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    sizes = rounds(min_words)
    found = _rounds(texts, "text", sizes, min_words, min_docs).mapInArrow(_spans_udf(sizes[1:], min_words, min_docs), "doc_id long, start_word int, end_word int, n_removed int")
    return found.distinct()  # rows that are there twice


def _cuts_udf(sizes: list[int], min_words: int, min_docs: int):
    def run(batches):
        for b in batches:
            for c in _chunks(b):
                row, pos, kept = _places(c, sizes, min_words, min_docs)
                row, pos = row[~kept], pos[~kept]
                first = _unite(row, pos, min_words)
                if not len(first):
                    continue
                some, runs = np.unique(row[first], return_counts=True)
                last, k = np.append(first[1:], len(pos)) - 1, pa.array(some)
                yield pa.record_batch([c.column("doc_id").take(k), c.column("h").take(k), _lists(pos[first].astype(np.int32), runs), _lists((pos[last] + min_words).astype(np.int32), runs)], names=["doc_id", "h", "cut_from", "cut_to"])

    return run


def _cut_udf(columns: list[str], at: int):
    def run(batches):
        for b in batches:
            out, texts = [], b.column(at)
            for text, a, z in zip(texts, b.column("cut_from").to_pylist(), b.column("cut_to").to_pylist()):
                raw = text.as_py().encode()
                starts, _, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                edges = np.append(starts, len(raw))
                parts, done = [], 0
                for x, y in zip(a, z):
                    parts.append(raw[done : edges[x]])
                    done = edges[y]
                out.append(b"".join([*parts, raw[done:]]).decode())
            cols = [pa.array(out, texts.type) if j == at else b.column(j) for j in range(len(columns))]
            yield pa.record_batch(cols, names=columns)

    return run


def remove(docs: DataFrame, min_words: int = MIN_WORDS, min_docs: int = 2) -> DataFrame:
    """Cut repeated passages from all documents but the first; same columns, n_chars brought up to date.

    Documents with nothing left but white space are dropped; documents that had no
    word before stay as they were.
    """
    names, at, key = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text"), docs.columns.index("doc_id")
    plain = docs.toDF(*names)  # so that no column of the caller's meets one of ours
    bare = plain.where(F.col(f"c{key}").isNull())  # not sent to the joins, where they would be one key
    texts = plain.where(F.col(f"c{key}").isNotNull()).select(*names, F.col(f"c{key}").cast("long").alias("doc_id"), F.xxhash64(F.col(f"c{at}").cast("string")).alias("h"))
    sizes = rounds(min_words)
    cuts = _rounds(texts, f"c{at}", sizes, min_words, min_docs).mapInArrow(_cuts_udf(sizes[1:], min_words, min_docs), "doc_id long, h long, cut_from array<int>, cut_to array<int>")
    cuts = cuts.groupBy("doc_id").agg(F.collect_set(F.struct("h", "cut_from", "cut_to")).alias("cuts"))  # one for each text of the document
    mine = F.get(F.filter("cuts", lambda x: x["h"] == F.col("h")), F.lit(0))
    joined = texts.repartition("doc_id").join(cuts, "doc_id", "left").select(*names, mine.alias("cut"))  # the texts that the first round sent
    same = joined.where("cut is null").select(*names)
    cut = joined.where("cut is not null").select(*names, "cut.cut_from", "cut.cut_to")
    cut = cut.mapInArrow(_cut_udf(names, at), plain.schema).where(F.col(f"c{at}").rlike(r"\S"))  # only these go through Python
    if "n_chars" in docs.columns:
        k = docs.columns.index("n_chars")
        cut = cut.withColumn(f"c{k}", F.length(f"c{at}").cast(docs.schema[k].dataType))
    return same.unionByName(cut.select(*names)).unionByName(bare).toDF(*docs.columns)
