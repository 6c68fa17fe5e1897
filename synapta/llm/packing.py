"""Packing by concatenation and cutting: fixed windows of tokens over the whole corpus.

Documents are packed in the order of doc_id, so the windows don't depend on files, partitions or cores. Texts are
sorted by ranges of doc_id. Pass 1 encodes each document once (with an end-of-text token), writes the ids to the
checkpoint folder and sums them by partition. A prefix sum over the partitions' totals, and the
prefix sum inside each partition, give every document its global offset. Pass 2 cuts
fixed windows: those inside a partition are made where the documents lie, and only the
fragments of windows at a partition's two edges are shuffled and put together; they come from the rows that reach an edge.

A window carries boundary records: for each document in it, doc_id, the offset in
the document's tokens, the place in the window, and the length.

Cases: texts that are null or empty contribute the end-of-text token alone; a null doc_id
is kept in the records as null, and such rows come first; rows that share a doc_id are in the order of a hash of their text;
repeated rows are packed each time, and many of them are dealt to several partitions, for one can't be told from another.
Very long texts go over as many windows as they need. Other columns are ignored, whatever their names; the last window is shorter; an empty table gives no window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import checkpoint
from .tokens import EOS, RANKS, _texts, encoder, token_ids

WINDOW = 2048
_RECORDS = "docs array<struct<doc_id: bigint, doc_offset: bigint, start: int, length: int>>"
SCHEMA = f"window_id long, n_ids int, ids array<int>, {_RECORDS}"
_FRAGMENT = "window_id long, at long, doc_id long, doc_offset long, ids binary"
_KIND = pa.struct([("doc_id", pa.int64()), ("doc_offset", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])


def records(doc_ids: pa.Array, base: np.ndarray, size: np.ndarray, lo: int, hi: int, width: int):
    """Boundary records of the windows that cover tokens [lo, hi) of the stream.

    base and size are each document's global offset and length. Returns (records, how
    many each window has); windows are counted from lo // width.
    """
    a, b = np.maximum(base, lo), np.minimum(base + size, hi)
    some = np.flatnonzero(b > a)
    a, b = a[some], b[some]
    first, last = a // width, (b - 1) // width
    n = last - first + 1
    doc = np.repeat(np.arange(len(some)), n)
    window = np.repeat(first, n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.maximum(a[doc], window * width)
    end = np.minimum(b[doc], (window + 1) * width)
    rows = some[doc]
    out = pa.StructArray.from_arrays([doc_ids.take(pa.array(rows)), pa.array(at - base[rows]), pa.array((at - window * width).astype(np.int32)), pa.array((end - at).astype(np.int32))], fields=list(_KIND))
    return out, np.bincount(window - lo // width, minlength=(hi - 1) // width - lo // width + 1)


class Cutter:
    """Cuts a stream of documents into windows at multiples of ``width``.

    ``add`` returns runs of whole windows as (offset, ids, doc_ids, bases, sizes);
    documents of any length are held only as far as the window under way.
    """

    def __init__(self, width: int):
        self.width, self.at = width, None
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: pa.Array, base: np.ndarray, size: np.ndarray, ids: np.ndarray):
        if not len(size):
            return None
        if self.at is None:
            self.at = int(base[0])
        self.ids.append(ids)
        self.docs.append((doc_ids, base, size))
        return self.take(int(base[-1] + size[-1]) // self.width * self.width)

    def take(self, upto: int):
        """What lies before the offset ``upto``; later tokens stay."""
        if self.at is None or upto <= self.at:
            return None
        ids = np.concatenate(self.ids)
        doc_ids = pa.concat_arrays([d[0] for d in self.docs])
        base, size = (np.concatenate([d[k] for d in self.docs]) for k in (1, 2))
        lo, k = self.at, upto - self.at
        rest = base + size > upto
        self.ids, self.at = [ids[k:]], upto
        self.docs = [(doc_ids.filter(pa.array(rest)), base[rest], size[rest])]
        return lo, ids[:k], doc_ids, base, size


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _rows(cut, width: int) -> pa.RecordBatch:
    """Windows of a run of whole ones, or a shorter last one."""
    lo, ids, doc_ids, base, size = cut
    hi = lo + len(ids)
    docs, n = records(doc_ids, base, size, lo, hi, width)
    window = np.arange(lo // width, (hi - 1) // width + 1)
    length = np.minimum((window + 1) * width, hi) - window * width
    return pa.record_batch([pa.array(window), pa.array(length.astype(np.int32)), _lists(pa.array(ids.astype(np.int32)), length), _lists(docs, n)], names=["window_id", "n_ids", "ids", "docs"])


def _raw(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """All ids of a column of bytes, which are of 2 or 4 bytes each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, f"<u{len(raw) // max(1, int(n.sum()))}" if raw else "<u4")


def _cut_udf(width: int, make):
    def run(batches):
        cutter = Cutter(width)
        for b in batches:
            base, n = b.column("base").to_numpy() + b.column("before").to_numpy(), b.column("n").to_numpy()
            cut = cutter.add(b.column("doc_id"), base, n, _raw(b.column("ids"), n))
            if cut is None:
                continue
            lo, ids, doc_ids, base, size = cut
            first, hi = -(-lo // width) * width, lo + len(ids)  # what lies before is a fragment
            step = width * max(1, (1 << 19) // width)
            for p in range(first, hi, step):
                q = min(hi, p + step)
                near = slice(int(np.searchsorted(base + size, p, "right")), int(np.searchsorted(base, q)))
                yield make((p, ids[p - lo : q - lo], doc_ids[near], base[near], size[near]), width)

    return run


def _fragments_udf(width: int):
    """The tokens of each document that lie in a window which its partition shares with others."""

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("window_id", "at", "doc_id", "doc_offset", "ids")}
            for doc_id, base, total, before, n, raw in zip(b.column("doc_id").to_pylist(), *(b.column(k).to_numpy() for k in ("base", "total", "before", "n")), b.column("ids")):
                lo, hi, size = base + before, base + before + n, len(raw.as_buffer()) // n
                head = min(base + total, -(-base // width) * width)
                tail = max(head, (base + total) // width * width)
                for x, y in ((base, head), (tail, base + total)):
                    x, y = max(x, lo), min(y, hi)
                    if x < y:
                        for k, v in zip(rows, (x // width, x, doc_id, x - lo, raw.as_py()[(x - lo) * size : (y - lo) * size])):
                            rows[k].append(v)
            yield pa.record_batch([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=list(rows))

    return run


def _join_udf(width: int, make, id_bytes: int):
    """Put the fragments of one window together, in order."""

    def run(key, t):
        t = t.sort_by("at").combine_chunks()
        at, offset = t.column("at").to_numpy(), t.column("doc_offset").to_numpy()
        raw = t.column("ids").to_pylist()
        n = np.array([len(x) // id_bytes for x in raw])
        doc_ids = t.column("doc_id").combine_chunks()
        return pa.Table.from_batches([make((key[0].as_py() * width, np.frombuffer(b"".join(raw), f"<u{id_bytes}"), doc_ids, at - offset, offset + n), width)])

    return run


def cut(docs: DataFrame, width: int, make, schema: str, ranks: str, eos: int) -> DataFrame:
    """The stream of all documents in the order of doc_id, cut at multiples of ``width``; make turns runs of windows into rows."""
    texts = _texts(docs).withColumn("h", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, for adaptive execution would make few and large ones
    # equal rows, and they alone, may be split by the partition that they come from
    placed = texts.repartitionByRange(parts, "doc_id", "h", F.spark_partition_id()).sortWithinPartitions("doc_id", "h")
    tokens = checkpoint(token_ids(placed, ranks, eos))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "total", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))  # one row a partition
    placed = tokens.join(F.broadcast(bases), "part").select("base", "total", "before", "doc_id", "n", "ids")
    whole = placed.mapInArrow(_cut_udf(width, make), schema)
    near = placed.where((F.col("before") < F.pmod(-F.col("base"), F.lit(width))) | (F.col("before") + F.col("n") > F.col("total") - F.pmod(F.col("base") + F.col("total"), F.lit(width))))
    edges = near.mapInArrow(_fragments_udf(width), _FRAGMENT).groupBy("window_id")
    return whole.unionByName(edges.applyInArrow(_join_udf(width, make, encoder(ranks).id_bytes(eos)), schema))


def pack(docs: DataFrame, window: int = WINDOW, ranks: str = RANKS, eos: int = EOS) -> DataFrame:
    """(window_id, n_ids, ids, docs) with docs the boundary records."""
    return cut(docs, window, _rows, SCHEMA, ranks, eos)
