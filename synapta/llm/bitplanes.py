"""Token ids as bit planes or byte planes, compressed with zstandard, with an index.

The ids of all documents in the order of doc_id, each ended by an end-of-text token, form one stream
that is cut into blocks of ``BLOCK`` ids, as in packing: blocks don't depend on files, partitions or cores. A block is transposed: plane k holds bit k
(or byte k) of every id, so that planes with little entropy shrink to almost nothing. Each plane
is a zstandard frame of its own; ``offsets`` is the chunk index (plane k lies at
offsets[k] to offsets[k + 1] of ``data``), so one plane can be read without the others.
``docs`` lists the documents of a block: doc_id, offset in the document's tokens, place
in the block, length. Blocks are made where the documents lie; only those at the edges of partitions are put together from fragments.

Cases: null and empty texts are an end-of-text token alone; a null doc_id stays null and comes first;
rows that repeat are stored each time; very long texts go over as many blocks as they need; other columns are ignored, whatever their names; an empty table gives no
block. Reading gives back exactly the ids that were written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .packing import _RECORDS, _lists, cut, records
from .tokens import EOS, RANKS

BLOCK = 1 << 16
LEVEL = 3
SCHEMA = f"block long, n_ids int, planes string, offsets array<int>, data binary, {_RECORDS}"


def split(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of ids, the lowest first; as many as the largest id needs."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = max(1, int(ids.max(initial=0)).bit_length())
    raw = ids.view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(-(-top // 8))]
    each = np.unpackbits(raw[:, : -(-top // 8)], axis=1, bitorder="little")
    return [np.packbits(each[:, k]).tobytes() for k in range(top)]


def join(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids that ``split`` took apart."""
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        plane = np.frombuffer(p, np.uint8)
        if bits:
            out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
        else:
            out |= plane.astype(np.uint32) << np.uint32(8 * k)
    return out


def _make(bits: bool, level: int):
    def make(cut, block: int) -> pa.RecordBatch:
        lo, ids, doc_ids, base, size = cut
        hi, packer = lo + len(ids), zstandard.ZstdCompressor(level=level)
        frames = [[packer.compress(x) for x in split(ids[p - lo : min(hi, p + block) - lo], bits)] for p in range(lo, hi, block)]
        offsets = [np.concatenate([[0], np.cumsum([len(f) for f in fs])]).astype(np.int32) for fs in frames]
        docs, n = records(doc_ids, base, size, lo, hi, block)
        number = np.arange(lo // block, (hi - 1) // block + 1)
        length = np.minimum((number + 1) * block, hi) - number * block
        cols = [pa.array(number), pa.array(length.astype(np.int32)), pa.array(["bit" if bits else "byte"] * len(number)), _lists(pa.array(np.concatenate(offsets)), np.array([len(o) for o in offsets])), pa.array([b"".join(fs) for fs in frames]), _lists(docs, n)]
        return pa.record_batch(cols, names=["block", "n_ids", "planes", "offsets", "data", "docs"])

    return make


def write_blocks(docs: DataFrame, block: int = BLOCK, bits: bool = False, level: int = LEVEL, ranks: str = RANKS, eos: int = EOS) -> DataFrame:
    """(block, n_ids, planes, offsets, data, docs) of every block."""
    return cut(docs, block, _make(bits, level), SCHEMA, ranks, eos)


def block_ids(n_ids: int, planes: str, offsets, data: bytes) -> np.ndarray:
    """The ids of one block."""
    d = zstandard.ZstdDecompressor()
    return join([d.decompress(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], n_ids, planes == "bit")


def read_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, start, doc_offset, ids): the pieces of documents in each block, decoded."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = block_ids(r["n_ids"], r["planes"], r["offsets"], r["data"]).astype(np.int32)
                docs = r["docs"]
                n = np.array([d["length"] for d in docs])
                cols = [pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array([r["block"]] * len(docs), pa.int64()), pa.array([d["start"] for d in docs], pa.int32()), pa.array([d["doc_offset"] for d in docs], pa.int64()), _lists(pa.array(ids), n)]
                yield pa.record_batch(cols, names=["doc_id", "block", "start", "doc_offset", "ids"])

    return blocks.mapInArrow(run, "doc_id long, block long, start int, doc_offset long, ids array<int>")
