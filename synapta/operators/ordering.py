"""A total order over a whole table, and what is folded along it, without bringing the rows to one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import checkpointed

_AT = "__at"


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows by ranges of the order, each range sorted; ``__at`` rises along it and has the range in its upper bits."""
    return checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id()))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add each row's place, from 1, in the order: a sort by ranges, and a prefix sum over the ranges' sizes."""
    s = _sorted(df, order).withColumn("__part", F.shiftright(_AT, 33))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))  # one row a range
    at = F.col(_AT) - F.shiftleft(F.col("__part"), 33)
    return s.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + at + 1).drop(_AT, "__part", "__before")


class _Steps:
    """Next-fit over one range: where the batch that begins at each row ends, and what is open after the last row."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.limit, n = limit, len(sizes)
        self.sum = np.concatenate([[0], np.cumsum(sizes)])
        start = np.arange(n)
        # the first row that doesn't fit; a batch without tokens takes any row
        end = np.searchsorted(self.sum[1:], self.sum[:-1] + limit, "right")
        end = np.maximum(end, start + 1)
        none = (end < n) & (self.sum[np.minimum(end, n)] == self.sum[:-1])
        end[none] += 1
        self.end = np.minimum(end, n)
        self.last, self.count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            e = self.end[i]
            self.last[i], self.count[i] = (i, 1) if e >= n else (self.last[e], self.count[e] + 1)

    def first_break(self, used: int) -> int:
        """The row before which a batch closes that has ``used`` tokens at the start."""
        return int(self.end[0]) if used == 0 and len(self.end) else int(np.searchsorted(self.sum[1:], self.limit - used, "right"))

    def through(self, used: int) -> tuple[int, int]:
        """(tokens of the open batch after the last row, batches closed)."""
        n, b = len(self.end), self.first_break(used)
        if b >= n:
            return int(used + self.sum[n]), 0
        return int(self.sum[n] - self.sum[self.last[b]]), int(self.count[b])

    def numbers(self, used: int, batch: int) -> np.ndarray:
        """The batch of each row."""
        out, at, b = np.empty(len(self.end), np.int64), 0, self.first_break(used)
        while at < len(out):
            out[at:b] = batch
            at, batch = b, batch + 1
            if b < len(out):
                b = int(self.end[b])
        return out


def next_fit(df: DataFrame, order: list[Column], size: Column, limit: int, name: str = "batch") -> DataFrame:
    """Add the number, from 0, of each row's batch along the order: a batch closes when the next row would exceed the limit.

    Each range says what comes out of it for every state in which it may be entered (the tokens of the open batch, up to the
    limit or a single larger row's); the driver chains a row a range, and the ranges number their rows.
    """
    s = _sorted(df.withColumn("__size", size.cast("long")), order)

    def transitions(batches):
        sizes, part = [], None
        for b in batches:
            if len(b):
                part = b.column(0)[0].as_py() >> 33
                sizes.append(b.column(1).to_numpy())
        if part is not None:
            sizes = np.concatenate(sizes)
            steps = _Steps(sizes, limit)
            # a batch that is over the limit, of one large row, counts as limit + 1; runs of states with the same outcome are one entry
            out = [steps.through(u) for u in range(limit + 2)]
            out = [(u, n - (0 if c else u), c) for u, (n, c) in enumerate(out)]
            entry = [x for k, x in enumerate(out) if not k or x[1:] != out[k - 1][1:]]
            yield pa.record_batch([pa.array([part]), *[pa.array([[x[c] for x in entry]], pa.list_(pa.int64())) for c in range(3)]], names=["part", "entry", "used", "closed"])

    ranges = s.select(_AT, "__size").mapInArrow(transitions, "part long, entry array<long>, used array<long>, closed array<long>").orderBy("part").collect()  # a row a range
    state, used, batch = {}, 0, 0
    for r in ranges:
        state[r["part"]] = (used, batch)
        k = int(np.searchsorted(r["entry"], min(used, limit + 1), "right")) - 1
        used, batch = r["used"][k] + (0 if r["closed"][k] else used), batch + r["closed"][k]
    columns = df.columns
    schema = T.StructType([*s.select(*columns).schema.fields, T.StructField(name, T.LongType())])

    def number(batches):
        held = [b for b in batches if len(b)]
        if held:
            used, batch = state[held[0].column(_AT)[0].as_py() >> 33]
            n = _Steps(np.concatenate([b.column("__size").to_numpy() for b in held]), limit).numbers(min(used, limit + 1), batch)
            lo = 0
            for b in held:
                yield pa.record_batch([*[b.column(c) for c in columns], pa.array(n[lo : lo + len(b)])], names=[*columns, name])
                lo += len(b)

    return s.mapInArrow(number, schema)
