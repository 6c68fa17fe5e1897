"""SimHash near-dedup by anchor points of a covering code.

A fingerprint is two 64-bit SimHashes: of words, each weighted by its count to the
power 0.6, and of word pairs. Documents are near duplicates when the first differ in
at most ``WORD_BITS`` bits, the second in at most ``PAIR_BITS``, and the shorter one has
at least ``LENGTH_RATIO`` of the other's words. Groups are the connected components.

README has the recall of these thresholds by Jaccard of 3-word shingles. Search is exact
within them. The first SimHash is cut into blocks, each with a radius r of its own; the
radii and one more for each block add up to WORD_BITS + 1, so near fingerprints agree up to
r bits in some block. The anchors of a block are the words of a
perfect Hamming code (on its low 2**k - 1 bits; the rest are free), whose covering
radius R is 1. Each fingerprint is replicated to every anchor within R + r, and is at home
at its nearest one: a near fingerprint's replicas must reach that home, so fingerprints
are compared per anchor, homes against replicas. An anchor is split by bands of length, of which
near documents are in one or in neighbours: homes stay in theirs, replicas go to theirs and the one below.
More blocks mean fewer replicas but more comparisons, so their number follows from the number
of distinct fingerprints (``blocks_for``).

Equal fingerprints are one node, so thousands of copies are one. Of an anchor only the homes are
held, about one row in 17, and replicas pass by them batch by batch; pairs are folded into a forest as they
are found, so memory grows neither with an anchor's replicas nor with the square of near copies that all differ. Whatever is counted by fingerprint, node or group is aggregated
before the shuffle and joined back, never gathered in a window, so that a hot one is split by
adaptive execution.

Cases: texts that are null or have no word have no fingerprint and are in no group.
Rows with a null doc_id are in no group and always stay. Rows that share a doc_id
are one document: they stay or go together, and each of their texts counts. Ties
go to the smallest doc_id. Very long texts are fingerprinted whole, in tiles. Other columns are ignored by ``groups`` and kept by ``remove``.
Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpoint, counted, discard, pair, slices, stored_at, words

WORD_BITS = 11
PAIR_BITS = 14
LENGTH_RATIO = 0.7
_POWER = 0.6
_TILE = 1 << 15
#: Pairs compared at once, few enough for a core's cache, and edges held at least before they are made a forest.
_PAIRS = 1 << 17
_LINKS = 1 << 16
#: Replicas that one task makes, about 130 MB while they are sorted for the shuffle.
_REPLICAS = 2_000_000


def _signs(doc: np.ndarray, h: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """The SimHash of each of n documents; doc is sorted."""
    total = np.zeros((n, 64), np.float32)
    for lo in range(0, len(h), _TILE):
        d = doc[lo : lo + _TILE]
        bits = np.unpackbits(np.ascontiguousarray(h[lo : lo + _TILE]).view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        if weight is None:
            up = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            every = np.diff(np.append(first, len(d)))
        else:
            w = weight[lo : lo + _TILE]
            up = np.add.reduceat(bits * w[:, None], first, axis=0)
            every = np.add.reduceat(w, first)
        total[d[first]] += 2 * up - every[:, None]
    return np.packbits(total > 0, axis=1).view(np.uint64)[:, 0]


def fingerprints_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SimHash of words, of word pairs, number of words) of each document."""
    n = len(offs) - 1
    _, _, doc, h = words(data, offs, normal=True)
    count = np.bincount(doc, minlength=n)
    d, x, tf = counted(doc, h)
    one = _signs(d, x, (tf**_POWER).astype(np.float32), n)
    both = doc[1:] == doc[:-1]
    two = _signs(doc[1:][both], pair(h[:-1][both], h[1:][both]), None, n)
    return one, two, count


def _fingerprint_udf(batches):
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lo, data, offs in slices(b.column(1)):
            one, two, count = fingerprints_of(data, offs)
            k = np.flatnonzero(count)
            yield pa.record_batch([pa.array(ids[lo + k]), pa.array(one[k].view(np.int64)), pa.array(two[k].view(np.int64)), pa.array(count[k].astype(np.int32))], names=["doc_id", "fp", "fp2", "n_words"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, fp2, n_words) of every document that has a word."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_fingerprint_udf, "doc_id long, fp long, fp2 long, n_words int")


class Anchors:
    """Homes and replicas in a block of ``width`` bits, for differences of up to r bits there."""

    def __init__(self, width: int, r: int):
        k = (width + 1).bit_length() - 1
        self.length = (1 << k) - 1
        patterns = [sum(1 << i for i in c) for e in range(r + 2) for c in combinations(range(width), e)]
        patterns = np.array(patterns, np.uint64)
        s = self.syndrome(patterns)
        self.by = [patterns[s == v] for v in range(1 << k)]
        self.leader = np.array([p[np.argmin(np.bitwise_count(p))] for p in self.by], np.uint64)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for i in range(self.length):
            s ^= ((x >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        return s

    def home(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.leader[self.syndrome(x)]

    def replicas(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, anchor) of every anchor within R + r of every x."""
        s, at, anchor = self.syndrome(x), [], []
        for v, p in enumerate(self.by):
            k = np.flatnonzero(s == v)
            at.append(np.repeat(k, len(p)))
            anchor.append((x[k][:, None] ^ p).ravel())
        return np.concatenate(at), np.concatenate(anchor)


#: By number of blocks: replicas of a fingerprint in one band, and the share of all pairs that are compared if there is one band.
_COSTS = {6: (48, 0.24), 4: (174, 4.3e-2), 3: (1516, 9.4e-3)}


def blocks_for(n: int) -> int:
    """Blocks for n distinct fingerprints: where a replica costs about as much as 3,000 comparisons and lengths spread over 5 bands."""
    return min(_COSTS, key=lambda b: 2 * _COSTS[b][0] * 3000 + _COSTS[b][1] * n / 5)


def _cuts(blocks: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each block."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    radii = [(WORD_BITS + 1 - blocks + i) // blocks for i in range(blocks)]
    return list(zip(edges, np.diff(edges).tolist(), radii))


def bands(n_words: np.ndarray) -> np.ndarray:
    """Bands of length: documents within LENGTH_RATIO of each other are in one or in neighbours."""
    return np.floor(np.log(np.maximum(n_words, 1)) / (1.0001 * -np.log(LENGTH_RATIO))).astype(np.int64)


def _replicate_udf(blocks: int):
    def run(batches):
        made: dict[tuple[int, int], Anchors] = {}
        step = 4096 if blocks > 3 else 256
        for b in batches:
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                fp, band = part.column("fp").to_numpy().view(np.uint64), bands(part.column("n_words").to_numpy())
                for j, (low, width, r) in enumerate(_cuts(blocks)):
                    x = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    if (width, r) not in made:
                        made[width, r] = Anchors(width, r)
                    a = made[width, r]
                    near, anchor = a.replicas(x)
                    # homes, then replicas in their band and the one below
                    at = np.concatenate([np.arange(len(x)), near, near])
                    anchor = np.concatenate([a.home(x), anchor, anchor]).astype(np.int64)
                    where = np.concatenate([band, band[near], band[near] - 1]) + 1
                    home = np.zeros(len(at), bool)
                    home[: len(x)] = True
                    rows = part.take(pa.array(at))
                    key = anchor | where << np.int64(32) | np.int64(j) << np.int64(40)
                    yield pa.record_batch([pa.array(key << np.int64(1) | ~home), *rows.columns], names=["at", *rows.schema.names])

    return run


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n members' component, under the edges a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near(homes: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...]):
    """Yield (home node, other node) of pairs that are near duplicates, by tiles; homes and rows are (node, fp, fp2, n_words)."""
    node, fp, fp2, n_words = rows
    step = max(1, _PAIRS // len(fp))
    for lo in range(0, len(homes[0]), step):
        h_node, h_fp, h_fp2, h_words = (x[lo : lo + step] for x in homes)
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(h_fp[:, None] ^ fp) <= WORD_BITS), len(fp))
        if not len(i):
            continue
        small, large = np.minimum(h_words[i], n_words[j]), np.maximum(h_words[i], n_words[j])
        ok = (np.bitwise_count(h_fp2[i] ^ fp2[j]) <= PAIR_BITS) & (small >= LENGTH_RATIO * large) & (h_node[i] != node[j])
        if ok.any():
            yield h_node[i[ok]], node[j[ok]]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least one of its component."""
    ids, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = components(places[: len(u)], places[len(u) :], len(ids))
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


class _Links:
    """Edges found so far, made a forest again whenever they are many more than its own."""

    def __init__(self):
        self.found, self.n, self.most = [], 0, _LINKS

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.found.append((u, v))
        self.n += len(u)
        if self.n > self.most:
            self.fold()

    def fold(self) -> None:
        self.found = [_forest(*(np.concatenate(x) for x in zip(*self.found)))]
        self.n = len(self.found[0][0])
        self.most = 2 * self.n + _LINKS

    def taken(self) -> pa.RecordBatch:
        self.fold()
        (u, v), = self.found
        self.__init__()
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _compare_udf(batches):
    """Edges between near nodes; rows come sorted by anchor, its homes first: they are held, and replicas pass by them."""
    links, last, homes = _Links(), None, []
    for b in batches:
        if not len(b):
            continue
        at = b.column("at").to_numpy()
        columns = (b.column("node").to_numpy(), *(b.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")), b.column("n_words").to_numpy())
        # runs of homes or of replicas of one anchor
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        for lo, hi, what in zip(edges[:-1].tolist(), edges[1:].tolist(), at[edges[:-1]].tolist()):
            if what >> 1 != last:
                last, homes = what >> 1, []
                if links.n > _LINKS:
                    yield links.taken()
            rows = tuple(c[lo:hi] for c in columns)
            if not what & 1:
                homes.append(rows)
            elif homes:
                if len(homes) > 1:
                    homes = [tuple(np.concatenate(x) for x in zip(*homes))]
                for u, v in _near(homes[0], rows):
                    links.add(u, v)
    if links.n:
        yield links.taken()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connect(edges: DataFrame) -> DataFrame:
    """(u, v): each node u that isn't the least of its component, and that least node v.

    Alternates the large star and the small star until nothing changes; the
    edges are written to the checkpoint folder after each turn, and those of the turn before deleted.
    """
    (edges, path), spark = stored_at(edges.distinct(), "edges"), edges.sparkSession
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        edges, path = stored_at(least.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), "edges")
        discard(spark, before)
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges


def _at_anchors(nodes: DataFrame, blocks: int | None) -> DataFrame:
    """Homes and replicas of all nodes, by as many tasks as keep each to _REPLICAS: nodes are a few narrow partitions, whose replicas would fill the executors."""
    n = nodes.count()
    blocks = blocks or blocks_for(n)
    each = 2 * min(cost for b, (cost, _) in _COSTS.items() if b <= blocks)
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, min(-(-n * each // _REPLICAS), 10_000))
    spread = nodes.select("node", "fp", "fp2", "n_words").repartition(tasks, "node")
    return spread.mapInArrow(_replicate_udf(blocks), "at long, node long, fp long, fp2 long, n_words int")


def _grouped(docs: DataFrame, blocks: int | None) -> DataFrame:
    """(doc_id, node, root) of every document whose node is in a component of two or more, or stands for two or more documents."""
    prints = checkpoint(fingerprints(docs))
    key = ["fp", "fp2", "n_words"]
    nodes = checkpoint(prints.groupBy(*key).agg(F.min("doc_id").alias("node")))
    parted = _at_anchors(nodes, blocks).repartition(F.shiftright("at", 1)).sortWithinPartitions("at")
    edges = parted.mapInArrow(_compare_udf, "u long, v long")
    members = prints.join(nodes, key).select("doc_id", "node")
    # texts of one doc_id hang together too
    several = members.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("m")).where("v != m").select("doc_id", "v")
    same = members.join(several, "doc_id").where("node != v").select(F.col("node").alias("u"), "v")
    roots = connect(edges.unionByName(same))
    named = members.join(roots, members["node"] == roots["u"], "left").select("doc_id", F.coalesce("v", "node").alias("group_id"))
    return named.distinct()


def groups(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, group_id, n_docs) of every document in a group of two or more; group_id is the least doc_id."""
    named = _grouped(docs, blocks)
    sizes = named.groupBy("group_id").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    return named.join(sizes, "group_id").select("doc_id", "group_id", "n_docs")


def remove(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Keep the first document of each group and all that are in none; columns stay as they are."""
    gone = _grouped(docs, blocks).where("doc_id != group_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
