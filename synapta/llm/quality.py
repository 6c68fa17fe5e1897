"""Quality classifier on document statistics: random Fourier features, ridge, isotonic calibration.

1. Statistics of every document (lengths, shares of kinds of bytes, repetition of words, word
   pairs and lines) come from one pass over the texts and are written to the checkpoint folder.
2. Standardised on the labelled documents, they are mapped to ``FEATURES`` random cosines,
   whose dot products approximate a Gaussian kernel.
3. Each partition sums its part of the normal equations over all its labelled documents, apart for each of ``FOLDS`` folds
   by a hash of doc_id; Spark adds the parts up and the driver solves systems of fixed size for the ridge scores: one of
   all folds, and for each fold one of the others.
4. Labelled documents are scored by the weights of the other folds and counted in ``BINS`` bins, and pooling adjacent violators
   makes the share of good documents a rising function of the score: the calibration, on documents held out.

Nothing is sampled. Cases: texts that are null or have no word are judged by their
statistics, which are zeros; very long texts are read whole, in slices; a null doc_id stays null; label rows with a null doc_id
or label, or without a document, are ignored; contradicting labels count by their mean; without labels the
probability is null and every document is kept; ties of scores get the same probability. Rows that repeat are judged each, and weigh
as often as they are there. An empty table gives no rows. Other columns, whatever their names, are
ignored by ``quality`` and kept by ``remove``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpoint, counted, long_ids, pair, slices, words
from .tokens import _texts

FEATURES = 128
BINS = 1000
RIDGE = 1.0
KEEP = 0.5
SEED = 17
FOLDS = 5
STATS = ["log_words", "word_bytes", "digits", "upper", "symbols", "space", "high", "distinct", "top_word", "short", "long", "lines", "repeated_lines", "word_sentences", "distinct_pairs", "ends", "log_longest", "top_pair"]
_KINDS = np.zeros((256, 6), bool)
for _b in range(256):
    _c = chr(_b) if _b < 128 else ""
    _KINDS[_b] = [_c.isdigit(), _c.isupper(), bool(_c) and not _c.isalnum() and not _c.isspace() and _c not in ".,;:!?'\"-", _c.isspace(), _b >= 128, _c in tuple(".!?")]


def _share(a, b):
    return a / np.maximum(b, 1)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATS for each document."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, len(STATS)))
    if not len(data):
        return out
    kind = [np.diff(np.concatenate([[0], np.cumsum(_KINDS[:, k][data])])[offs]) for k in range(6)]
    starts, ends, doc, h = words(data, offs)
    count = np.bincount(doc, minlength=n)
    length = ends - starts

    def repetition(d, x):
        one, _, times = counted(d, x)
        top = np.zeros(n)
        np.maximum.at(top, one, times)
        every = np.bincount(d, minlength=n)
        return np.where(every > 0, _share(np.bincount(one, minlength=n), every), 0), _share(top, every)

    same = doc[1:] == doc[:-1]
    distinct, top = repetition(doc, h)
    distinct_pairs, top_pair = repetition(doc[1:][same], pair(h[:-1][same], h[1:][same]))
    # lines are the words between line feeds, by the sum of their words' hashes
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    new = np.concatenate([[True], (line[1:] != line[:-1]) | ~same]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    line_doc = doc[first]
    lines, _ = repetition(line_doc, np.add.reduceat(h, first) if len(first) else h)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    n_lines = np.bincount(line_doc, minlength=n)
    columns = [
        np.log1p(count), _share(np.bincount(doc, length, minlength=n), count), _share(kind[0], size), _share(kind[1], size), _share(kind[2], size), _share(kind[3], size), _share(kind[4], size), distinct, top,
        _share(np.bincount(doc, length <= 3, minlength=n), count), _share(np.bincount(doc, length > 20, minlength=n), count), _share(n_lines, count), np.where(n_lines > 0, 1 - lines, 0), _share(kind[5], count), distinct_pairs, _share(kind[5], n_lines), np.log1p(longest), top_pair,
    ]
    return np.stack(columns, 1)


def _statistics_udf(batches):
    for b in batches:
        ids = long_ids(b.column(0))
        for lo, data, offs in slices(b.column(1)):
            n = len(offs) - 1
            x = statistics(data, offs)
            at = pa.array(np.arange(0, (n + 1) * len(STATS), len(STATS), dtype=np.int32))
            yield pa.record_batch([ids.slice(lo, n), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "stats"])


class Cosines:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), n)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, n)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        f = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.concatenate([np.ones((len(x), 1)), f], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATS))


def _equations_udf(cosines: Cosines):
    def run(batches):
        k = len(cosines.b) + 1
        total = np.zeros((FOLDS, k, k + 1))
        for b in batches:
            if len(b):
                f, fold = cosines.of(_matrix(b.column(0))), b.column(2).to_numpy()
                fy = np.concatenate([f, b.column(1).to_numpy()[:, None]], 1)
                for j in range(FOLDS):
                    total[j] += f[fold == j].T @ fy[fold == j]
        i, j = np.nonzero(np.arange(k)[:, None] <= np.arange(k + 1))
        for fold in range(FOLDS):
            yield pa.record_batch([pa.array(np.full(len(i), fold, np.int32)), pa.array((i * (k + 1) + j).astype(np.int32)), pa.array(total[fold, i, j])], names=["fold", "cell", "value"])

    return run


def solve(cells: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Ridge weights from the summed upper triangle and right-hand side."""
    m = np.zeros((k, k + 1))
    m.ravel()[cells] = values
    a = np.triu(m[:, :k]) + np.triu(m[:, :k], 1).T
    penalty = np.full(k, RIDGE)
    penalty[0] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), m[:, k])


def isotonic(count: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The rising shares that fit the bins best; a bin without documents takes its pool's, or the one before."""
    pools: list[list[float]] = []
    for n, g in zip(count.tolist(), good.tolist()):
        pools.append([n, g, 1])
        while len(pools) > 1 and pools[-2][1] * max(pools[-1][0], 1e-12) >= pools[-1][1] * max(pools[-2][0], 1e-12):
            n, g, k = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + g, pools[-1][2] + k]
    return np.concatenate([[g / n if n else 0.0] * k for n, g, k in pools])


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def _bins_udf(cosines: Cosines, without: np.ndarray):
    """without: for each fold the weights of the others."""

    def run(batches):
        count, good = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            if len(b):
                at = _bin((cosines.of(_matrix(b.column(0))) * without[b.column(2).to_numpy()]).sum(1))
                count += np.bincount(at, minlength=BINS)
                good += np.bincount(at, b.column(1).to_numpy(), minlength=BINS)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(good[some])], names=["bin", "n", "good"])

    return run


def _judged(x: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """(score, probability) by statistics."""
    cosines, weights, curve = model
    score = cosines.of(x) @ weights
    return score, curve[_bin(score)]


def _judge_udf(model):
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            if model is None:
                score = prob = pa.nulls(len(b), pa.float64())
                keep = np.ones(len(b), np.int32)
            else:
                s, p = _judged(_matrix(b.column(1)), model)
                score, prob, keep = pa.array(np.round(s, 6)), pa.array(np.round(p, 6)), (p >= KEEP).astype(np.int32)
            yield pa.record_batch([b.column(0), score, prob, pa.array(keep)], names=["doc_id", "score", "probability", "keep"])

    return run


def _model(stats: DataFrame, labels: DataFrame):
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    fitting = checkpoint(stats.join(known, "doc_id").select("stats", "y", fold))
    moments = fitting.agg(F.count("*"), *[f(F.col("stats")[k]) for k in range(len(STATS)) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1::2], float), np.array(moments[2::2], float)
    cosines = Cosines(mean, np.where(scale > 1e-9, scale, 1.0))
    k = FEATURES + 1
    cells = fitting.mapInArrow(_equations_udf(cosines), "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toPandas()
    parts = np.zeros((FOLDS, k * (k + 1)))
    parts[cells["fold"], cells["cell"]] = cells["value"]
    every = np.arange(k * (k + 1))
    weights = solve(every, parts.sum(0), k)
    without = np.stack([solve(every, parts.sum(0) - p, k) for p in parts])
    bins = fitting.mapInArrow(_bins_udf(cosines, without), "bin int, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    count, good = np.zeros(BINS), np.zeros(BINS)
    count[bins["bin"]], good[bins["bin"]] = bins["n"], bins["good"]
    return cosines, weights, isotonic(count, good)


def _with_statistics(docs: DataFrame) -> DataFrame:
    return checkpoint(_texts(docs).mapInArrow(_statistics_udf, "doc_id long, stats array<double>"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, probability, keep) of every row."""
    stats = _with_statistics(docs)
    return stats.mapInArrow(_judge_udf(_model(stats, labels)), "doc_id long, score double, probability double, keep int")


def _keep_udf(model, at: int):
    def run(batches):
        for b in batches:
            keep = np.ones(len(b), bool)
            for lo, data, offs in slices(b.column(at).cast(pa.string())):
                keep[lo : lo + len(offs) - 1] = _judged(statistics(data, offs), model)[1] >= KEEP
            yield b.filter(pa.array(keep))

    return run


def remove(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are judged good; columns stay as they are."""
    model = _model(_with_statistics(docs), labels)
    return docs if model is None else docs.mapInArrow(_keep_udf(model, docs.columns.index("text")), docs.schema)
