"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's probability is logistic in the hashed words it holds, each counted once;
a word speaks for toxicity (a weight above 0) or says nothing. A document's probability is the noisy-or of its sentences,
1 - prod(1 - p), and only documents carry labels: the gradient of the noisy-or
shares a label out among sentences, so the sentences that make a document toxic are learned
without a label of their own, and are then located.

The bias gives every sentence a small probability, even one without any word that speaks for
toxicity, which would add up over a long document. So documents are judged by what sentences have
beyond it, (p - p0) / (1 - p0) with p0 the probability of a sentence without words:
a document without a word that has a weight scores 0 however long it is.

The model is fitted on at most ``PER_CLASS`` labelled documents of each class (those whose
doc_id hashes lowest), in one task; everything else covers all documents in one pass
without a shuffle of texts. Only features of at least ``MIN_DOCS`` fitting documents that go with the
label (by a G-test that few words pass by chance) have a weight; the threshold is the middle of the range that judges a held-out fifth best, a share of
clean documents weighing ``CLEAN_WEIGHT`` times the same share of toxic ones. Near copies among
the fitting documents count once. The weights are then fitted to all of them.

Sentences end at . ! ? and at line ends. Cases: texts that are null or have no word have
probability 0 and no sentence; a null doc_id stays null; label rows with a null doc_id
or label, or without a document, are ignored; labels that contradict each other count as toxic, and of texts that share a doc_id the first counts; without
labels of both classes nothing is toxic. Very long texts are read whole, in slices. Rows that repeat are scored each; a score that
ties with the threshold is toxic. An empty table gives no rows. Other columns, whatever their names, are ignored by ``toxicity``; ``remove``
keeps all columns and all documents that aren't judged toxic.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from ._text import counted, long_ids, slices, words
from .tokens import _texts

PER_CLASS = 3000
MIN_DOCS = 3
EPOCHS = 150
L1 = 0.00005
L2 = 1e-6
RATE = 0.1
CLEAN_WEIGHT = 4.0
SCHEMA = "doc_id long, score double, toxic int, n_sentences int, offending array<struct<sentence: int, start: int, length: int, score: double>>"
_END = np.zeros(256, bool)
_END[[10, 13, 33, 46, 63]] = True
_KIND = pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])


class Model:
    """Words by their 64-bit hashes, their weights, the bias and the threshold; without words nothing is toxic."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, threshold: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias, self.threshold = hashes[order], weights[order], bias, threshold
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __reduce__(self):
        return Model, (self.hashes, self.weights, self.bias, self.threshold)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, number of the word) of those that have a weight."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
        k = np.searchsorted(self.hashes, h[at])
        ok = self.hashes[np.minimum(k, len(self.hashes) - 1)] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        return at[ok], k[ok]


class Sentences:
    """Sentences of a slice and their features; sentences without a word don't count."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, doc, h = words(data, offs, normal=True)
        mark = np.cumsum(_END[data], dtype=np.int64)
        run = mark[starts] if len(starts) else starts
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])]) if len(starts) else np.zeros(0, bool)
        self.sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.doc = doc[first]
        last = np.append(first[1:], len(starts)) - 1
        self.start, self.end = starts[first], ends[last] if len(first) else starts
        self.n_docs, self.data, self.offs = len(offs) - 1, data, offs
        self.features = h

    def scores(self, model: Model) -> np.ndarray:
        """The probability of each sentence beyond the bias."""
        at, weight = model.lookup(self.features)
        s, which, _ = counted(self.sentence[at], weight.astype(np.uint64))  # each word once per sentence
        return beyond(np.bincount(s, model.weights[which.astype(np.int64)], minlength=len(self.doc)), model.bias)


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) over each document's sentences."""
    return 0.0 - np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def beyond(z: np.ndarray, bias: float) -> np.ndarray:
    """What weights of z add to the probability that the bias gives: 0 without weights."""
    none = sigmoid(np.float64(bias))
    return np.maximum(sigmoid(z + bias) - none, 0) / (1 - none)


def g_test(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """G of the table of a of n against b of m."""
    total = np.zeros(len(a))
    share = (a + b) / max(1, n + m)
    for x, size in ((a, n), (b, m)):
        for seen, expected in ((x, size * share), (size - x, size * (1 - share))):
            ok = seen > 0
            total[ok] += 2 * seen[ok] * np.log(seen[ok] / expected[ok])
    return total


def distinct(texts: list[str]) -> np.ndarray:
    """Places of the first of each group of near copies, lest a document's copies make all its words evidence."""
    if not texts:
        return np.zeros(0, int)
    parts = [simhash_dedup.fingerprints_of(data, offs) for _, data, offs in slices(pa.array(texts, pa.string()))]
    fp, fp2, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    every, links = np.arange(len(fp)), simhash_dedup._Links()
    for u, v in simhash_dedup._near((every, fp, fp2, size), (every, fp, fp2, size)):
        links.add(u, v)
    return np.setdiff1d(every, links.taken()["u"].to_numpy()) if links.n else every


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """The model of labelled documents."""
    labels = np.asarray(labels, float)
    first = distinct(texts)
    texts, labels = [texts[i] for i in first], labels[first]
    n = len(texts)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, 1.0)
    sent, col, doc, base = [], [], [], 0
    for lo, data, offs in slices(pa.array(texts, pa.string())):
        s = Sentences(data, offs)
        a, c, _ = counted(s.sentence, s.features)
        sent.append(a + base)
        col.append(c)
        doc.append(s.doc + lo)
        base += len(s.doc)
    sent, doc = np.concatenate(sent), np.concatenate(doc)
    names, col = np.unique(np.concatenate(col), return_inverse=True)
    held = np.arange(n) % 5 == 4
    used, w, bias = _weights(sent, col, doc, labels, ~held)
    found = np.zeros(len(names))
    found[used] = w
    q = noisy_or(beyond(np.bincount(sent, found[col], minlength=len(doc)), bias), doc, n)
    score, truth = q[held], labels[held] == 1
    threshold = 0.5
    if truth.any() and not truth.all():
        cuts = np.unique(np.concatenate([score, [0.5]]))
        right = np.array([((score >= c) & truth).sum() / truth.sum() + CLEAN_WEIGHT * ((score < c) & ~truth).sum() / (~truth).sum() for c in cuts])
        best = np.flatnonzero(right == right.max())
        lower = score[score < cuts[best[0]]].max(initial=0.0)
        threshold = float(np.clip((lower + cuts[best[-1]]) / 2, 0.2, 0.8))  # a small held-out part can't pull it far
    used, w, bias = _weights(sent, col, doc, labels, np.ones(n, bool))
    return Model(names[used], w, float(bias), threshold)


def _weights(sent, col, doc, labels, fitting) -> tuple[np.ndarray, np.ndarray, float]:
    """(columns, weights, bias) from the documents in ``fitting``: those that go with the label, thinned by a penalty, then fitted without it."""
    n = len(labels)
    d, c, _ = counted(doc[sent], col.astype(np.uint64))
    d, c = d[fitting[d]], c[fitting[d]].astype(np.int64)
    size = int(col.max(initial=-1)) + 1
    has = [np.bincount(c[labels[d] == k], minlength=size) for k in (0, 1)]
    least = 2 * np.log(max(2, size))  # so that fewer than one of all words passes by chance
    keep = ((has[0] + has[1] >= MIN_DOCS) & (g_test(has[1], has[0], (labels[fitting] == 1).sum(), (labels[fitting] == 0).sum()) >= least))[col]
    sent, col = sent[keep], col[keep]
    used, x = np.unique(col, return_inverse=True)
    live, total = fitting[doc], fitting.sum()

    def descend(sent, x, size, l1, l2, epochs):
        """Adam over weights of 0 or more, with the soft threshold of an L1 penalty in its metric."""
        w, bias = np.zeros(size), -6.0
        mw = vw = np.zeros(size + 1)
        for t in range(1, epochs + 1):
            p = np.clip(sigmoid(np.bincount(sent, w[x], minlength=len(doc)) + bias), 1e-9, 1 - 1e-9)
            q = np.clip(noisy_or(p, doc, n), 1e-6, 1 - 1e-6)
            # d loss / d z of a sentence: p for a clean document, -p (1 - q) / q for a toxic one
            g = np.where(labels[doc] == 1, -p * (1 - q[doc]) / q[doc], p) * live / total
            grad = np.append(np.bincount(x, g[sent], minlength=size) + l2 * w, g.sum())
            mw = 0.9 * mw + 0.1 * grad
            vw = 0.98 * vw + 0.02 * grad * grad
            scale = RATE / (np.sqrt(vw / (1 - 0.98**t)) + 1e-8)
            step = scale * mw / (1 - 0.9**t)
            w, bias = w - step[:-1], bias - step[-1]
            w = np.maximum(w - l1 * scale[:-1], 0)
        return w, bias

    w, bias = descend(sent, x, len(used), L1, 0, EPOCHS)
    # those that are left are fitted again without the penalty
    some = w[x] != 0
    used, x = np.unique(used[x[some]], return_inverse=True)
    sent = sent[some]
    w, bias = descend(sent, x, len(used), 0, L2, 2 * EPOCHS)
    return used, w, bias


def _fit_udf(batches):
    rows = [(x["text"], x["toxic"]) for b in batches for x in b.sort_by([("doc_id", "ascending"), ("text", "ascending")]).to_pylist()]
    rows.sort(key=lambda r: (r[0] or "", r[1]))
    yield pa.record_batch([pa.array([pickle.dumps(fit([r[0] or "" for r in rows], np.array([r[1] for r in rows], float)))], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled documents; the model, some hundred words, comes to the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sampled = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sampled = sampled[0].unionByName(sampled[1])  # at most 2 per_class narrow rows
    rows = _texts(docs).join(F.broadcast(sampled), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.repartition(1).mapInArrow(_fit_udf, "model binary").first()
    return pickle.loads(found[0]) if found else fit([], np.zeros(0))


def judged(data, offs, model: Model):
    """(probabilities of documents, sentences, probabilities of sentences)."""
    s = Sentences(data, offs)
    p = s.scores(model)
    return noisy_or(p, s.doc, s.n_docs), s, p


def _score_udf(sent):
    def run(batches):
        model = sent.value
        for b in batches:
            ids = long_ids(b.column(0))
            for lo, data, offs in slices(b.column(1)):
                n = len(offs) - 1
                q, s, p = judged(data, offs, model)
                toxic = q >= model.threshold
                count = np.bincount(s.doc, minlength=n)
                top = np.zeros(n)
                np.maximum.at(top, s.doc, p)
                # of a toxic document: sentences that would be enough by themselves, or else the worst
                bad = np.flatnonzero(toxic[s.doc] & ((p >= model.threshold) | (p == top[s.doc])))
                chars = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.zeros(0, int)
                upto = np.concatenate([[0], chars])
                first = np.concatenate([[0], np.cumsum(count)])
                at = upto[s.start[bad]] - upto[offs[s.doc[bad]]]
                rows = pa.StructArray.from_arrays([pa.array((bad - first[s.doc[bad]]).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array((upto[s.end[bad]] - upto[s.start[bad]]).astype(np.int32)), pa.array(np.round(p[bad], 6))], fields=list(_KIND))
                cuts = np.concatenate([[0], np.cumsum(np.bincount(s.doc[bad], minlength=n))]).astype(np.int32)
                yield pa.record_batch([ids.slice(lo, n), pa.array(np.round(q, 6)), pa.array(toxic.astype(np.int32)), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts), rows)], names=["doc_id", "score", "toxic", "n_sentences", "offending"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, toxic, n_sentences, offending) of every row; offending lists the sentences by number, place and length in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    return _texts(docs).mapInArrow(_score_udf(sent), SCHEMA)


def _keep_udf(sent, at: int):
    def run(batches):
        model = sent.value
        for b in batches:
            keep = np.ones(len(b), bool)
            for lo, data, offs in slices(b.column(at).cast(pa.string())):
                q, _, _ = judged(data, offs, model)
                keep[lo : lo + len(q)] = q < model.threshold
            yield b.filter(pa.array(keep))

    return run


def remove(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Documents that aren't judged toxic; columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    return docs.mapInArrow(_keep_udf(sent, docs.columns.index("text")), docs.schema)
