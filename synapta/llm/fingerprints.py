"""Document fingerprints by consistent weighted sampling.

A document is a bag of normalised words weighted by their counts. For sample k and term
t three numbers depend on (k, t) alone: r and c from Gamma(2, 1) and b from
Uniform(0, 1). A term of weight w gets the level l = floor(ln w / r + b) and the key
ln c - r (l - b + 1); the sample is the (term, level) of the least key. Two documents have the
same sample with a probability of their generalised Jaccard similarity,
sum min(w, w') / sum max(w, w'), for every sample independently.

The three numbers come from 2**16 quantiles each, picked by the bits of one 64-bit hash. Keys
of equal value are broken by the hash of (term, level), so the order of terms has no say.

Cases: texts that are null or have no word give a null signature; rows that
repeat give equal rows; a null doc_id stays null; other columns are ignored, whatever their names; an empty
table gives no rows. Texts are never cut: a document of any length is taken in tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import counted, long_ids, mix, pair, slices, words
from .tokens import _texts

SAMPLES = 64
_TILE = 1 << 16
_tables: tuple | None = None


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """2**16 quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), and their logarithms."""
    global _tables
    if _tables is None:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.full(len(p), 1.5)
        lo, hi = np.zeros(len(p)), np.full(len(p), 60.0)
        for _ in range(60):
            x = (lo + hi) / 2
            below = 1 - (1 + x) * np.exp(-x) < p
            lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        _tables = x.astype(np.float32), np.log(x).astype(np.float32)
    return _tables


def signatures_of(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, samples: int) -> np.ndarray:
    """n x samples 32-bit signatures of weighted terms; doc is sorted. Documents without a term keep zeros."""
    gamma, log_gamma = _quantiles()
    best = np.full((n, samples), np.uint64(2**64 - 1))
    low = np.uint64(0xFFFF)
    for lo in range(0, len(term), _TILE):
        d, t = doc[lo : lo + _TILE], term[lo : lo + _TILE]
        w = np.log(weight[lo : lo + _TILE]).astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        for k in range(samples):
            u = mix(t + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            r = gamma[u & low]
            b = ((u >> np.uint64(32)) & low).astype(np.float32) / np.float32(65536)
            level = np.floor(w / r + b)
            key = log_gamma[(u >> np.uint64(16)) & low] - r * (level - b + np.float32(1))
            bits = key.view(np.uint32)
            ordered = bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
            name = pair(t, level.astype(np.uint64)) >> np.uint64(32)
            least = np.minimum.reduceat(ordered.astype(np.uint64) << np.uint64(32) | name, first)
            best[d[first], k] = np.minimum(best[d[first], k], least)
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_terms, signature array<int>) of every row."""

    def run(batches):
        for b in batches:
            ids = long_ids(b.column(0))
            for lo, data, offs in slices(b.column(1)):
                n = len(offs) - 1
                _, _, doc, h = words(data, offs, normal=True)
                d, t, tf = counted(doc, h)
                terms = np.bincount(d, minlength=n)
                flat = signatures_of(d, t, tf, n, samples).ravel()
                at = pa.array(np.arange(0, (n + 1) * samples, samples, dtype=np.int32))
                sig = pa.ListArray.from_arrays(at, pa.array(flat), mask=pa.array(terms == 0))
                yield pa.record_batch([ids.slice(lo, n), pa.array(terms), sig], names=["doc_id", "n_terms", "signature"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_terms long, signature array<int>")
