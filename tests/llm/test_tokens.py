import base64
import random
import re

import numpy as np
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from synapta.llm import bitplanes, fingerprints, packing, tokens
from synapta.llm._text import slices

#: The pattern that the rank files were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    e, out = tokens.encoder(tokens.RANKS), []
    for _, data, offs in slices(pa.array(texts, pa.string()), 200):
        flat, n = e.documents(data, offs)
        out += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    return out


def test_ids_equal_those_of_the_library():
    rng, r = random.Random(1), reference()
    parts = ["a", "b", "'", "s", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "é", "7", "٣", "½", "!", "...", "　", "漢字", "😀", "the", " ing", "'s", "A", "_", "\x1c", "\x85", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab" * 3000, "=" * 4000, " " * 3000 + "x", "aab" * 999, "!?" * 2000, "\n" * 100]
    assert encoded(texts) == [r.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    r = reference.cached = getattr(reference, "cached", None) or reference()
    assert encoded(texts) == [r.encode_ordinary(t) for t in texts]


def test_the_table_of_met_pre_tokens_may_overflow():
    e = tokens.Encoder(tokens.RANKS)
    e.LIMIT, r = 50, reference()
    for t in ("one two three four five six seven eight nine ten " * 3, "eleven twelve " * 40, "one two eleven"):
        (_, data, offs) = next(slices(pa.array([t])))
        assert e.documents(data, offs)[0].tolist() == r.encode_ordinary(t)


def test_counts(make, corpus, spark):
    r = reference()
    docs = make(corpus, n="x", part="y")
    got = sorted((x.doc_id or -1, x.n_tokens, x.n_pre_tokens) for x in tokens.token_counts(docs).collect())
    import regex

    want = sorted((-1 if i is None else i, len(r.encode_ordinary(t or "")), len(regex.findall(PATTERN, t or ""))) for i, t in corpus)
    assert [(a if a else -1, b, c) for a, b, c in got] == [(a if a else -1, b, c) for a, b, c in want]
    assert tokens.token_counts(make([])).count() == 0


def streams(corpus):
    r = reference()
    out = {}
    for i, t in corpus:
        out.setdefault(i, []).append([*r.encode_ordinary(t or ""), tokens.EOS])
    return out


def test_windows_hold_every_token_once(make, corpus):
    want = streams(corpus)
    for parts, size in ((1, 64), (5, 64), (7, 2048), (3, 5)):
        docs = make(corpus, base="b", ids="i").repartition(parts, "doc_id")
        rows = sorted(packing.pack(docs, size).collect(), key=lambda w: w.window_id)
        total = sum(len(s) for ss in want.values() for s in ss)
        assert [w.window_id for w in rows] == list(range(-(-total // size)))
        assert all(w.n_ids == len(w.ids) == size for w in rows[:-1]) and sum(w.n_ids for w in rows) == total
        got = {}
        for w in rows:
            assert [d.start for d in w.docs] == [sum(x.length for x in w.docs[:k]) for k in range(len(w.docs))] and sum(d.length for d in w.docs) == w.n_ids
            for d in w.docs:
                if d.doc_offset == 0:
                    got.setdefault(d.doc_id, []).append([])
                assert len(got[d.doc_id][-1]) == d.doc_offset
                got[d.doc_id][-1] += w.ids[d.start : d.start + d.length]
        assert {i: sorted(s) for i, s in got.items()} == {i: sorted(s) for i, s in want.items()}
    assert packing.pack(make([])).count() == 0


def test_windows_and_blocks_are_in_the_order_of_doc_id_whatever_the_layout(make, corpus, spark, tmp_path):
    r = reference()
    rows = sorted([(i, t) for i, t in corpus if i is not None], key=lambda x: x[0]) + [(None, "none"), (None, "none")]
    want = [x for i, t in rows[-2:] + rows[:-2] for x in [*r.encode_ordinary(t or ""), tokens.EOS]]
    rng = random.Random(1)
    for k, (files, cores) in enumerate(((1, 1), (50, 4), (7, 16), (3, 2))):
        rng.shuffle(rows)
        path = str(tmp_path / str(k))
        make(rows).repartition(files).write.parquet(path)
        spark.conf.set("spark.sql.shuffle.partitions", str(cores))
        try:
            docs = spark.read.parquet(path)
            windows = sorted(packing.pack(docs, 300).collect())
            assert [x for w in windows for x in w.ids] == want and [w.window_id for w in windows] == list(range(len(windows)))
            found = (windows, sorted(bitplanes.write_blocks(docs, 1000).collect()))
            assert k == 0 or found == before
            before = found
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_equal_rows_are_packed_by_several_tasks(make):
    docs = make([(None, "same text")] * 3000 + [(1, "x")]).repartition(6)
    windows = sorted(packing.pack(docs, 50).collect())
    ids = [x for w in windows for x in w.ids]
    assert ids == [*reference().encode_ordinary("same text"), tokens.EOS] * 3000 + [*reference().encode_ordinary("x"), tokens.EOS]
    assert all(sum(d.length for d in w.docs) == w.n_ids for w in windows)


def test_planes_give_back_all_ids(make, corpus):
    want = streams(corpus)
    for bits in (False, True):
        docs = make(corpus + corpus[:3], data="d", block="b").repartition(4, "doc_id")
        blocks = bitplanes.write_blocks(docs, block=500, bits=bits)
        rows = blocks.collect()
        assert all(r.n_ids <= 500 and r.offsets[-1] == len(r.data) for r in rows)
        got = {}
        for r in sorted(bitplanes.read_ids(blocks).collect(), key=lambda r: (r.block, r.start)):
            if r.doc_offset == 0:
                got.setdefault(r.doc_id, []).append([])
            got[r.doc_id][-1] += r.ids
        more = {i: sorted(s * (2 if i in dict(corpus[:3]) else 1)) for i, s in want.items()}
        assert {i: sorted(s) for i, s in got.items()} == more
    assert bitplanes.write_blocks(make([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_split_and_join(ids, bits):
    x = np.array(ids, np.uint32)
    assert (bitplanes.join(bitplanes.split(x, bits), len(x), bits) == x).all()


def test_collisions_follow_generalised_jaccard():
    rng, errors = np.random.default_rng(0), []
    for _ in range(15):
        a = rng.integers(0, 6, 60)
        b = np.where(rng.random(60) < rng.random(), a, rng.integers(0, 6, 60))
        terms = rng.integers(0, 2**63, 60).astype(np.uint64)
        sig = [fingerprints.signatures_of(np.zeros((x > 0).sum(), int), terms[x > 0], x[x > 0], 1, 1024)[0] for x in (a, b)]
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.06


def test_signatures_of_a_table(make, corpus):
    rows = fingerprints.fingerprints(make(corpus, signature="s")).collect()
    assert len(rows) == len(corpus)
    by = {r.doc_id: r.signature for r in rows if r.doc_id is not None}
    assert by[0] == by[100] and by[300] is None and by[301] is None and by[302] is None and len(by[304]) == fingerprints.SAMPLES
    bags = {}
    for i, t in corpus:
        if i is not None and t:
            bags[i] = {w: k for w, k in zip(*np.unique(re.sub(r"[^\w]|_", " ", t.lower()).split(), return_counts=True))}
    for i in range(3, 8):
        a, b = bags[i], bags[100 + i]
        j = sum(min(a.get(w, 0), b.get(w, 0)) for w in a) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())
        assert abs(np.mean(np.array(by[i]) == np.array(by[100 + i])) - j) < 0.2
    assert fingerprints.fingerprints(make([])).count() == 0
