import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_prose import prose

from synapta.llm import decontaminate, html_text, quality, toxicity
from synapta.llm._text import slices


def plain(text):
    return re.sub(r"[\x00-/:-@\[-`{-\x7f]+", " ", (text or "").lower()).split()


def brute_hits(docs, items, n=13):
    patterns = {}
    for item, t in items:
        w = plain(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, t in docs:
        w = plain(t)
        for size in {len(p) for p in patterns}:
            for i in range(len(w) - size + 1):
                for item in patterns.get(tuple(w[i : i + size]), ()):
                    out[doc, item] = out.get((doc, item), 0) + 1
    return {(d, i, k) for (d, i), k in out.items()}


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(14, 50))) for i in range(12)] + [(20, "tiny item"), (21, "a"), (22, ""), (23, None), (24, "a b c d e f g h i j k l"), (None, prose(rng, 20))]
    items += [(30, items[0][1]), (0, items[0][1])]
    docs = [(i, prose(rng, 80)) for i in range(30)]
    for k, (_, t) in enumerate(items[:12]):
        docs.append((100 + k, prose(rng, 20) + " " + (t.upper() if k % 3 == 0 else t.replace(" ", "\n\t ") if k % 3 == 1 else t) + "! " + prose(rng, 20)))
    w = items[1][1].split()
    docs += [(200, prose(rng, 10) + " " + " ".join(w[:13]) + " " + prose(rng, 9)), (201, " ".join(w[:12])), (202, "this tiny, ITEM here"), (203, "É a"), (204, None), (205, ""), (206, "A B-C d e f g h i j k l. " * 3), (None, items[2][1]), (207, items[17][1]), (208, prose(rng, 20_000) + " " + items[3][1])]
    return docs, items


def test_occurrences_equal_brute_force(spark, make, leaks):
    docs, items = leaks
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {tuple(r) for r in decontaminate.occurrences(make(docs, item_id="c", n_hits="c"), bench).collect()}
    assert got == brute_hits(docs, items)
    assert {(100 + k, k) for k in range(12)} <= {(d, i) for d, i, _ in got}
    decontaminate.PIECE, before = 50, decontaminate.PIECE
    try:
        assert {tuple(r) for r in decontaminate.occurrences(make(docs), bench).collect()} == got
        kept = decontaminate.remove(make(docs, __x="c"), bench)
        assert kept.columns[-1] == "__x"
        left = [r.doc_id for r in kept.collect()]
    finally:
        decontaminate.PIECE = before
    dirty = {d for d, _, _ in got}
    assert sorted(left) == sorted(i for i, _ in docs if i not in dirty)


def test_decontamination_of_empty_tables(spark, make, leaks):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.occurrences(make(leaks[0]), none).count() == 0 and decontaminate.remove(make(leaks[0]), none).count() == len(leaks[0])
    bench = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontaminate.occurrences(make([]), bench).count() == decontaminate.remove(make([]), bench).count() == 0


def test_clashing_columns_are_kept(spark, make, leaks):
    docs, items = leaks
    more = dict(texts="a", item_id="b", n_hits="c", c0="d", TEXT_="e", html="f")
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, n_hits string")
    kept = decontaminate.remove(make(docs, **more), bench)
    dirty = {d for d, _, _ in brute_hits(docs, items)}
    assert kept.columns == make(docs, **more).columns and sorted(tuple(r[5:]) for r in kept.collect()) == [tuple(more.values())] * sum(i not in dirty for i, _ in docs)


BAD = ["grunk", "snarvel", "plimfy", "drokle", "vexnit"]


def toxic_corpus(n, rng, first=0):
    docs, labels = [], []
    for i in range(first, first + n):
        s = [prose(rng, 12).replace(".", "") + "." for _ in range(rng.randint(3, 9))]
        bad = rng.random() < 0.3
        if bad:
            k = rng.randrange(len(s))
            s[k] = s[k].replace(" ", f" {rng.choice(BAD)} ", 1)
        docs.append((i, " ".join(s)))
        labels.append((i, int(rng.random() < 0.8), int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = toxic_corpus(700, random.Random(4))
    docs += [(5000, None), (5001, ""), (5002, " . ! ?\n"), (None, "grunk grunk."), (5003, "One grunk. " * 2 + "Fine words. " * 4000), docs[0]]
    half = [x for x in labels if x[0] < 400] + [(None, 1, 1), (7, None, None), (99999, 1, 1)]
    return docs, labels, spark.createDataFrame([(*x, "c") for x in half], "doc_id long, quality int, toxic int, text string")


def test_held_out_documents_and_their_sentences(make, toxic):
    docs, labels, table = toxic
    rows = toxicity.toxicity(make(docs, toxic="t", score="s"), table).collect()
    assert len(rows) == len(docs)
    by, truth = {r.doc_id: r for r in rows}, {i: t for i, _, t in labels}
    held = [i for i in range(400, 700)]
    assert np.mean([by[i].toxic == truth[i] for i in held]) > 0.97
    texts = dict(docs)
    for i in held:
        if by[i].toxic and truth[i]:
            for o in by[i].offending:
                assert any(w in texts[i][o.start : o.start + o.length] for w in BAD)
        else:
            assert by[i].toxic or by[i].offending == []
    assert [by[i].score for i in (5000, 5001, 5002)] == [0, 0, 0] and [by[i].n_sentences for i in (5000, 5001, 5002)] == [0, 0, 0]
    assert by[5003].toxic == 1 and by[None].toxic == 1
    left = toxicity.remove(make(docs, keep="k"), table)
    assert left.columns[-1] == "keep"
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in rows if not r.toxic)


def test_near_copies_count_once_in_little_memory():
    """Near copies and the copies of one text stand for one; 3,000 copies are nine million pairs, none of which need be held."""
    import tracemalloc

    rng = random.Random(8)
    texts = [prose(rng, 100) for _ in range(40)]
    near = [t.replace(t.split()[5], "changed", 1) for t in texts[:10]]
    assert toxicity.distinct(texts + near + texts[20:25]).tolist() == list(range(40))
    assert toxicity.distinct([]).tolist() == [] and toxicity.distinct(texts).tolist() == list(range(40)) and toxicity.distinct(["", " ", "one"]).tolist() == [0, 2]
    tracemalloc.start()
    try:
        assert toxicity.distinct(texts[:1] * 3000).tolist() == [0]
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_length_alone_makes_no_document_toxic(make):
    rng = random.Random(7)
    docs, labels = toxic_corpus(400, rng)
    truth = [int(i % 10 == 0 or t) for i, _, t in labels]  # some toxic documents that no word explains hold the bias up
    model = toxicity.fit([t for _, t in docs], np.array(truth, float))
    assert len(model.hashes) and toxicity.sigmoid(np.float64(model.bias)) > 1e-5
    for n in (1, 1000, 50_000):
        plain = "Plain words stand here. " * n
        for text, toxic in ((plain, False), (plain + "One grunk.", True)):
            q = np.concatenate([toxicity.judged(data, offs, model)[0] for _, data, offs in slices(pa.array([text], pa.string()))])
            assert len(q) == 1 and (q[0] >= model.threshold) == toxic, (n, toxic)
            assert toxic or q[0] == 0


def test_the_fit_equals_a_plain_one():
    """Noisy-or loss by loops over documents and sentences, the same descent."""
    rng = random.Random(3)
    docs = [[[rng.randrange(6) for _ in range(3)] for _ in range(rng.randint(1, 4))] for _ in range(40)]
    labels = np.array([float(any(0 in s for s in d)) for d in docs])
    sent, col, doc, k = [], [], [], 0
    for i, d in enumerate(docs):
        for s in d:
            for c in sorted(set(s)):
                sent.append(k)
                col.append(c)
            doc.append(i)
            k += 1
    used, w, bias = toxicity._weights(np.array(sent), np.array(col), np.array(doc), labels, np.ones(len(docs), bool))

    def loss(w, bias):
        """Mean cross entropy of the noisy-or."""
        total = 0.0
        for d, y in zip(docs, labels):
            clean = 1.0
            for s in d:
                clean *= 1 - 1 / (1 + np.exp(-(sum(w.get(c, 0.0) for c in set(s)) + bias)))
            total -= np.log(max(1 - clean, 1e-12)) if y else np.log(max(clean, 1e-12))
        return total / len(docs)

    found = dict(zip(used.tolist(), w.tolist()))
    assert 0 in found and found[0] == max(found.values()) and min(found.values()) >= 0
    least = loss(found, bias)
    assert least < 0.05 and least < loss({}, np.log(labels.mean() / (1 - labels.mean())))
    # the gradient that the fit follows is the slope of that loss
    ids, size, live = np.array(sent), len(doc), np.array(doc)
    for weights, b in (({0: 1.0, 1: 0.5}, -2.0), ({0: 0.3}, -1.0)):
        z = np.array([sum(weights.get(c, 0.0) for c in np.array(col)[ids == s]) + b for s in range(size)])
        p = toxicity.sigmoid(z)
        q = toxicity.noisy_or(p, live, len(docs))
        g = np.where(labels[live] == 1, -p * (1 - q[live]) / q[live], p) / len(docs)
        for c in (0, 1, 2):
            up, down = (loss(weights | {c: weights.get(c, 0.0) + e}, b) for e in (1e-5, -1e-5))
            assert abs((up - down) / 2e-5 - g[ids[np.array(col) == c]].sum()) < 1e-6
        assert abs((loss(weights, b + 1e-5) - loss(weights, b - 1e-5)) / 2e-5 - g.sum()) < 1e-6


def test_scores_equal_a_plain_count(make, toxic):
    docs, _, table = toxic
    model = toxicity.train(make(docs), table)
    from synapta.llm._text import words

    def weight(word):
        raw = word.encode()
        at, k = model.lookup(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[3])
        return model.weights[k[0]] if len(at) else 0.0

    none = 1 / (1 + np.exp(-model.bias))
    for r in toxicity.toxicity(make(docs), table).collect():
        if r.doc_id is None or r.doc_id == 5003 or r.doc_id % 7:
            continue
        clean, n = 1.0, 0
        for s in re.split(r"[.!?\r\n]", dict(docs)[r.doc_id] or ""):
            if plain(s):
                n += 1
                z = sum(weight(w) for w in set(plain(s)))
                clean *= 1 - max(1 / (1 + np.exp(-(z + model.bias))) - none, 0) / (1 - none)
        assert abs(r.score - (1 - clean)) < 1e-5 and r.n_sentences == n and r.toxic == (1 - clean >= model.threshold)


def test_without_labels_nothing_is_toxic(spark, make, toxic):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(toxic[0][:20])
    assert {r.toxic for r in toxicity.toxicity(docs, none).collect()} == {0} and toxicity.remove(docs, none).count() == 20
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.remove(docs, one).count() == 20
    assert toxicity.toxicity(make([]), toxic[2]).count() == 0


def test_noisy_or_and_the_sample_bound(make, toxic):
    p, doc = np.array([0.5, 0.5, 0.1]), np.array([0, 0, 2])
    assert np.allclose(toxicity.noisy_or(p, doc, 3), [0.75, 0, 0.1])
    model = toxicity.train(make(toxic[0]), toxic[2], per_class=1)
    assert len(model.weights) == 0


def junk(rng):
    return " ".join(rng.choice(["@@@", "###", "buy", "now"]) for _ in range(rng.randint(20, 80)))


def test_quality_of_held_out_documents(spark, make):
    rng = random.Random(6)
    docs = [(i, junk(rng) if i % 4 == 0 else prose(rng, rng.randint(30, 200))) for i in range(500)]
    more = [(900, None), (901, ""), (902, "x"), (903, prose(rng, 20_000)), (None, "plain words here"), docs[1]]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), "c") for i in range(300)] + [(None, 1, "c"), (5, None, "c")], "doc_id long, quality int, stats string")
    rows = quality.quality(make(docs + more, stats="s", score="s"), labels).collect()
    assert len(rows) == len(docs) + len(more)
    by = {r.doc_id: r for r in rows}
    assert np.mean([by[i].keep == (i % 4 != 0) for i in range(300, 500)]) > 0.97
    order = sorted(rows, key=lambda r: r.score)
    assert all(a.probability <= b.probability + 1e-9 for a, b in zip(order, order[1:]))
    assert all(r.probability is not None for r in rows)
    none = quality.quality(make(docs[:5]), labels.where("doc_id < 0")).collect()
    assert all(r.keep == 1 and r.probability is None for r in none)
    assert quality.quality(make([]), labels).count() == 0


def test_quality_equals_a_plain_version(spark, make):
    """All in numpy at once: folds, ridge by least squares, and rising shares by the min-max formula."""
    rng = random.Random(16)
    docs = [(i, junk(rng) if i % 3 == 0 else prose(rng, rng.randint(5, 60)) + (" @@@ buy" * (i % 5))) for i in range(240)]
    labels = [(i, int((i % 3 != 0) ^ (i % 11 == 0)), 0) for i in range(0, 240, 2)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = sorted(quality.quality(make(docs), table).collect())
    x = np.concatenate([quality.statistics(d, o) for _, t in docs for _, d, o in slices(pa.array([t]))])
    at, y = np.array([i for i, _, _ in labels]), np.array([g for _, g, _ in labels], float)
    scale = x[at].std(0)
    c = quality.Cosines(x[at].mean(0), np.where(scale > 1e-9, scale, 1.0))
    f = c.of(x)
    fold = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _ in docs], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS})").collect()}
    fold = np.array([fold[i] for i in at])
    root = np.sqrt(np.diag([1e-9] + [quality.RIDGE] * quality.FEATURES))

    def ridge(some):
        return np.linalg.lstsq(np.r_[f[at][some], root], np.r_[y[some], np.zeros(len(root))], rcond=None)[0]

    held = np.array([f[i] @ ridge(fold != k) for i, k in zip(at, fold)])
    bins = quality._bin(held)
    some = np.unique(bins)
    share = [(y[bins == b].sum(), (bins == b).sum()) for b in some]
    mean = lambda a, b: sum(g for g, _ in share[a : b + 1]) / sum(n for _, n in share[a : b + 1])
    rising = np.array([max(min(mean(a, b) for b in range(i, len(some))) for a in range(i + 1)) for i in range(len(some))])
    score = f @ ridge(fold >= 0)
    assert np.allclose([r.score for r in rows], score, atol=2e-6)
    place = np.searchsorted(some, quality._bin(score), "right") - 1
    want = np.where(place >= 0, rising[np.maximum(place, 0)], 0.0)
    off = np.abs(np.array([r.probability for r in rows]) - want) > 2e-6
    # an empty bin takes the pool or the bin before it; scores on the edge of a bin may fall to either side
    assert off.mean() < 0.02
    kept = quality.remove(make(docs, stats="s"), table)
    assert kept.columns[-1] == "stats" and sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in rows if r.keep]
    assert quality.remove(make(docs[:9]), table.where("doc_id < 0")).count() == 9 and quality.remove(make([]), table).count() == 0


def test_equations_calibration_and_features():
    rng = np.random.default_rng(2)
    f, y = rng.standard_normal((50, 4)), rng.standard_normal(50)
    m = f.T @ np.c_[f, y]
    i, j = np.nonzero(np.arange(4)[:, None] <= np.arange(5))
    penalty = np.diag([1e-9, 1, 1, 1])
    assert np.allclose(quality.solve(i * 5 + j, m[i, j], 4), np.linalg.solve(f.T @ f + penalty, f.T @ y))
    assert quality.isotonic(np.array([1.0, 1, 0, 2, 1]), np.array([1.0, 0, 0, 1, 1])).tolist() == [0.5, 0.5, 0.5, 0.5, 1.0]
    x = rng.standard_normal((300, len(quality.STATS)))
    c = quality.Cosines(np.zeros(x.shape[1]), np.ones(x.shape[1]), 4000)
    z = c.of(x)[:, 1:]
    kernel = np.exp(-((x[:20, None] - x[None, :20]) ** 2).sum(2) / (2 * x.shape[1]))
    assert np.abs(z[:20] @ z[:20].T - kernel).max() < 0.1


def test_statistics_of_slices_equal_those_of_single_texts(corpus):
    texts = [t for _, t in corpus]
    whole = np.concatenate([quality.statistics(d, o) for _, d, o in slices(pa.array(texts, pa.string()))])
    one = np.concatenate([quality.statistics(d, o) for t in texts for _, d, o in slices(pa.array([t], pa.string()))])
    assert np.allclose(whole, one)


LONG = "This is the long first paragraph of an article, with many words and no markup in it at all. " * 3
PAGE = f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li><li><a href=z>Shop</a></li><li><a>Help</a></li></ul><p>{LONG}</p><p>Short one.</p><p>{LONG} &amp; more</p><!-- no --><footer><a>c</a><a>d</a></footer></body></html>"


def test_main_text_is_found():
    text, n, regions = html_text.content(PAGE)
    assert text.count(LONG.strip()) == 2 and "& more" in text and "Short one." in text and regions == 1 and n > 6
    assert not any(w in text for w in ("Home", "var a", "no -->", "T\n"))


def test_pages_of_every_kind(spark):
    pages = [(1, PAGE), (2, None), (3, ""), (4, "no markup, one line"), (5, "<p>unclosed <b>tags <div>here"), (6, "<![broken <!doctype <p>x</q>&#xZZ; &nope; <"), (None, "<p>a</p>"), (1, PAGE), (7, "<div>" * 3000 + "deep text" + "</div>" * 3000), (8, "<p>" + "word " * 50_000 + "</p>"), (9, "a\nb\n\nc")]
    rows = html_text.extract(spark.createDataFrame([(i, h, "c") for i, h in pages], "page_id long, html string, text string")).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(pages) and by[2].text is None and by[3].text == "" and by[4].text == "no markup, one line" and len(by[8].text.split()) == 50_000
    assert [r.text for r in rows if r.page_id == 1] == [html_text.content(PAGE)[0]] * 2
    assert all(r.text == html_text.content(h)[0] for r, (_, h) in zip(rows, pages))
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_text_after_broken_declarations_is_kept():
    for d in ("<![ endif]-->", "<![]>", "<![foo>", "<![data-x]>", "<![endif-->", "<![endif>", "<![if !IE]>", "<![CDATA[ a > b ]]>"):
        text, _, _ = html_text.content(f"<p>{LONG}</p>{d}<p>{LONG} after ]> it</p>")
        assert text.count(LONG.strip()) == 2 and text.endswith("after ]> it"), d
    assert html_text.content(f"<p>{LONG}</p><![foo")[0].startswith(LONG.strip())
    rng, parts = random.Random(8), ["<![", "<!", "foo", "endif", "]", ">", "--", "]]>", " ", "<p>", "</p>", "CDATA[", "<", "&", "x"]
    for _ in range(3000):
        junk = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        html_text.content(f"<p>{LONG}</p>{junk}<p>{LONG}</p>")


def test_hidden_elements_lose_no_text():
    a, b = LONG.strip(), "Another paragraph that is long enough to count as content of this page. " * 3
    for hidden in ('<svg><path d="x">', "<noscript>", "<template>", "<svg><g><svg>", "<noscript><template>", "<svg><text>x"):
        for page in (f"<div>{hidden}<p>{a}</p></div><p>{b}</p>", f"<div>{hidden}</div><p>{a}</p><p>{b}</p>", f"{hidden}<p>{a}</p><p>{b}</p>"):
            text, _, _ = html_text.content(page)
            assert a in text and b.strip() in text, page
    for hidden in ("<svg><text>no</text><svg><text>no</text></svg><text>no</text></svg>", "<template><div>no<template>no</template>no</div></template>", "<noscript>no</p></noscript>", "<script>no <p> no</script>", "<style>no</style>", "<svg><foreignObject><p>no</p></foreignObject>no</svg>"):
        text, _, _ = html_text.content(f"<p>{a}</p>{hidden}<p>{b}</p>")
        assert text == f"{a}\n{b.strip()}", hidden


class PlainLines(html_text.HTMLParser):
    """Lines by ratio, with nothing but a depth for what is hidden; for pages whose elements are closed."""

    def __init__(self):
        super().__init__()
        self.done, self.now, self.tags, self.depth = [], "", 0, 0

    def flush(self):
        words = self.now.split()
        if words or self.tags:
            self.done.append((" ".join(words), self.tags))
        self.now, self.tags = "", 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in html_text._HIDDEN
        if not self.depth:
            if tag in html_text._BLOCK:
                self.flush()
            self.tags += 1

    def handle_endtag(self, tag):
        if tag in html_text._HIDDEN:
            self.depth -= 1
        elif not self.depth:
            self.tags += 1
            if tag in html_text._BLOCK:
                self.flush()

    def handle_data(self, data):
        if not self.depth:
            for k, line in enumerate(data.split("\n")):
                if k:
                    self.flush()
                self.now += line


def plain_content(html):
    p = PlainLines()
    p.feed(html)
    p.close()
    p.flush()
    ratio = [len(t) / max(1, n) for t, n in p.done]
    soft = []
    for i in range(len(ratio)):
        near = [(np.exp(-((i - j) ** 2) / (2 * html_text.RADIUS**2)), ratio[j]) for j in range(max(0, i - html_text.RADIUS), min(len(ratio), i + html_text.RADIUS + 1))]
        soft.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(soft) / max(1, len(soft))
    cut = html_text.SHARE * (sum((x - mean) ** 2 for x in soft) / max(1, len(soft))) ** 0.5
    return "\n".join(t for (t, _), x in zip(p.done, soft) if t and x >= cut and x > 0)


def test_pages_equal_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    want = {r.page_id: plain_content(r.html) for r in pages.collect()}
    assert len(want) == 50 and got == want


def test_smoothing():
    x = np.array([0.0, 0, 10, 0, 0])
    k = np.exp(-np.arange(-2, 3) ** 2 / 8)
    assert np.allclose(html_text.smoothed(x, 2)[2], 10 * k[2] / k.sum()) and np.allclose(html_text.smoothed(np.full(4, 3.0), 2), 3)
