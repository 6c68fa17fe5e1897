"""What the engine promises, on tiny tables."""

import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from synapta.functions import nlp
from synapta.functions.counting import TokenCounter
from synapta.functions import text as X
from synapta.functions import vectors as V
from synapta.operators import clusters, compress, consolidate, ingest, knowledge, learning, merge, ordering, retrieval, store
from synapta.schema import BELIEF, DEFAULT_EXPANSIONS, Tunables
from synapta.sources import importers
from synapta.sources.vector_store import ApproximateStore, ExactStore, HashedStore, HttpStore, RemoteIndexStore, create_vector_store


def beliefs(spark, rows):
    """Normalised beliefs from dictionaries; seq is the place in the list."""
    full = [{f.name: None for f in BELIEF} | {"seq": i, "category": "premises", "relations": [], "stability_index": 0.5, "confidence": 0.5} | r for i, r in enumerate(rows)]
    return store.normalize(spark.createDataFrame([tuple(r[f.name] for f in BELIEF) for r in full], BELIEF))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# --- functions


@pytest.mark.parametrize(
    ("text", "want"),
    [("8:56 pm on 20 July, 2023", "2023-07-20 20:56"), ("12:05 am on 3 jan 2024", "2024-01-03 00:05"), ("May 8, 2023", "2023-05-08"), ("Smarch 8, 2023", "2023-01-08"), ("yesterday", "yesterday")],
)
def test_spoken_dates(spark, text, want):
    assert one(spark, X.spoken_date(F.lit(text))) == want


@pytest.mark.parametrize(("word", "want"), [("Running", "runn"), ("loves", "love"), ("boxes", "box"), ("watches", "watch"), ("class", "class"), ("red", "r"), ("this", "thi"), (" Friends ", "friend")])
def test_stems_are_the_same_in_both_places(spark, word, want):
    assert one(spark, X.stem(F.lit(word))) == want == nlp.stem(word)


def test_values_and_templates(spark):
    s = "Adam says he prefers Python 3.12."
    assert one(spark, X.salient_tokens(F.lit(s))) == ["adam", "python", "3.12"]
    assert one(spark, X.statement_template(F.lit(s))) == "<v> says he prefers <v> <v>" == merge.template(s)
    assert one(spark, X.salient_tokens(F.lit("The user likes tea"))) == []


def test_small_text_functions(spark):
    assert [one(spark, X.turn_number(F.lit(t))) for t in ("t12", " 7", "turn3", "", "12x")] == [12, 7, None, None, None]
    assert [one(spark, X.token_count(F.lit(t))) for t in ("", "ab", "a" * 401)] == [0, 1, 100]
    assert one(spark, X.infer_subject(F.lit("[2024-01-01] Maria runs"))) == "Maria" and one(spark, X.infer_subject(F.lit("runs"))) is None
    assert one(spark, X.slug(F.lit("  Martial Arts! "))) == "martial_arts"
    assert one(spark, X.canonical_category(F.lit("person"))) == "people"
    assert one(spark, X.has_term(F.lit("a dancer's dance"), "dance")) and not one(spark, X.has_term(F.lit("a dancer"), "dance"))
    assert one(spark, X.without_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.slashed_date(F.lit("2023/05/20 (Sat) 02:21"))) == "2023-05-20 02:21"
    assert one(spark, X.raw_time(F.lit("8:56 pm on 20 July, 2023"))) == datetime(2023, 7, 20, 20, 56)
    assert len(one(spark, X.elided(F.lit("x" * 5000)))) == 2000 + 800 + len("\n...[truncated]...\n")


def test_cosine_of_zero_vectors_and_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x[5] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(5)
    got = V.top_k_join(df.withColumnRenamed("id", "query_id"), df, 4)
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    want = {(q, int(i), r + 1) for q, s in enumerate(u @ u.T) for r, i in enumerate(sorted(range(60), key=lambda i: (-round(s[i], 9), i))[:4])}
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want
    before, V.BROADCAST = V.BROADCAST, 300
    try:
        assert {(r.query_id, r.id, r["rank"]) for r in V.top_k_join(df.withColumnRenamed("id", "query_id"), df, 4).collect()} == want
    finally:
        V.BROADCAST = before
    assert [r.id for r in V.top_k(df, x[3].tolist(), 1).collect()] == [3]


def test_keyword_scores_are_summed_in_parts_of_bounded_size(spark, monkeypatch):
    b = spark.range(200).selectExpr("id", "concat('alpha beta w', id % 7) as body")
    g = spark.createDataFrame([(q, n, w, True) for q in range(5) for n, w in enumerate(("alpha", "beta", "w3"))], "query_id long, grp int, term string, direct boolean")
    monkeypatch.setattr(retrieval, "MET", 100)
    got = retrieval.keyword_scores(g, b, F.lit(200.0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(id#" in plan and ", 22)" in plan
    assert got.count() == 1000 and got.where("keyword_score > 0.5").count() == 5 * len([i for i in range(200) if i % 7 == 3])


def test_neighbours_above_a_floor_and_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50, 30))
    x[25:] = x[:25] + 0.4 * rng.standard_normal((25, 30))
    x[40] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    q = df.where("id % 5 < 2").withColumnRenamed("id", "query_id")
    names, vectors, cells = next(V._passes(q, ["query_id", "embedding"], 3))
    assert len(names) == 20 and vectors.shape == (20, 30) and vectors.dtype == np.float64 and cells is None
    monkeypatch.setattr(V, "TILE", 64)
    monkeypatch.setattr(V, "SIDE", 7)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    pairs = {(r.query_id, r.id): r.similarity for r in V.all_pairs(q, df).collect()}
    assert set(pairs) == {(a, b) for a in range(50) if a % 5 < 2 for b in range(50)} and all(abs(s - sims[k]) < 1e-12 for k, s in pairs.items())
    want = {(a, b) for a, _ in pairs for b in sorted(range(50), key=lambda b: (-round(sims[a, b], 9), b))[:3] if sims[a, b] >= 0.8}
    got = {(r.query_id, r.id) for r in V.top_k_join(q, df, 3, floor=0.8).collect()}
    assert got == want and 20 < len(got) < 60


def test_a_task_gives_on_the_foremost_matches_only(spark):
    scores = spark.range(300).selectExpr("id % 3 as query_id", "id div 3 as id", "cast(id % 7 as double) as keyword_score").repartition(4)
    b = spark.range(100).selectExpr("id", "0.0D as relevance", "id as seq")
    q = spark.range(3).selectExpr("id as query_id")
    assert retrieval._foremost(scores.join(F.broadcast(b), "id").select("query_id", "id", "keyword_score", "relevance", "seq"), 5).count() == 4 * 3 * 5
    want = {(q, i, n) for q in range(3) for n, (_, i) in enumerate(sorted((-((3 * i + q) % 7), i) for i in range(100))[:5], 1)}
    assert {(r.query_id, r.id, r.place) for r in retrieval.by_keywords(q, scores, b, 5).collect()} == want


def test_tags_and_keywords():
    assert nlp.tags("Nora likes hiking with her cousins, Ida and Piet") == ["[person]", "[relation]", "[event]", "[person]", "[person]"]
    assert nlp.tags(None) == [] and nlp.keywords("") == []
    assert nlp.keywords("a charity race near the homeless shelter")[:2] == ["charity race", "homeless shelter"]
    assert len(nlp.keywords("red green blue yellow purple orange")) <= 4


def test_heads_keep_room_for_learned_vocabulary():
    h = nlp.heads("What achievement did John share with friends and colleagues during the long hiking weekend trip there", DEFAULT_EXPANSIONS, {"john": {"friends": ["Bob", "Cindy"]}})
    assert h[0].startswith("What achievement") and len(h) <= 16 and {"Bob", "Cindy", "finished"} <= set(h) and "John" in h
    assert "passionate" not in nlp.heads("uninteresting", DEFAULT_EXPANSIONS, {})


# --- the table


def test_insert_upsert_delete_and_round_trip(spark, tmp_path):
    b = beliefs(spark, [{"id": "a", "content": "x"}, {"id": "b", "content": "y", "category": "people"}])
    more = beliefs(spark, [{"id": "b", "content": "new", "seq": 8}, {"id": "c", "content": "z", "seq": 9}, {"id": "c", "content": "later", "seq": 10}])
    added = store.insert_if_absent(b, more)
    assert {(r.id, r.content) for r in added.collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert {(r.id, r.content) for r in store.upsert(b, more).collect()} == {("a", "x"), ("b", "new"), ("c", "later")}
    assert [r.id for r in store.delete(b, b.where("id = 'a'")).collect()] == ["b"]
    store.write(added, f"{tmp_path}/t")
    store.write(store.read(spark, f"{tmp_path}/t", "people").withColumn("content", F.lit("over")), f"{tmp_path}/t")
    assert {(r.id, r.content) for r in store.read(spark, f"{tmp_path}/t").collect()} == {("a", "x"), ("b", "over"), ("c", "z")}
    plan = store.read(spark, f"{tmp_path}/t", "people")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "category" in plan
    assert store.lookup(added, "c").first().content == "z" and store.empty(spark).count() == 0


def test_json_import_skips_broken_and_unknown_files(spark, tmp_path):
    (tmp_path / "people.json").write_text(json.dumps([{"id": "p", "content": "Ann", "confidence": 2}]))
    (tmp_path / "skills.json").write_text("{not json")
    (tmp_path / "other.json").write_text(json.dumps([{"id": "o", "content": "x"}]))
    rows = store.normalize(store.read_json(spark, str(tmp_path))).collect()
    assert [(r.id, r.category, r.confidence) for r in rows] == [("p", "people", 1.0)]


def test_related_in_both_directions_and_hops(spark):
    b = beliefs(spark, [{"id": "a", "relations": ["b", "lost"]}, {"id": "b", "relations": ["c"]}, {"id": "c"}, {"id": "d", "relations": ["a"]}])
    got = {(r.id, r.hop) for r in store.related(b, b.where("id = 'a'"), 2).collect()}
    assert got == {("b", 1), ("d", 1), ("c", 2)}


def test_decay_is_gradual_prunes_and_spares_memory(spark):
    day = datetime(2024, 6, 1)
    b = beliefs(spark, [{"id": "strong", "content": "x", "confidence": 0.95, "stability_index": 0.8, "created_at": day, "verifications": 0.0}, {"id": "weak", "content": "x", "confidence": 0.2, "stability_index": 0.0, "created_at": day}, {"id": "m", "category": "memory", "content": "x", "confidence": 0.1}, {"id": "undated", "content": "x", "verifications": 2.0}])
    after = {r.id: r for r in store.decay(b, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert set(after) == {"strong", "m", "undated"} and after["m"].confidence == 0.1
    target = 0.20 * 1.3
    assert after["strong"].confidence == round(0.95 + (target - 0.95) * 0.3, 3)
    aged = min(1, (0.2 + 0.4 * math.log2(31) / math.log2(31) + 0.2 * 0.2) * 1.0)
    assert after["undated"].confidence == round(0.5 + (aged - 0.5) * 0.3, 3) and after["undated"].verifications == 1.95
    s = store.decay_stats(b, F.lit("2024-06-01").cast("timestamp")).first()
    assert (s.pruned, s.updated) == (1, 2)


def test_equilibrium_of_the_prune_threshold(spark):
    b = beliefs(spark, [{"id": "edge", "content": "x", "confidence": 0.2, "stability_index": 0.5, "created_at": datetime(2024, 6, 1), "verifications": 0.0}])
    for _ in range(2):
        b = store.decay(b, F.lit("2024-06-01").cast("timestamp"))
    assert b.count() == 1


# --- merging


def statement(i, text, **more):
    return {"id": i, "content": text, "confidence": 0.9, "source": "new", "created_at": datetime(2024, 6, 1), "seq": 100} | more


def merged(spark, old, new, **kw):
    return {r.id: r for r in merge.merge(beliefs(spark, old), beliefs(spark, new), **kw).collect()}


def test_same_id_corroborates(spark):
    r = merged(spark, [{"id": "a", "content": "likes tea", "source": "s", "relations": ["x"]}], [statement("a", "likes tea", relations=["x", "y"])])
    a = r["a"]
    assert len(r) == 1 and a.confidence == pytest.approx(0.6) and a.verifications == 2 and a.stability_index == pytest.approx(0.55) and a.relations == ["x", "y"] and a.source == "s; new"


def test_same_slot_with_other_values_supersedes(spark):
    r = merged(spark, [{"id": "a", "content": "Adam prefers Python", "verifications": 5.0}], [statement("b", "Adam prefers Rust")])
    a = r["a"]
    assert list(r) == ["a"] and a.content == "Adam prefers Rust" and a.previous_content == "Adam prefers Python" and a.verifications == 1 and a.confidence == 0.9 and a.stability_index == pytest.approx(0.35)


def test_other_people_and_categories_stay_apart(spark):
    r = merged(spark, [{"id": "a", "content": "Adam prefers Python"}, {"id": "c", "content": "Eve prefers Rust", "category": "people"}], [statement("b", "Bob prefers Tea"), statement("d", "Eve prefers Go")])
    assert set(r) == {"a", "b", "c", "d"}


def test_dates_count_only_when_strict(spark):
    old, new = [{"id": "a", "content": "[2024-01-01] Adam runs"}], [statement("a", "[2024-02-01] Adam runs")]
    assert merged(spark, old, new)["a"].previous_content is None
    strict = merged(spark, old, new, strict=True)["a"]
    assert strict.previous_content == "[2024-01-01] Adam runs" and strict.verifications == 1


def test_statements_of_one_batch_meet_in_order(spark):
    r = merged(spark, [], [statement("a", "Adam prefers Python", seq=1), statement("b", "Adam prefers Rust", seq=2), statement("c", "Adam prefers Go", seq=3), statement("d", "unrelated words", seq=4)])
    assert set(r) == {"a", "d"} and r["a"].content == "Adam prefers Go" and r["a"].previous_content == "Adam prefers Rust"


def test_near_meaning_merges_within_the_category(spark):
    e = [1.0, 0.0, 0.0]
    old = [{"id": "a", "content": "enjoys long walks", "embedding": e}, {"id": "s", "content": "walks", "category": "skills", "embedding": e}]
    r = merged(spark, old, [statement("b", "likes to walk far", embedding=[0.85, 0.5268, 0.0])])
    assert set(r) == {"a", "s"} and r["a"].content == "enjoys long walks" and r["a"].verifications == 2
    r = merged(spark, old, [statement("b", "likes long walks", embedding=[0.95, 0.3122, 0.0])])
    assert r["a"].content == "likes long walks" and r["a"].embedding is None
    r = merged(spark, old, [statement("b", "likes cake", embedding=[0.5, 0.866, 0.0])])
    assert set(r) == {"a", "b", "s"}


def test_fold_equals_a_loop_over_single_merges(spark):
    rng = random.Random(3)
    new = [statement(f"n{i}", f"{rng.choice(['Ann', 'Bob', 'Cid'])} likes {rng.choice(['Tea', 'Rust', 'Go', 'Jazz'])}{rng.choice([' daily', ''])}", seq=i) for i in range(25)]
    whole = merged(spark, [], new)
    step: list[dict] = []
    for n in new:
        step = merge.fold([*[{**r, "is_new": False} for r in step], {f.name: None for f in BELIEF} | {"category": "premises", "stability_index": 0.5, "verifications": 1.0, "match_id": None, "is_new": True} | n])
    assert {(i, r.content, round(r.confidence, 9)) for i, r in whole.items()} == {(r["id"], r["content"], round(r["confidence"], 9)) for r in step}


def test_rivals_of_a_fold_are_the_oldest_that_share_most():
    rng = random.Random(9)
    slots, store = merge._Slots(store := {}, False), store
    for n in range(400):
        places = rng.choice([2, 3, 7])
        r = {"id": f"n{n}", "seq": n // 2, "category": "p", "content": " ".join(["With"] * (places > 3) + [rng.choice("ABCDE") + "x" for _ in range(places)])}
        mine, best = merge.salient(r["content"]), (0, 0, None)
        for c in store.values():
            t = merge.salient(c["content"])
            if merge.template(c["content"]) == merge.template(r["content"]) and t - mine and mine - t and mine & t:
                best = min(best, (-len(mine & t), c["seq"], c["id"]))
        assert slots.rival(r) == best[2]
        store[r["id"]] = r
        slots.add(r)
        if n % 3 == 0:
            slots.remove(gone := store.pop(rng.choice(list(store))))
            assert all((gone["seq"], gone["id"]) not in x for x in slots.lists.values())


def test_rivals_of_a_common_value_are_found_without_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    said = [f"Met {rng.choice('ABCD')}x and {rng.choice('ABC')}x at {rng.choice('AEFG')}x" for _ in range(60)] + [f"From {' '.join(rng.choice('ABC') + 'y' for _ in range(7))}" for _ in range(40)] + [f"Ann has {i}" for i in range(30)] + ["Ann has Ann"] * 9
    rows = [(f"s{i % 130:03d}", rng.choice(["p", "p", "q"]), t) for i, t in enumerate(said)]
    want = {}
    for i, c, t in rows:
        a = merge.salient(t)
        for j, o, u in rows:
            b = merge.salient(u)
            if i != j and c == o and merge.template(t) == merge.template(u) and a & b and a - b and b - a:
                want[i] = min(want.get(i, (0, "")), (-len(a & b), j))
    df = spark.createDataFrame(rows, "id string, category string, content string")
    assert {r.id: (-r.shared, r.other_id) for r in merge.template_conflicts(df).collect()} == want
    monkeypatch.setattr(merge, "HEADS", 1)  # several stretches of a list
    same = spark.createDataFrame([(f"s{i:05d}", "p", f"Ann has {i}") for i in range(3000)], "id string, category string, content string")
    assert {(r.id, r.other_id) for r in merge.template_conflicts(same).collect()} == {(f"s{i:05d}", "s00001" if i == 0 else "s00000") for i in range(3000)}


# --- memory


def test_chunks_are_bounded_and_lose_nothing(spark):
    rng = random.Random(1)
    text = " ".join(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(3, 30))) + "." for _ in range(40)) + " " + "long " * 300
    chunks = one(spark, ingest.chunk_text(F.lit(text)))
    assert " ".join(chunks).split() == text.split() and len(chunks) > 5 and all(len(c) // 4 <= 160 for c in chunks)
    assert one(spark, ingest.chunk_text(F.lit("  short text. "))) == ["short text."] and one(spark, ingest.chunk_text(F.lit(" "))) == []


def test_sentences_keep_digits_at_their_ends(spark):
    text = "0 one. 1 two 1. 2nd of 3.3 parts 2. 33.122.173.101\n4512 and 4"
    assert one(spark, X.sentences(F.lit(text))) == ["0 one.", "1 two 1.", "2nd of 3.3 parts 2.", "33.122.173.101", "4512 and 4"]
    long = " ".join(f"{i}{i} words of a sentence that is number {i}." for i in range(40))
    assert " ".join(one(spark, ingest.chunk_text(F.lit(long)))).split() == long.split()


def events(spark, rows):
    return spark.createDataFrame([(t, "user_input", ts, s, n, who, datetime(2024, 1, 1), i) for i, (t, ts, s, n, who) in enumerate(rows)], "text string, source string, ts string, session_id string, turn_id string, speaker string, ingested_at timestamp, seq long")


def test_replay_adds_nothing(spark):
    e = events(spark, [("Hello there.", "2024-01-01 10:00", "s", "t1", "Ann"), ("", None, "s", "t2", None), ("x. " * 400, None, "s", "t3", None)])
    m = store.conform(ingest.memory_chunks(e))
    assert store.insert_if_absent(m, m).count() == m.count() > 2
    first = m.where("turn_id = 't1'").first()
    assert first.content == "[2024-01-01 10:00] Ann: Hello there." and first.id.startswith("mem_") and len(first.id) == 16 and first.chunk_count == 1


def test_turns_give_date_speaker_and_text(spark):
    t = spark.createDataFrame([("Date: 8:56 pm on 20 July, 2023\nMelanie: Hi\nyou", None, "s", "t1", datetime(2024, 1, 1), 0), ("no prefix", "assistant", "s", "t2", datetime(2024, 1, 1), 1)], "content string, role string, session_id string, turn_id string, ingested_at timestamp, seq long")
    a, b = sorted(ingest.turn_events(t).collect(), key=lambda r: r.seq)
    assert (a.ts, a.speaker, a.text, a.source) == ("2023-07-20 20:56", "Melanie", "Hi\nyou", "user_input") and (b.ts, b.speaker, b.text, b.source) == (None, None, "no prefix", "assistant")


# --- retrieval


def test_a_rare_term_outweighs_a_common_one(spark):
    rows = [{"id": f"c{i}", "content": f"[2024-01-{i + 1:02d}] they dance at the dance hall number {i}"} for i in range(20)] + [{"id": "t", "content": "an ideal studio to dance in"}]
    b = retrieval.searchable(beliefs(spark, rows))
    g = spark.createDataFrame([("q", 0, "dance", True), ("q", 1, "ideal", True), ("q", 1, "hall number", False)], "query_id string, grp int, term string, direct boolean")
    s = {r.id: r.keyword_score for r in retrieval.keyword_scores(g, b, F.lit(21.0)).collect()}
    idf = lambda df: math.log(1 + 21 / df) / math.log(22)
    assert s["t"] == pytest.approx(idf(21) + idf(1)) and s["c3"] == pytest.approx(idf(21) + 0.3 * idf(20)) and s["t"] > 2 * s["c3"]


def test_words_match_whole_and_phrases_bounded(spark):
    b = retrieval.searchable(beliefs(spark, [{"id": "a", "content": "The dancer left"}, {"id": "b", "content": "C++ club, martial arts!"}, {"id": "c", "content": "martial artsy"}]))
    t = spark.createDataFrame([("dance",), ("martial arts",), ("dancer",)], "term string")
    assert {tuple(r) for r in retrieval.term_matches(t, b).collect()} == {("dancer", "a"), ("martial arts", "b")}


def row(i, **kw):
    base = {"id": i, "category": "premises", "content": i, "source": None, "relations": [], "embedding": None, "tokens": 10, "session_id": None, "turn_no": None, "chunk_index": 0, "event_id": None, "place": 1, "score": 0.5, "cosine": 0.5, "relevance": 0.5, "blacklisted": False, "lexicon_rank": None, "time": None, "distance": None, "fits": True}
    return base | kw


def test_duplicates_collapse_and_the_newer_wins_ties():
    e = [1.0, 0.0]
    rows = [row("old", embedding=e, cosine=0.9, time="2023-01-01 00:00"), row("far", embedding=[0.0, 1.0]), row("new", embedding=e, cosine=0.895, time="2024-01-01 00:00"), row("bare")]
    assert [r["id"] for r in retrieval.purge(rows)] == ["new", "far", "bare"]
    rows[2]["cosine"] = 0.8
    assert [r["id"] for r in retrieval.purge(rows)] == ["old", "far", "bare"]


def test_order_lexicon_blacklist_and_constituents(spark):
    rows = [row("low", score=0.1, place=1), row("high", score=0.9, place=2), row("seen", score=2.0, place=3, blacklisted=True), row("lex", score=0.2, place=4, lexicon_rank=2), row("out", place=None, lexicon_rank=1, score=0.0), row("whole", score=0.5, place=5, source="turn_synthesis", relations=["low"])]
    schema = "query_id string, id string, place int, score double, relevance double, blacklisted boolean, lexicon_rank int, source string, relations array<string>"

    def arranged(rows):
        df = spark.createDataFrame([("q", *[r[c.split()[0]] for c in schema.split(", ")[1:]]) for r in rows], schema)
        return [r.id for r in retrieval.arranged(df).orderBy("order").collect()]

    assert arranged(rows) == ["out", "lex", "high", "whole", "seen"]
    assert arranged([row(f"x{i}", place=None, lexicon_rank=i, score=0.0) for i in range(8)]) == ["x0", "x1", "x2", "x3", "x4"]
    some = [row(f"y{i}", place=i, lexicon_rank=i, score=i / 10) for i in range(1, 5)] + [row(f"x{i}", place=None, lexicon_rank=10 + i, score=0.0) for i in range(3)] + [row("gone", place=None, lexicon_rank=1, score=0.0, blacklisted=True)]
    assert arranged(some) == ["x0", "x1", "x2", "y4", "y3", "y2", "y1"]


def test_fill_skips_what_is_too_long_and_weaves_exchanges():
    t = Tunables(budget_means=4)
    rows = [row("a"), row("long", tokens=100, fits=False), row("b"), row("c"), row("d")]
    assert [r["id"] for r in retrieval.fill(rows, {}, 10.0, False, t)] == ["a", "b", "c", "d"]
    turn = lambda n, **k: row(f"t{n}", category="memory", session_id="s", turn_no=n, **k)
    near = {"t5": [turn(4, distance=1), turn(6, distance=1), turn(3, distance=2)]}
    got = [r["id"] for r in retrieval.fill([row("p"), turn(5), row("q")], near, 10.0, True, Tunables(budget_means=6))]
    assert got == ["p", "t3", "t4", "t5", "t6", "q"]
    got = [r["id"] for r in retrieval.fill([turn(5), row("p"), turn(6)], {"t5": [turn(4, distance=1)]}, 10.0, True, Tunables(budget_means=6))]
    assert got == ["t4", "t5", "t6", "p"]
    assert [r["id"] for r in retrieval.fill([row("huge", tokens=999)], {}, 10.0, False)] == ["huge"]


def test_injection_end_to_end(spark):
    s = HashedStore(16)
    rows = [{"content": f"[2024-01-01] fact number {i} on topic{i}", "id": f"b{i}", "embedding": s.embed_text(f"fact number {i} on topic{i}")} for i in range(40)]
    rows.append({"id": "tae", "content": "John trains twice a week", "aliases": ["martial arts"], "layer": 2, "term": "taekwondo", "embedding": s.embed_text("x")})
    inj = retrieval.Injector(beliefs(spark, rows), lambda text: [0.0] * 16)
    out = inj.inject("does he like martial arts or topic7", now="2024-06-01 12:00").split("\n")
    assert out[0] == "Current time: [2024-06-01 12:00]" and out[2] == "• John trains twice a week" and "topic7" in out[3] and "tae" in inj.recent and len(inj.recent) <= 15
    again = inj.inject("does he like martial arts or topic7", limit=1)
    assert "John" not in again and inj.inject("  ") == ""


def test_siblings_and_turns(spark):
    m = spark.createDataFrame([("a", "s", 1, "e", 0), ("b", "s", 2, "e", 1), ("c", "s", 4, "e", 3), ("d", "r", 2, "f", 1), ("x", None, 2, None, 1)], "id string, session_id string, turn_no int, event_id string, chunk_index int")
    assert {tuple(r) for r in retrieval.siblings(m, m).collect()} == {("a", "b"), ("b", "a")}
    assert {(r.anchor_id, r.id, r.distance) for r in retrieval.turn_neighbours(m, m, 2).collect()} == {("a", "b", 1), ("b", "a", 1), ("b", "c", 2), ("c", "b", 2)}


# --- learning and consolidation


def test_learning_is_idempotent(spark):
    seen = spark.createDataFrame([("Martial Arts", " Taekwondo", 1), ("martial arts", "taekwondo", 2), ("martial arts", "Judo", 3), ("!!", "x", 4), ("y", " ", 5)], "category string, instance string, seq long")
    none = spark.createDataFrame([], "category string, instance string, seq long")
    k = learning.learn_concepts(none, seen)
    assert learning.learn_concepts(k, seen).count() == 2 and learning.concept_expansions(k).first().instances == ["taekwondo", "judo"]
    rel = spark.createDataFrame([("John", "Friends", e, i) for i, e in enumerate(["Bob", "bob", "Cindy Lou", "two kids", "John", "BOB"])], "subject string, relation string, entity string, seq long")
    r = learning.learn_relations(spark.createDataFrame([], rel.schema), rel)
    assert learning.relation_expansions(r).first().relations == {"friends": ["Bob", "Cindy Lou"]}
    m = learning.merged_expansions({"hobby": ["chess"]}, {"tae": ["kick"]}, {"mood": ["calm"]})
    assert m["hobby"][-1] == "chess" and m["tae"] == ["kick"] and m["mood"] == ["calm"] and m["plan"] == DEFAULT_EXPANSIONS["plan"]


def test_cluster_thresholds(spark):
    b = beliefs(spark, [{"id": f"a{i}", "content": "tiny"} for i in range(10)] + [{"id": f"l{i}", "content": "w" * 300} for i in range(3)] + [{"id": "s", "content": "x"}])
    seen = spark.createDataFrame([("Maria", "Volunteering", f"a{i}", i) for i in range(10)] + [("Bob", "Sport", f"l{i}", i) for i in range(3)] + [("Eve", "Art", "s", 0), ("Eve", "Art", "lost", 1)], "subject string, category string, belief_id string, seq long")
    m = learning.tag_members(spark.createDataFrame([], "cluster_id string, belief_id string, seq long"), seen)
    done = spark.createDataFrame([], "cluster_id string")
    assert {r.cluster_id for r in learning.due_clusters(m, b, done).collect()} == {"cluster_maria_volunteering", "cluster_bob_sport"}
    done = spark.createDataFrame([("cluster_bob_sport",)], "cluster_id string")
    assert {r.cluster_id for r in learning.due_clusters(m, b, done).collect()} == {"cluster_maria_volunteering"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"facts": [{"content": "a"}, {"content": "b"}, {"con', {"facts": [{"content": "a"}, {"content": "b"}]}), ('[{"a": 1}, {"b"', [{"a": 1}]), ("nothing", None), ('{"facts": [{"cut', None), ("", None)],
)
def test_salvage(raw, want):
    assert consolidate.salvage(raw) == want


def test_tolerant_readers():
    assert consolidate.facts(["plain", "", 3]) == [{"content": "plain"}]
    f = consolidate.facts({"facts": [{"content": "a", "category": "sport", "subject": "Ann"}, {"content": " "}, "b", {"content": "c", "entities": ["Jo", ""], "relation": "kids", "subject": "D"}]})
    assert f == [{"content": "a", "subject": "Ann"}, {"content": "b"}, {"content": "c", "subject": "D", "entities": ["Jo"], "relation": "kids"}]
    assert consolidate.merges({"merged": [{"content": "x", "source_indices": [1, "2", "z", 3]}, {"content": "y", "source_indices": [1, 2]}]}) == [{"content": "x", "source_indices": [1, 2, 3]}]


def test_review_forms_beliefs_and_retries_failures(spark):
    e = events(spark, [("I love taekwondo.", "2024-01-02 10:00", "ok", "t1", "Ann"), ("See you.", "2024-01-03 10:00", "also", "t2", "Ann"), ("boom " * 15, None, "bad", "t1", None), ("garbled " * 10, None, "odd", "t1", None)])
    m = store.conform(ingest.memory_chunks(e))

    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError
        if "garbled" in prompt:
            return "not json"
        return '```json\n{"beliefs": [{"content": "Ann loves taekwondo.", "aliases": ["martial arts", ""], "term": "taekwondo", "source_indices": [1, 2, 99, "x"]}]}\n```'

    t = Tunables(review_tokens=19)  # undated rows come first, a batch each; then those of both sessions in time
    formed, done = consolidate.review(m, model, t)
    (r,) = formed.collect()
    assert r.content == "[2024-01-03 10:00] Ann loves taekwondo." and r.aliases == ["martial arts"] and len(r.memory_refs) == 2 and r.id.startswith("bel_nr_")
    left = consolidate.unreviewed(consolidate.stamp(m, done, F.lit("2024-06-01").cast("timestamp")))
    assert [x.session_id for x in left.collect()] == ["bad"]
    marked = m.withColumn("reviewed_at", F.when(F.col("session_id") == "ok", "").when(F.col("session_id") == "bad", "2024-06-01 00:00:00"))
    assert {x.session_id for x in consolidate.unreviewed(marked).collect()} == {"ok", "also", "odd"}


def test_batches_and_places_over_the_whole_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(40), rng.choice([0, 1, 5, 9, 30])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, t int, n int").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want, used, batch = {}, 0, 0
    for i, _, n in order:
        if used > 0 and used + n > 20:
            used, batch = 0, batch + 1
        used += n
        want[i] = batch
    assert {r.id: r.batch for r in ordering.next_fit(df, [F.asc("t"), F.asc("id")], F.col("n"), 20).collect()} == want
    assert {r.id: r.place for r in ordering.placed(df, [F.asc("t"), F.asc("id")]).collect()} == {r[0]: k for k, r in enumerate(order, 1)}
    assert ordering.next_fit(df.where("id < 0"), [F.asc("t")], F.col("n"), 20).count() == ordering.placed(df.where("id < 0"), [F.asc("t")]).count() == 0


def test_extraction_and_synthesis(spark):
    turns = spark.createDataFrame([("s", "Date: May 8, 2023\nAnn: I have a cat, a dog and a fox."), ("r", "")], "session_id string, content string")
    found = consolidate.extract(turns, lambda p: '{"facts": ["Ann has a cat", "Ann has a dog", {"content": "Ann has a fox", "category": "pets", "instance": "fox", "subject": "Ann"}]}')
    rows = found.collect()
    assert [r.content for r in rows] == [f"[2023-05-08] Ann has a {x}" for x in ("cat", "dog", "fox")] and rows[2].category == "pets"
    (s,) = consolidate.synthesise(found, lambda p: '{"merged": [{"content": "Ann has a cat, a dog and a fox", "source_indices": [1, 2, 3]}, {"content": "no", "source_indices": [1, 2, 99]}]}').collect()
    assert s.relations == [r.id for r in rows] and s.source == "turn_synthesis" and s.content.startswith("[2023-05-08] ")
    assert consolidate.synthesise(found, lambda p: "broken").count() == 0


def test_rollups_name_their_members(spark):
    b = beliefs(spark, [{"id": "a", "content": "x"}, {"id": "b", "content": "y"}])
    g = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "lost")], "key string, id string")
    (r,) = consolidate.rollups(g, b, lambda p: " together ", "bel_rollup_", "cluster_consolidation").collect()
    assert r.relations == ["a", "b"] and r.content == "together"

    def fails(prompt):
        raise RuntimeError

    assert consolidate.rollups(g, b, fails, "bel_rollup_", "cluster_consolidation").count() == 0


def test_dense_clusters():
    rng = np.random.default_rng(0)
    a, b = np.eye(12)[0] + 0.05 * rng.standard_normal((8, 12)), np.eye(12)[1] + 0.05 * rng.standard_normal((7, 12))
    labels = clusters.dense_clusters(np.concatenate([a, b, rng.standard_normal((4, 12)) * 3]), 3)
    assert len(set(labels[:8])) == 1 and len(set(labels[8:15])) == 1 and labels[0] != labels[8] and labels[0] >= 0 and labels[8] >= 0
    assert set(clusters.dense_clusters(rng.standard_normal((4, 3)), 5)) == {-1}


def test_clusters_by_subject(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, word in enumerate(("health", "cars")):
        rows += [{"id": f"{word}{i}", "content": f"[2024-01-01] Ann {word} {i}", "embedding": (np.eye(6)[k] + 0.03 * rng.standard_normal(6)).tolist()} for i in range(6)]
    rows += [{"id": "r", "content": "Ann rollup", "source": "cluster_consolidation", "embedding": [1.0] * 6}, {"id": "n", "content": "nobody", "embedding": [1.0] * 6}]
    got = clusters.subject_clusters(beliefs(spark, rows)).collect()
    assert {frozenset(r.id for r in got if r.cluster == c) for c in {r.cluster for r in got}} == {frozenset(f"{w}{i}" for i in range(6)) for w in ("health", "cars")}


def test_clusters_by_blocks_equal_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((9, 6))[rng.integers(0, 9, 150)] + 0.3 * rng.standard_normal((150, 6))
    x[100:120] = x[:20]  # equal points
    df = beliefs(spark, [{"id": f"i{i:03d}", "content": f"{'Ann' if i % 3 else 'Bob'} {i}", "embedding": v.tolist()} for i, v in enumerate(x)])
    monkeypatch.setattr(clusters, "BLOCK", 16)
    got = {(r.subject, r.id): r.cluster for r in clusters.subject_clusters(df).collect()}
    want = {}
    for name, some in (("Ann", [i for i in range(150) if i % 3]), ("Bob", list(range(0, 150, 3)))):
        want |= {(name, f"i{i:03d}"): c for i, c in zip(some, clusters.dense_clusters(np.float32(x[some]).astype(float), 5)) if c >= 0}
    assert got == want and len(set(want.values())) > 2
    groups = lambda rows, labels: {frozenset(rows[labels == c].tolist()) for c in set(labels.tolist()) - {-1}}
    order = rng.permutation(150)  # many distances are equal: in what order they are met changes nothing
    assert groups(np.arange(150), clusters.dense_clusters(x, 5)) == groups(order, clusters.dense_clusters(x[order], 5))


# --- compression


def chat(n, size=200):
    return [{"role": "user" if i % 2 == 0 else "assistant", "content": f"m{i} " + "x" * size} for i in range(n)]


def test_compression_window_and_divider():
    now = datetime(2024, 6, 1, 12)
    short, _ = compress.compress(chat(6), lambda p: "s", 10, now)
    assert short == chat(6)
    calm, _ = compress.compress(chat(36), lambda p: "s", 10**6, now)
    assert calm == chat(36)
    out, told = compress.compress(chat(36), lambda p: " what was said ", 800, now)
    assert out[:2] == chat(36)[:2] and out[2]["is_compressed_summary"] and out[2]["content"].endswith("what was said") and out[-1] == chat(36)[-1] and len(out) < 16 and told == "what was said"
    again, _ = compress.compress(out + chat(30), lambda p: p, 800, now)
    assert again[2]["content"].count("what was said") == 1
    messages = chat(8)
    messages[-1]["content"] = "Date: 2024-06-01 09:00\nbye"
    ended, _ = compress.compress(messages, lambda p: "s", 10**6, now, end=True)
    assert ended[-1]["is_session_divider"] and "3 hours, 0 minutes" in ended[-1]["content"] and "[Session Ended at: 2024-06-01 09:00]" in ended[-1]["content"]

    def fails(prompt):
        raise RuntimeError("down")

    assert "down" in compress.compress(chat(36), fails, 800, now)[0][2]["content"]


def test_tails_equal_the_loop(spark):
    rng, rows = random.Random(2), []
    for s in range(6):
        rows += [(str(s), i, "x" * rng.randint(0, 400)) for i in range(rng.randint(1, 40))]
    got = {r.session_id: r.tail_start for r in compress.tails(spark.createDataFrame(rows, "session_id string, pos int, content string")).collect()}
    for s in got:
        size = [max(1, len(c) // 4) if c else 0 for k, _, c in rows if k == s]
        n, start, used = len(size), len(size), 0
        for i in range(n - 1, 1, -1):
            if n - i > 10 or (used + size[i] > int(sum(size) * 0.10) and n - i > 1):
                break
            used, start = used + size[i], i
        assert got[s] == max(start, 3)


def test_context_limits(monkeypatch):
    monkeypatch.delenv("SYNAPTA_CONTEXT_LIMIT", raising=False)
    assert compress.context_limit(5) == 5 and compress.context_limit(model="gemini-x") == 1_000_000
    with pytest.raises(ValueError):
        compress.context_limit(model="unheard")
    monkeypatch.setenv("SYNAPTA_CONTEXT_LIMIT", "77")
    assert compress.context_limit() == 77


# --- sources


def test_profiles(spark, tmp_path):
    d = tmp_path / "soul"
    d.mkdir()
    (d / "me.md").write_text("# Identity\n- I am a helper\n- I was made in 2020\n## Voice, tone\n* Be kind always\n1. Be brief please\n# Rule\n---\n> **Law**: obey the rules\nno\n")
    (d / "p.json").write_text(json.dumps([{"category": "people", "content": "Ann is a friend", "confidence": 0.6}, "loose statement", {"text": "x"}]))
    (d / "bad.json").write_text("{ broken json here")
    (d / "x.bin").write_text("no")
    rows = importers.import_profiles(spark, str(d)).collect()
    by = {r.content: r for r in rows}
    assert by["I am a helper"].category == "premises" and by["Be kind always"].category == "preferences" and by["Law: obey the rules"].category == "propositions" and by["Ann is a friend"].confidence == 0.6 and "{ broken json here" in by
    assert len(rows) == 8 and {r.source for r in rows} == {"imported_hermes"} and json.loads(by["Be kind always"].extra)["heading"] == "Voice, tone"
    b = store.normalize(store.conform(spark.createDataFrame(rows)))
    assert store.insert_if_absent(b, b).count() == 8


def test_long_lines_and_code():
    s = importers.statements("```\na\nb\n```\n" + "First sentence here. " * 15)
    assert s[0] == "``` a b ```" and s[1:] == ["First sentence here."] * 15


def test_tools_and_skills(spark, tmp_path):
    t = spark.createDataFrame([('{"function": {"description": "Adds", "name": "add", "parameters": {"a": 1}}, "type": "function"}',), ('{"type": "other", "function": {"name": "no"}}',), ('{"type": "function", "function": {"description": "nameless"}}',)], "json string")
    (r,) = importers.import_function_tools(t).collect()
    assert (r.id, r.content) == ("tool_add", "Tool 'add': Adds") and json.loads(r.extra)["tool_name"] == "add"
    m = spark.createDataFrame([('{"tools": [{"name": "x", "description": "dx"}]}',), ('[{"name": "y", "description": "dy"}]',)], "json string")
    assert {x.id for x in importers.import_server_tools(m).collect()} == {"mcp_x", "mcp_y"}
    (tmp_path / "a.json").write_text('{"tool_name": "cook", "info": "Cooks"}')
    (tmp_path / "b.json").write_text('{"name": "half"}')
    (tmp_path / "c.json").write_text("broken")
    assert [x.id for x in importers.import_skills(spark, str(tmp_path)).collect()] == ["custom_skill_cook"]
    assert {x.id for x in importers.import_skills(spark, str(tmp_path), lambda p, s: (p[-6:-5], "d")).collect()} == {"custom_skill_a", "custom_skill_b", "custom_skill_c"}


def test_question_sets(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"conversation": {"session_1": [{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": "look", "blip_caption": "a cat"}], "session_1_date_time": "8:56 pm on 20 July, 2023"}}]))
    a, b = sorted(importers.sessions(spark, f"{tmp_path}/l.json").collect(), key=lambda r: r.turn)
    assert (a.speaker, a.text, a.date) == ("A", "hi", "2023-07-20 20:56") and b.text == "look [shares a cat]"
    (tmp_path / "h.json").write_text(json.dumps([{"question_id": "q", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "c"}]]}]))
    (r,) = importers.haystacks(spark, f"{tmp_path}/h.json").collect()
    assert (r.question_id, r.role, r.content, r.date) == ("q", "user", "c", "2023-05-20 02:21")


def test_vector_stores(spark, monkeypatch):
    monkeypatch.delenv("SYNAPTA_VECTOR_STORE", raising=False)
    s = create_vector_store("dummy", dimension=8)
    assert s.embed_text("a") == s.embed_text("a") != s.embed_text("b") and s.embed_text(" ") == [0.0] * 8
    for bad in (None, "unheard"):
        with pytest.raises(ValueError):
            create_vector_store(bad)
    with pytest.raises(ValueError):
        RemoteIndexStore()
    assert create_vector_store("http", url="http://127.0.0.1:9/x", dimension=3).embed_text("a") == [0.0] * 3
    df = s.embed(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, content string"))
    assert s.query_top_k(df, s.embed_text("b"), 1).first().id == "2"


def test_stores_need_what_they_need(spark):
    for name in ("chroma", "exact", "approximate"):
        with pytest.raises(ValueError, match="embedder"):
            create_vector_store(name)
    with pytest.raises(ImportError):
        create_vector_store("pinecone", api_key="k", index="i")

    class Client:
        def embed(self, text):
            return [1, 2]

        def upsert(self, rows):
            assert all(len(v) == 2 for _, v in rows)

        def query(self, vector, k):
            if vector[0] < 0:
                raise RuntimeError
            return [("b", 0.9), ("a", 0.5)][:k]

    r = create_vector_store("pinecone", api_key="k", index="i", client=Client())
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    new = r.add_vectors(table, spark.createDataFrame([("b", [1.0, 1.0]), ("c", [2.0, 0.0])], table.schema))
    assert {x.id: x.embedding for x in new.collect()} == {"a": [1.0, 0.0], "b": [1.0, 1.0], "c": [2.0, 0.0]}
    assert [tuple(x) for x in r.query_top_k(table, [1.0, 0.0], 1).collect()] == [("b", 0.9)] and r.query_top_k(table, [-1.0, 0.0]).count() == 0
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id long, embedding array<double>")
    assert {tuple(x) for x in r.query_many(table, q, 2).collect()} == {(1, "b", 0.9, 1), (1, "a", 0.5, 2)}


def test_failed_embeddings_are_null_and_tried_again(spark):
    s = HttpStore(url="http://127.0.0.1:9/x", dimension=3, tries=2, wait=0.0)
    assert s.embed_texts(["a", "b"]) == [None, None] and s.embed_text("a") == [0.0] * 3
    b = s.embed(beliefs(spark, [{"id": "x", "content": "text"}]).drop("embedding"))
    assert b.first().embedding is None
    again = knowledge.embedded(store.conform(b), ExactStore(lambda texts: [[float(len(t)), 1.0] for t in texts], 2))
    assert again.first().embedding == [4.0, 1.0]


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((40, 24))
    x = middle[rng.integers(0, 40, 4000)] + 0.7 * rng.standard_normal((4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(5)
    q = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    built = V.index(df, 32)
    assert built[0].count() == 4000
    exact = {(r.query_id, r.id) for r in V.top_k_join(q, df, 10).collect()}
    near = V.approximate_top_k_join(q, built, 10, 8).collect()
    found = {(r.query_id, r.id) for r in near}
    assert len(exact) == 800 and len(found & exact) / len(exact) >= 0.9 and all(r.query_id != r.id or r["rank"] == 1 for r in near)
    s = ApproximateStore(lambda texts: [[1.0] * 24 for _ in texts], 24, cells=32, probes=32).build(df)
    want = [r.id for r in V.top_k(df, x[7].tolist(), 5).collect()]
    assert [r.id for r in s.query_top_k(df, x[7].tolist(), 5).collect()] == want
    V.BROADCAST, before = 24 * 8 * 10, V.BROADCAST  # several passes
    try:
        assert {(r.query_id, r.id) for r in V.top_k_join(q, df, 10).collect()} == exact
    finally:
        V.BROADCAST = before


def test_token_counters():
    plain = TokenCounter("/nowhere")
    assert plain.describe()["backend"] == "heuristic" and plain.count("") == 0 and plain.count("abc") == 1 and plain.count("a" * 40) == 10
    assert plain.chat([{"role": "user", "content": "a" * 40, "name": "Ann"}]) == 3 + 3 + 1 + 10 + 1 + 1
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    c = TokenCounter(path)
    if c.describe()["backend"] == "bpe":
        assert c.count("hello world") == 2 and c.describe()["source"] == path


def test_times_of_every_kind(spark):
    now = F.lit("2024-06-01 12:30:00").cast("timestamp")
    e = spark.createDataFrame([("a", "8:56 pm on 20 July, 2023"), ("b", "2024-01-02 10:00"), ("c", None), ("d", "some day")], "text string, ts string").withColumns({"source": F.lit("s"), "session_id": F.lit("x"), "turn_id": F.lit("1"), "speaker": F.lit(None).cast("string"), "ingested_at": now, "seq": F.lit(0)})
    got = {r.content for r in ingest.memory_chunks(e, now=now).collect()}
    assert got == {"[2023-07-20 20:56] a", "[2024-01-02 10:00] b", "[2024-06-01 12:30] c", "[some day] d"}
    (r,) = ingest.memory_chunks(e.where("text = 'a'").withColumn("ts", now), now=now).collect()
    assert r.content == "[2024-06-01 12:30] a"


def test_tag_counts(spark):
    (r,) = spark.createDataFrame([(["[person]", "[event]", "[person]"],)], "t array<string>").select(nlp.tag_counts("t").alias("n")).collect()
    assert r.n == {"[person]": 2, "[event]": 1}


# --- passes over all that is known


def test_turns_are_extracted_merged_and_learned_from(spark):
    def fact_model(prompt):
        """Each line of the prompt as a fact about the one who says it."""
        if "summary" in prompt or "in common" in prompt:
            return "They have much in common."
        if "parallel items" in prompt:
            return '{"merged": []}'
        out = []
        for line in prompt.split("\n")[1:]:
            if ": " in line and not line.startswith("State"):
                who, said = line.split(": ", 1)
                f = {"content": f"{who} says {said}", "subject": who, "category": "Habits", "instance": said.split()[-1]}
                if "dances" in said:
                    f |= {"relation": "friends", "entities": ["Bob", "two kids"]}
                out.append(f)
        return json.dumps({"facts": out})

    now = F.lit("2024-06-01").cast("timestamp")
    vectors = HashedStore(16)
    said = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda mu", "nu xi omicron", "pi rho sigma", "tau upsilon phi", "chi psi omega", "dances some tango", "one two three"]
    turns = spark.createDataFrame([("s", "Date: May 8, 2023\n" + "\n".join(f"Ann: {x}" for x in said)), ("s2", ""), ("s3", None)], "session_id string, content string")
    k, counts = knowledge.add_turns(knowledge.empty(spark), turns, fact_model, vectors, now)
    rows = {r.content: r for r in k.beliefs.collect()}
    assert counts["facts"] == 10 and "[2023-05-08] Ann says alpha beta gamma" in rows
    rollup = [r for r in rows.values() if r.source == "cluster_consolidation"]
    assert len(rows) == 11 and len(rollup) == 1 and len(rollup[0].relations) == 10 and all(len(r.embedding) == 16 for r in rows.values() if r.source != "cluster_consolidation")
    assert {tuple(r)[:2] for r in k.concepts.collect()} == {("habits", x.split()[-1]) for x in said} and [tuple(r)[:3] for r in k.relations.collect()] == [("ann", "friends", "Bob")]
    assert knowledge.is_consolidated(k, "Ann", "habits") and not knowledge.is_consolidated(k, "Bob", "habits") and knowledge.cluster_members(k, "Ann", "Habits").count() == 10
    # the same turns again: facts are verified, nothing is added, no second rollup
    again, _ = knowledge.add_turns(k, turns, fact_model, vectors, now)
    assert again.beliefs.count() == 11 and again.concepts.count() == 10 and again.members.count() == 10
    assert {r.verifications for r in again.beliefs.where("source <> 'cluster_consolidation'").collect()} == {2.0}
    # what was learned widens queries
    synced, words = knowledge.sync(again, vectors)
    assert ("habits", "tango") in {tuple(r) for r in words.collect()} and synced.beliefs.where("embedding is null").count() == 0
    q = spark.createDataFrame([("q", "any habits", [0.0] * 16, [])], "query_id string, text string, query_embedding array<double>, blacklist array<string>")
    groups = retrieval.analyse(q, words)[1]
    assert ("tango", False) in {(r.term, r.direct) for r in groups.collect()}
    index = knowledge.Index(vectors)
    assert index.get(again, 1) is index.get(again, 1) and index.get(again, 1) is not index.get(again, 2)


def test_a_nightly_review_stamps_merges_and_learns(spark, tmp_path):
    now = F.lit("2024-06-01").cast("timestamp")
    vectors = HashedStore(16)
    e = events(spark, [(f"excerpt number {i} of the record", f"2024-01-{i + 1:02d} 10:00", "s", f"t{i}", None) for i in range(6)] + [("boom", "2024-02-01 10:00", "r", "t1", None)])
    k = knowledge.empty(spark)
    memory = store.normalize(ingest.memory_chunks(e))
    from dataclasses import replace

    k = replace(k, beliefs=k.beliefs.unionByName(memory))

    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError
        return '{"beliefs": [{"content": "Ann keeps a record.", "term": "record", "aliases": ["diary"], "source_indices": [1, 2], "category": "Hobbies", "instance": "Writing", "subject": "Ann"}]}'

    k, stats = knowledge.nightly_review(k, model, vectors, now, Tunables(review_tokens=26))
    assert (stats["pending"], stats["reviewed"], stats["batches"], stats["formed"]) == (7, 6, 3, 3) and stats["tokens_in"] > stats["tokens_out"] > 0
    formed = k.beliefs.where("source <> 'user_input' or source is null").where("category = 'premises'").collect()
    assert all(r.layer == 2 and r.term == "record" and len(r.memory_refs) >= 2 for r in formed) and k.concepts.count() == 1
    left, none = knowledge.nightly_review(k, model, vectors, now, Tunables(review_tokens=26))
    assert none["pending"] == 1 and none["reviewed"] == 0
    folder = str(tmp_path / "known")
    knowledge.save(left, folder)
    back = knowledge.load(spark, folder)
    assert back.beliefs.count() == left.beliefs.count() and back.members.count() == left.members.count() and back.structural.count() == 0


def test_dense_clusters_are_rolled_up_once(spark):
    rng = np.random.default_rng(1)
    health, cars = np.eye(8)[0] * 5, np.eye(8)[1] * 5
    rows = [{"id": f"h{i}", "content": f"Maria health {i}", "embedding": (health + 0.1 * rng.standard_normal(8)).tolist()} for i in range(5)]
    rows += [{"id": f"c{i}", "content": f"Maria cars {i}", "embedding": (cars + 0.1 * rng.standard_normal(8)).tolist()} for i in range(5)]
    rows += [{"id": f"n{i}", "content": f"Maria noise {i}", "embedding": rng.standard_normal(8).tolist()} for i in range(3)]
    from dataclasses import replace

    k = replace(knowledge.empty(spark), beliefs=store.conform(beliefs(spark, rows)))
    t = Tunables(min_cluster_size=3)
    k, stats = knowledge.discover_clusters(k, lambda p: "All alike.", HashedStore(8), t)
    assert stats["subjects_scanned"] == 1 and stats["clusters_found"] >= 2 and stats["rollups_created"] == stats["clusters_found"]
    rolled = [set(r.members) for r in knowledge.structural_clusters(k).collect()]
    assert any({f"h{i}" for i in range(5)} <= m for m in rolled) and any({f"c{i}" for i in range(5)} <= m for m in rolled)
    assert {r["id"] for r in rows} <= {r.id for r in k.beliefs.collect()}
    again, stats = knowledge.discover_clusters(k, lambda p: "All alike.", HashedStore(8), t)
    assert stats["rollups_created"] == 0 and again.beliefs.count() == k.beliefs.count()
