"""Which beliefs go into a prompt: candidates, fusion, order and budget, for many queries at once.

Everything that touches the belief table is joins and aggregates on narrow rows; contents are joined to what was picked,
neighbours to the few anchors. Two steps, whose choices depend on the ones before, run in Python on the hundred or so
candidates of each query: near-duplicates, and the weaving of neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.nlp import keywords_udf, tags_udf
from ..lineage import SMALL, checkpointed, sized
from ..schema import Tunables
from . import learning

_WORDS = r"(?U)(\w+)"
#: Matches of a belief's terms with queries' that one task sums up.
MET = 1_000_000


def searchable(beliefs: DataFrame) -> DataFrame:
    """Beliefs that retrieval looks at, with body, tokens, turn number and time."""
    time = F.date_format(X.prefix_time("content"), "yyyy-MM-dd HH:mm")
    return beliefs.where(F.col("category") != "concepts").withColumns({"body": F.lower(X.strip_prefix("content")), "tokens": X.token_count("content"), "turn_no": X.turn_number("turn_id"), "time": time})


def postings(beliefs: DataFrame, text: str = "body") -> DataFrame:
    """(word, id) of every distinct word of every belief: the index that makes a term's cost its matches."""
    words = F.filter(F.array_distinct(F.split(text, r"[^\p{L}\p{M}\p{N}_]+")), lambda w: w != "")
    return beliefs.select("id", F.explode(words).alias("word"))


def _pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), F.regexp_replace(term, r"([^\w\s])", r"\\$1"), F.lit(r"\b"))


def term_matches(terms: DataFrame, beliefs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(term, id) of beliefs that hold the term between word boundaries: an equi-join on the term's first word, then the pattern for phrases.

    words: the beliefs' ``postings``, if they are there already.
    """
    t = sized(checkpointed(terms.select("term").distinct().withColumn("word", F.regexp_extract("term", _WORDS, 1)).where("word <> ''")), 100)
    words = postings(beliefs) if words is None else words
    single = t.where("term = word").select("term", "word").join(words, "word").select("term", "id")
    phrases = t.where("term <> word").join(words, "word").join(beliefs.select("id", "body"), "id").where(F.regexp_like("body", _pattern(F.col("term"))))
    return single.unionByName(phrases.select("term", "id"))


def idf(matches: DataFrame, n: Column) -> DataFrame:
    """(term, df, idf): ln(1 + N / df) / ln(1 + N)."""
    return matches.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log1p(n / F.col("df")) / F.log1p(n))


def keyword_scores(groups: DataFrame, beliefs: DataFrame, n: Column, t: Tunables = Tunables(), words: DataFrame | None = None) -> DataFrame:
    """(query_id, id, keyword_score) where above 0: per group the best term's rarity, direct or expanded, summed over groups.

    groups: (query_id, grp, term, direct).
    """
    m = checkpointed(term_matches(groups, beliefs, words))  # counted, then joined; the count is aggregated before it is shuffled
    weighted = groups.join(idf(m, n), "term").withColumn("weight", F.col("idf") * F.when(F.col("direct"), 1.0).otherwise(t.expanded_weight))
    weighted = checkpointed(weighted.select("query_id", "grp", "term", "weight", "df"))
    met = weighted.agg(F.sum("df")).first()[0] or 0
    # a belief's terms come to one task, which sums up all that they meet: the pairs aren't shuffled, and a task has about MET of them
    m = m.repartition(max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // MET)), "id")
    best = m.join(F.broadcast(weighted.drop("df")), "term") if weighted.count() * 60 <= SMALL else m.join(weighted.drop("df"), "term")
    return best.groupBy("id", "query_id", "grp").agg(F.max("weight").alias("best")).groupBy("query_id", "id").agg(F.sum("best").alias("keyword_score"))


def tag_overlap(query_tags, belief_tags) -> Column:
    """The sum over tags of the lesser of the two counts."""
    q, b = F.coalesce(X.col(query_tags), F.array().cast("array<string>")), F.coalesce(X.col(belief_tags), F.array().cast("array<string>"))
    count = lambda a, tag: F.size(F.filter(a, lambda x: x == tag))
    return F.aggregate(F.array_distinct(q), F.lit(0), lambda s, tag: s + F.least(count(q, tag), count(b, tag)))


def fused(cosine, nudge, keyword, tag) -> Column:
    """Cosine with logarithmic boosts for keywords and, half as much, tags."""
    return X.col(cosine) + X.col(nudge) * F.log1p(X.col(keyword)) + 0.5 * X.col(nudge) * F.log1p(X.col(tag))


def nudge(cosine, window=None) -> Column:
    """A weight from the spread of similarities: 1.5 population deviations, within 0.01 and 0.10."""
    spread = F.stddev_pop(cosine)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.10), 1.5 * (spread if window is None else spread.over(window))))


def lexicon_matches(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, id, lexicon_rank) of beliefs whose term or alias is in the query: single words by stem, phrases between boundaries."""
    w = Window.partitionBy("key")
    lex = lexicon.select("key", "id", "seq", F.min(F.struct("seq", "key_no")).over(w).alias("at"))
    words = queries.select("query_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select("query_id", X.stem(F.regexp_replace("w", r"(?U)[^\w]", "")).alias("s")).where("s <> ''").distinct()
    single = lex.where(~F.col("key").contains(" ")).withColumn("s", X.stem("key")).join(words, "s")
    first = queries.select("query_id", F.lower("text").alias("low"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), 1))).alias("word"))
    phrases = lex.where(F.col("key").contains(" ")).withColumn("word", F.regexp_extract("key", _WORDS, 1)).join(first, "word").where(F.regexp_like("low", _pattern(F.col("key"))))
    cols = ["query_id", "id", "at", "seq"]
    hit = single.select(*cols).unionByName(phrases.select(*cols)).groupBy("query_id", "id").agg(F.min(F.struct("at", "seq")).alias("at"))
    return hit.withColumn("lexicon_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))).drop("at")


def turn_neighbours(anchors: DataFrame, memory: DataFrame, window: int, few=lambda a: a) -> DataFrame:
    """(anchor_id, id, distance, after) of chunks in turns of the same session up to ``window`` away: an equi-join on session and exact turn."""
    a = anchors.where("session_id is not null and turn_no is not null").select(F.col("id").alias("anchor_id"), "session_id", F.col("turn_no").alias("at"))
    steps = F.explode(F.array(*[F.lit(d) for d in range(-window, window + 1) if d])).alias("step")
    a = a.distinct().select("anchor_id", "session_id", "at", steps).withColumn("turn_no", F.col("at") + F.col("step"))
    return few(a).join(memory.where("session_id is not null and turn_no is not null"), ["session_id", "turn_no"]).select("anchor_id", "id", F.abs("step").alias("distance"), (F.col("step") > 0).alias("after"))


def siblings(anchors: DataFrame, memory: DataFrame, few=lambda a: a) -> DataFrame:
    """(anchor_id, id) of chunks just before and after in the same event."""
    a = anchors.where("event_id is not null and chunk_index is not null").select(F.col("id").alias("anchor_id"), "event_id", F.col("chunk_index").alias("at")).distinct()
    a = a.select("anchor_id", "event_id", F.explode(F.array(F.col("at") - 1, F.col("at") + 1)).alias("chunk_index"))
    return few(a).join(memory, ["event_id", "chunk_index"]).select("anchor_id", "id")


def without_constituents(pool: DataFrame) -> DataFrame:
    """The pool, (query_id, id, source, relations), without beliefs that a merged one in the same pool names."""
    named = pool.where("source = 'turn_synthesis'").select("query_id", F.explode("relations").alias("id")).distinct()
    return pool.join(named, ["query_id", "id"], "left_anti")


def analyse(queries: DataFrame, expansions: dict[str, list[str]] | DataFrame, t: Tunables = Tunables()) -> tuple[DataFrame, DataFrame]:
    """(queries with query_tags, groups) from (query_id, text): keywords, each with the vocabulary, a map or a table (trigger, term), that its words trigger."""
    spark = queries.sparkSession
    q = queries.withColumns({"query_tags": tags_udf()("text"), "keywords": keywords_udf(t.max_keywords)("text")})
    kw = q.select("query_id", F.posexplode("keywords").alias("grp", "keyword")).withColumn("keyword", F.lower("keyword"))
    direct = kw.select("query_id", "grp", F.col("keyword").alias("term"), F.lit(True).alias("direct"))
    vocabulary = spark.createDataFrame([(k, w.lower()) for k, ws in expansions.items() for w in ws], "trigger string, term string") if isinstance(expansions, dict) else expansions
    vocabulary = vocabulary.withColumn("word", F.regexp_extract("trigger", _WORDS, 1))
    words = kw.select("query_id", "grp", "keyword", F.explode(F.array_distinct(F.regexp_extract_all("keyword", F.lit(_WORDS), 1))).alias("word"))
    more = words.join(vocabulary, "word").where(F.regexp_like("keyword", _pattern(F.col("trigger")))).where("term <> keyword").select("query_id", "grp", "term").distinct()
    return q.drop("keywords"), direct.unionByName(more.withColumn("direct", F.lit(False)))


def popular(beliefs: DataFrame, k: int) -> DataFrame:
    """The k most relevant beliefs, the oldest first among equals."""
    return beliefs.orderBy(F.desc("relevance"), "seq").limit(k)


def by_keywords(queries: DataFrame, scores: DataFrame, beliefs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, place) of each query's k best by keyword score, then relevance; beliefs without a match are the same for all queries."""
    light = beliefs.select("id", "relevance", "seq")
    hits = _foremost(scores.join(sized(light, 40), "id").select("query_id", "id", F.col("keyword_score").cast("double").alias("keyword_score"), F.col("relevance").cast("double").alias("relevance"), "seq"), k)
    # a match that isn't among a task's foremost comes after k others, and so it does without its score
    rest = queries.select("query_id").crossJoin(F.broadcast(popular(light, k))).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("keyword_score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), F.desc("relevance"), "seq")
    return hits.unionByName(rest.select(*hits.columns)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "id", "place")


def _foremost(hits: DataFrame, k: int) -> DataFrame:
    """Of each task's rows (query_id, id, keyword_score, relevance, seq) the k that come first for each query: no more are shuffled."""

    def best(parts: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(parts).sort_by([("query_id", "ascending"), ("keyword_score", "descending"), ("relevance", "descending"), ("seq", "ascending")])
        run = t.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.diff(run, prepend=-1))
        return t.filter(pa.array(np.arange(len(run)) - np.repeat(new, np.diff(np.append(new, len(run)))) < k))

    def run(batches):
        held, waiting, kept = [], 0, 0
        for b in batches:
            held.append(b)
            waiting += len(b)
            if waiting > 2 * kept + 500_000:
                held = best(held).combine_chunks().to_batches()
                waiting = kept = sum(map(len, held))
        if waiting:
            yield from best(held).to_batches(max_chunksize=20_000)

    return hits.mapInArrow(run, hits.schema)


def united(by_words: DataFrame, by_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, place): each list's members once, where they first appear; the second list, (query_id, id, rank), follows the first k places."""
    second = by_vectors.select("query_id", "id", (F.col("rank") + k).alias("place"))
    return by_words.select("query_id", "id", "place").unionByName(second).groupBy("query_id", "id").agg(F.min("place").alias("place"))


def scored(pool: DataFrame) -> DataFrame:
    """Add nudge and score to candidates (query_id, cosine, keyword_score, tag_score)."""
    return pool.withColumn("nudge", nudge("cosine", Window.partitionBy("query_id"))).withColumn("score", fused("cosine", "nudge", "keyword_score", "tag_score"))


def _by_score() -> list[Column]:
    return [F.col("blacklisted"), F.desc(F.round("score", 9)), F.desc(F.coalesce("relevance", F.lit(0.0))), F.col("place")]


def ranked(pool: DataFrame) -> DataFrame:
    """Add pool_rank: what was injected lately comes last, then score, relevance and first appearance decide."""
    return pool.withColumn("pool_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_by_score())))


#: What retrieval carries of a belief until it is picked.
_NARROW = ["id", "category", "source", "relations", "conceptual_tags", "embedding", "tokens", "relevance", "seq", "session_id", "turn_no", "chunk_index", "event_id", "time"]


def candidates(queries: DataFrame, groups: DataFrame, beliefs: DataFrame, t: Tunables = Tunables(), words: DataFrame | None = None) -> DataFrame:
    """The union of each query's best by keywords and by vectors, with all scores and the order of first appearance.

    queries: (query_id, query_embedding, query_tags, blacklist); beliefs as ``searchable`` makes them.
    """
    one = beliefs.agg(F.count("*").alias("n_beliefs"), F.avg("tokens").alias("mean_tokens"), F.max(F.coalesce(F.col("category") == "memory", F.lit(False))).alias("has_memory")).first()  # a single row of totals
    n = one["n_beliefs"]
    k = max(30, min(60, int(0.10 * n)))
    scores = checkpointed(keyword_scores(groups, beliefs, F.lit(float(max(1, n))), t, words))
    near = V.top_k_join(queries.select("query_id", F.col("query_embedding").alias("embedding")), beliefs, k)
    pool = sized(checkpointed(united(by_keywords(queries, scores, beliefs, k), near, k)), 60)
    pool = pool.join(beliefs.select(*_NARROW), "id").join(queries, "query_id").join(scores, ["query_id", "id"], "left")
    pool = pool.withColumns({"keyword_score": F.coalesce("keyword_score", F.lit(0.0)), "tag_score": tag_overlap("query_tags", "conceptual_tags"), **_against_query()})
    return scored(pool).select("query_id", *_NARROW, "place", "score", "cosine", "blacklisted", F.lit(float(one["mean_tokens"] or 30.0)).alias("mean_tokens"), F.lit(bool(one["has_memory"])).alias("has_memory"))


def _against_query() -> dict[str, Column]:
    return {"cosine": F.coalesce(V.cosine("query_embedding", "embedding"), F.lit(0.0)), "blacklisted": F.coalesce(F.array_contains("blacklist", F.col("id")), F.lit(False))}


def arranged(rows: DataFrame, t: Tunables = Tunables()) -> DataFrame:
    """Add ``order``: lexicon hits first, up to ``max_lexicon``, those from outside the pool before those of the pool; then the pool by score.

    Rows (query_id, id, place, score, relevance, blacklisted, lexicon_rank, source, relations); place is null outside the pool.
    Constituents of merged beliefs go.
    """
    w = Window.partitionBy("query_id")
    outside = F.col("place").isNull()
    pool = w.orderBy(outside, *_by_score())
    lexical = ~outside & F.col("lexicon_rank").isNotNull() & ~F.col("blacklisted")
    r = rows.where(~(outside & F.col("blacklisted")))
    r = r.withColumns({"n_out": F.sum(outside.cast("int")).over(w), "pool_rank": F.row_number().over(pool), "n_lexical": F.sum(lexical.cast("int")).over(pool), "out_rank": F.row_number().over(w.orderBy(~outside, "lexicon_rank", "id"))})
    r = r.withColumn("section", F.when(outside, 0).when(lexical & (F.col("n_out") + F.col("n_lexical") <= t.max_lexicon), 1).otherwise(2)).where((F.col("section") > 0) | (F.col("out_rank") <= t.max_lexicon))
    r = r.withColumn("order", F.row_number().over(w.orderBy("section", F.when(F.col("section") == 0, F.col("out_rank")).otherwise(F.col("pool_rank")))))
    return without_constituents(r.drop("n_out", "pool_rank", "n_lexical", "out_rank", "section"))


def purge(rows: list[dict], t: Tunables = Tunables()) -> list[dict]:
    """Collapse near-identical candidates, in order: each joins the first group whose current survivor is similar enough."""
    has = [r["embedding"] is not None and len(r["embedding"]) > 0 for r in rows]
    at = {i: n for n, i in enumerate(i for i, h in enumerate(has) if h)}
    unit = np.array([np.asarray(rows[i]["embedding"], np.float32) for i in at]) if at else np.zeros((0, 1), np.float32)
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, norm, out=unit, where=norm > 0)
    alike = unit @ unit.T >= t.duplicate_similarity
    kept: list[dict] = []
    place: list[int] = []  # which of the kept have a vector
    vector = np.zeros(len(at), np.int64)  # and where it is
    for i, r in enumerate(rows):
        if not has[i]:
            kept.append(r)
            continue
        near = np.flatnonzero(alike[at[i], vector[: len(place)]])
        if not len(near):
            vector[len(place)] = at[i]
            place.append(len(kept))
            kept.append(r)
            continue
        first = int(near[0])
        old = kept[place[first]]
        gain, newer = r["cosine"] - old["cosine"], (r["time"] or "") > (old["time"] or "")
        if gain > t.duplicate_margin or (abs(gain) <= t.duplicate_margin and newer):
            kept[place[first]], vector[first] = r, at[i]
    return kept


def fill(rows: list[dict], near: dict[str, list[dict]], mean_tokens: float, has_memory: bool, t: Tunables = Tunables()) -> list[dict]:
    """What ``fits`` (``first_fit`` of the budget's first part), neighbours of the first raw chunks, then what else there is room for, exchanges in order."""
    most = min(t.budget_means * mean_tokens, t.ceiling)
    chosen, over = [r for r in rows if r["fits"]], [r for r in rows if not r["fits"]]
    used = sum(r["tokens"] for r in chosen)
    taken = {r["id"] for r in chosen}
    anchors = [r for r in chosen if r["category"] == "memory"][: t.anchors] if has_memory else []
    reach = {a["id"]: t.turn_window if i else t.top_turn_window for i, a in enumerate(anchors)}
    added: dict[str, list[dict]] = {}
    for a in anchors:
        for m in near.get(a["id"], []):
            if m["distance"] <= reach[a["id"]] and m["id"] not in taken and used + m["tokens"] <= most:
                added.setdefault(a["id"], []).append(m)
                taken.add(m["id"])
                used += m["tokens"]
    for r in over:
        if r["id"] not in taken:
            if used + r["tokens"] > most:
                break
            chosen.append(r)
            taken.add(r["id"])
            used += r["tokens"]
    # an anchor's exchange stands together, in the order in which it was said
    group_of: dict[str, str] = {}
    groups: dict[str, list[dict]] = {}
    for a in anchors:
        if a["id"] in group_of:
            continue
        members = [a, *added.get(a["id"], [])]
        if a["turn_no"] is not None:
            for r in chosen:
                same = r["id"] != a["id"] and r["id"] not in group_of and r["category"] == "memory" and r["session_id"] == a["session_id"]
                if same and r["turn_no"] is not None and abs(r["turn_no"] - a["turn_no"]) <= reach[a["id"]]:
                    members.append(r)
        if len(members) > 1:
            groups[a["id"]] = sorted(members, key=lambda m: (m["turn_no"] or 0, m["chunk_index"] or 0))
            group_of |= {m["id"]: a["id"] for m in members}
    out, done = [], set()
    for r in chosen:
        for m in groups[group_of[r["id"]]] if r["id"] in group_of else [r]:
            if m["id"] not in done:
                done.add(m["id"])
                out.append(m)
    return out


_CARRIED = ["id", "category", "tokens", "session_id", "turn_no", "chunk_index", "event_id", "mean_tokens", "has_memory"]


def _records(pdf: pd.DataFrame) -> list[dict]:
    return [{k: (None if not isinstance(v, (list, np.ndarray)) and pd.isna(v) else v) for k, v in r.items()} for r in pdf.to_dict("records")]


def _purge(t: Tunables):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [r["__n"] for r in purge(_records(pdf.sort_values("order").assign(__n=lambda d: d.index)), t)]
        out = pdf.loc[kept, ["query_id", *_CARRIED]]
        return out.assign(pos=range(1, len(out) + 1))

    return run


def _weave(t: Tunables):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _records(pdf)
        near: dict[str, list[dict]] = {}
        for r in sorted((r for r in rows if r["anchor_id"] is not None), key=lambda r: (r["distance"], bool(r["after"]), r["chunk_index"] or 0, r["seq"])):
            if r["id"] not in {m["id"] for m in near.get(r["anchor_id"], [])}:
                near.setdefault(r["anchor_id"], []).append(r)
        own = sorted((r for r in rows if r["anchor_id"] is None), key=lambda r: r["pos"])
        picked = fill(own, near, own[0]["mean_tokens"], bool(own[0]["has_memory"]), t) if own else []
        return pd.DataFrame({"query_id": [str(pdf["query_id"].iloc[0])] * len(picked), "pos": range(1, len(picked) + 1), "id": [r["id"] for r in picked]})

    return run


def first_parts(survivors: DataFrame, t: Tunables = Tunables()) -> DataFrame:
    """(query_id, row, fits, anchor) of survivors in order: what the first part of the budget takes, and which are the anchors (1, 2, ...; null for others)."""
    most = F.least(F.lit(t.budget_means) * F.col("mean_tokens"), F.lit(t.ceiling))
    base = F.when(F.col("has_memory"), most * (1 - t.reserve)).otherwise(most)
    g = survivors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", *_CARRIED))).alias("rows"), F.first(base).alias("base"), F.first("has_memory").alias("has"))
    g = g.withColumn("fits", first_fit(F.transform("rows", lambda r: r["tokens"]), F.col("base")))
    ids = F.transform(F.filter(F.arrays_zip("rows", "fits"), lambda z: z["fits"] & (z["rows"]["category"] == "memory")), lambda z: z["rows"]["id"])
    g = g.withColumn("anchors", F.when(F.col("has"), F.slice(ids, 1, t.anchors)).otherwise(F.array().cast("array<string>")))
    z = g.select("query_id", "anchors", F.explode(F.arrays_zip("rows", "fits")).alias("z")).select("query_id", F.col("z.rows").alias("row"), F.col("z.fits").alias("fits"), "anchors")
    return z.select("query_id", "row", "fits", F.nullif(F.array_position("anchors", F.col("row.id")), F.lit(0)).alias("anchor"))


@dataclass(frozen=True)
class Prepared:
    """A belief table as retrieval reads it: written once, for many batches of queries."""

    beliefs: DataFrame
    words: DataFrame
    lexicon: DataFrame


def prepare(beliefs: DataFrame, t: Tunables = Tunables()) -> Prepared:
    """What all queries need of the beliefs: derived columns, the postings of their words, the lexicon."""
    b = checkpointed(searchable(beliefs))
    return Prepared(b, checkpointed(postings(b)), checkpointed(learning.lexicon(beliefs, t)))


def retrieve(queries: DataFrame, beliefs: DataFrame | Prepared, expansions: dict[str, list[str]] | DataFrame | None = None, t: Tunables = Tunables()) -> DataFrame:
    """(query_id, pos, id, content) of what goes into each query's context.

    queries: (query_id, text, query_embedding, blacklist). Blank texts get nothing. beliefs: the table, or ``prepare`` of it.
    expansions: the vocabulary that ``knowledge.sync`` gives; without it, what is built in and the lexicon of ``beliefs``.
    """
    p = beliefs if isinstance(beliefs, Prepared) else Prepared(searchable(beliefs), None, learning.lexicon(beliefs, t))
    b, lex = p.beliefs, p.lexicon
    queries = queries.where(F.trim("text") != "").withColumn("query_id", F.col("query_id").cast("string"))
    if expansions is None:
        built_in = [(k, w.lower()) for k, ws in learning.DEFAULT_EXPANSIONS.items() for w in ws]
        expansions = b.sparkSession.createDataFrame(built_in, "trigger string, term string").unionByName(lex.select(F.col("key").alias("trigger"), F.explode("words").alias("term"))).distinct()
    q, groups = analyse(queries, expansions, t)
    q = q.select("query_id", "query_embedding", "query_tags", "blacklist")
    q, groups = checkpointed(q), checkpointed(groups)  # taggers run once
    pool = checkpointed(candidates(q, groups, b, t, p.words))
    lexical = checkpointed(lexicon_matches(queries, lex))
    totals = pool.groupBy("query_id").agg(F.max("mean_tokens").alias("mean_tokens"), F.max("has_memory").alias("has_memory"))
    outside = sized(checkpointed(lexical.join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")), 60)
    extra = outside.join(b.select(*_NARROW), "id").join(q, "query_id").join(totals, "query_id")
    extra = extra.withColumns({"place": F.lit(None).cast("int"), "score": F.lit(0.0), **_against_query()})
    pool = pool.join(lexical, ["query_id", "id"], "left")
    rows = arranged(pool.unionByName(extra.select(*pool.columns)), t)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("query_id", *_CARRIED).schema)
    survivors = rows.select("query_id", *_CARRIED, "order", "embedding", "cosine", "time").groupBy("query_id").applyInPandas(_purge(t), f"{schema}, pos int")
    parts = checkpointed(first_parts(survivors, t))
    own = parts.select("query_id", "row.*", "fits")
    memory = b.where("category = 'memory'").select("id", "category", "tokens", "session_id", "turn_no", "chunk_index", "event_id", "seq")
    anchors = parts.where("anchor is not null").select("query_id", "row.*")
    few = lambda a: sized(checkpointed(a), 200)
    turns = turn_neighbours(anchors, memory, max(t.turn_window, t.top_turn_window), few)
    beside = siblings(anchors, memory, few).withColumns({"distance": F.lit(0), "after": F.lit(False)})
    found = few(turns.unionByName(beside))
    near = found.join(memory, "id").join(anchors.select("query_id", F.col("id").alias("anchor_id")), "anchor_id")
    woven = own.unionByName(near, allowMissingColumns=True).groupBy("query_id").applyInPandas(_weave(t), "query_id string, pos int, id string")
    picked = sized(checkpointed(woven), 60)
    return picked.join(b.select("id", "content"), "id").select("query_id", "pos", "id", "content")


def render(picked: DataFrame, now: Column) -> DataFrame:
    """(query_id, context): a line with the time, a rule, bullets in order, a rule."""
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: F.concat(F.lit("• "), x["content"]))
    head = F.concat(F.lit("Current time: ["), now, F.lit("]"))
    return picked.groupBy("query_id").agg(F.concat_ws("\n", F.array(head, F.lit("--- Injected Context ---")), bullets, F.array(F.lit("-" * 24))).alias("context"))


class Injector:
    """One query at a time, with a rolling list of what was injected lately."""

    def __init__(self, beliefs: DataFrame, embed, expansions: dict[str, list[str]] | None = None, tunables: Tunables = Tunables()):
        self.beliefs, self.embed, self.expansions, self.tunables = beliefs, embed, expansions, tunables
        self.prepared: Prepared | None = None  # made at the first query
        self.recent: list[str] = []

    def inject(self, text: str, context: str = "", now: str = "", limit: int | None = None) -> str:
        whole = f"{context} {text}".strip()
        if not whole:
            return ""
        spark = self.beliefs.sparkSession
        row = [("0", whole, [float(x) for x in self.embed(whole)], self.recent)]
        q = spark.createDataFrame(row, "query_id string, text string, query_embedding array<double>, blacklist array<string>")
        self.prepared = self.prepared or prepare(self.beliefs, self.tunables)
        picked = [r for r in retrieve(q, self.prepared, self.expansions, self.tunables).orderBy("pos").collect() if limit is None or r["pos"] <= limit]
        if not picked:
            return ""
        self.recent = (self.recent + [r["id"] for r in picked if r["id"] not in self.recent])[-self.tunables.blacklist_size :]
        return "\n".join([f"Current time: [{now}]", "--- Injected Context ---", *[f"• {r['content']}" for r in picked], "-" * 24])

    def clear(self) -> None:
        self.recent = []


def first_fit(sizes: Column, budget: float | Column) -> Column:
    """Which items fit, in order: the first always, a later one if it fits in what is left; those that don't are skipped."""
    zero = F.struct(F.array().cast("array<boolean>").alias("out"), F.lit(0).cast("long").alias("used"))

    def step(acc, n):
        fits = (F.size(acc["out"]) == 0) | (acc["used"] + n <= budget)
        return F.struct(F.array_append(acc["out"], fits).alias("out"), (acc["used"] + F.when(fits, n).otherwise(0)).cast("long").alias("used"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def sampled(rows: DataFrame, strata: list[str], order: list[str], size: int) -> DataFrame:
    """Round-robin over strata: the first of each, then the second of each, up to ``size``."""
    w = Window.partitionBy(*strata).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).orderBy("rn", *strata).limit(size)
