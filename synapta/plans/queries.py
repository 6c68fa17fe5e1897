"""The engine's queries over the driver's tables, each with SQL that says the same where SQL can.

Conversations serve as memory, documents as beliefs, embeddings as vectors, the benchmark as
query texts; the other tables give names, dates and numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.nlp import heads, tags_udf
from ..lineage import checkpointed, spread
from ..operators import clusters, compress, consolidate, ingest, knowledge, learning, merge, ordering, retrieval, store
from ..schema import DEFAULT_EXPANSIONS, FILLER, NOT_SALIENT, STOPWORDS
from ..sources import importers
from ..sources.vector_store import HashedStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


_CATEGORIES = ("premises", "propositions", "preferences", "people", "skills", "desires", "concepts")


def bel(spark: SparkSession, d: str) -> DataFrame:
    """Documents as beliefs."""
    n = F.col("doc_id")
    pick = lambda yes, a, b: F.when(yes, a).otherwise(b)
    b = table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), n).alias("id"), F.element_at(F.array(*map(F.lit, _CATEGORIES)), (n % 7 + 1).cast("int")).alias("category"), F.col("text").alias("content"),
        pick(n % 5 == 0, 0.8, 0.5).alias("confidence"), pick(n % 3 == 0, 0.6, 0.4).alias("stability_index"), (n % 12).cast("double").alias("verifications"),
        pick(n % 10 == 0, F.array(F.concat(F.lit("doc_"), n + 1), F.concat(F.lit("doc_"), n + 7)), F.array().cast("array<string>")).alias("relations"),
        F.when(n % 10 == 0, "turn_synthesis").otherwise(F.col("source")).alias("source"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 150).cast("int")).cast("timestamp").alias("created_at"), n.alias("seq"),
    )
    return store.normalize(b)


_BEL = """bel AS (
    SELECT doc_id AS n, 'doc_' || doc_id AS id, ['premises','propositions','preferences','people','skills','desires','concepts'][doc_id % 7 + 1] AS category, text AS content,
           CASE WHEN doc_id % 5 = 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN doc_id % 3 = 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS stability_index, (doc_id % 12)::DOUBLE AS verifications,
           CASE WHEN doc_id % 10 = 0 THEN ['doc_' || (doc_id + 1), 'doc_' || (doc_id + 7)] ELSE []::VARCHAR[] END AS relations,
           DATE '2024-01-01' + (doc_id % 150)::INTEGER AS created
    FROM documents
), rel AS (
    SELECT *, round(greatest(0.01, confidence * (0.5 + stability_index) * (1 + least(0.5, 0.05 * len(relations)))), 4) AS relevance FROM bel
)"""


def mem(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as events."""
    source = F.when(F.col("role") == "user", "user_input").when(F.col("role") == "assistant", "assistant_output").otherwise(F.col("role"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")), "yyyy-MM-dd 00:00")
    return table(spark, d, "conversations").select("text", source.alias("source"), day.alias("ts"), F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("t"), "turn").alias("turn_id"), F.upper("role").alias("speaker"), F.lit(NOW).cast("timestamp").alias("ingested_at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


_TOK = lambda x: f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)"
_WORD = r"[\p{L}\p{N}\p{M}_]+"
_STEM = lambda w: f"(CASE WHEN {w} LIKE '%ing' THEN left({w}, length({w}) - 3) WHEN {w} LIKE '%ed' THEN left({w}, length({w}) - 2) WHEN regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END)"


# --- derived columns and scalar functions


@query(f"WITH {_BEL} SELECT id, CASE WHEN confidence < 0.60 THEN 'surface' WHEN confidence < 0.85 THEN 'deep' ELSE 'core' END AS weight, relevance FROM rel")
def weight_tiers(spark, d):
    return bel(spark, d).select("id", "weight", "relevance")


@query(f"WITH {_BEL} SELECT id, relevance FROM rel ORDER BY relevance DESC, n LIMIT 50")
def relevance_topk(spark, d):
    return retrieval.popular(bel(spark, d), 50).select("id", "relevance")


@query("""WITH raw AS (SELECT 'doc_' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'skills' ELSE 'belief' END AS c, n_chars / 1000.0::DOUBLE - 1 AS conf, ['x', lang, 'x'] AS rel FROM documents)
SELECT id, CASE c WHEN 'person' THEN 'people' ELSE c END AS category, greatest(0, least(1, conf)) AS confidence, len(list_distinct(rel)) AS n_relations FROM raw""")
def normalize_beliefs(spark, d):
    n = F.col("doc_id")
    raw = table(spark, d, "documents").select(F.concat(F.lit("doc_"), n).alias("id"), F.when(n % 3 == 0, "person").when(n % 3 == 1, "skills").otherwise("belief").alias("category"), (F.col("n_chars") / 1000.0 - 1).alias("confidence"), F.array(F.lit("x"), F.col("lang"), F.lit("x")).alias("relations"))
    return store.normalize(raw).select("id", "category", "confidence", F.size("relations").cast("long").alias("n_relations"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[' || strftime(DATE '2024-01-01' + conv_id::INTEGER, '%Y-%m-%d') || ' 08:30] ' WHEN 1 THEN '[' || strftime(DATE '2024-01-01' + conv_id::INTEGER, '%Y-%m-%d') || '] ' ELSE '' END AS p, text FROM conversations)
SELECT conv_id, turn, md5(text) AS body, CASE WHEN p = '' THEN NULL WHEN length(p) > 15 THEN strptime(p, '[%Y-%m-%d %H:%M] ') ELSE strptime(p, '[%Y-%m-%d] ') END AS at FROM c""")
def date_prefixes(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")), "yyyy-MM-dd")
    c = table(spark, d, "conversations")
    prefix = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), day, F.lit(" 08:30] "))).when(F.col("turn") % 3 == 1, F.concat(F.lit("["), day, F.lit("] "))).otherwise("")
    c = c.withColumn("content", F.concat(prefix, "text"))
    return c.select("conv_id", "turn", F.md5(X.strip_prefix("content")).alias("body"), X.prefix_time("content").cast("timestamp_ntz").alias("at"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE turn::INTEGER END AS number FROM conversations")
def turn_numbers(spark, d):
    t = F.col("turn")
    raw = F.when(t % 4 == 0, F.concat(F.lit("t"), t)).when(t % 4 == 1, F.concat(F.lit(" "), t)).when(t % 4 == 2, t.cast("string")).otherwise(F.concat(F.lit("turn"), t))
    return table(spark, d, "conversations").select("conv_id", "turn", X.turn_number(raw).alias("number"))


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM documents)
SELECT word, {_STEM('word')} AS stem, count(*) AS n FROM w GROUP BY word""")
def stem_words(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), 1)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", X.stem("word").alias("stem"), "n")


_NOT = ", ".join(f"'{w}'" for w in sorted(NOT_SALIENT))
_TOKENS = r"regexp_extract_all(text, '[A-Za-z0-9][\p{L}\p{N}\p{M}_.\-/]*')"
_BARE = r"regexp_replace(lower(t), '[./-]+$', '')"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({_TOKENS}) AS t FROM conversations), b AS (SELECT conv_id, turn, t, {_BARE} AS token FROM w)
SELECT DISTINCT conv_id, turn, token FROM b WHERE regexp_matches(t, '\\p{{Nd}}') OR (regexp_matches(t, '^[A-Z]') AND token NOT IN ({_NOT}))""")
def salient_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(X.salient_tokens("text")).alias("token"))


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(range(1, len({_TOKENS}) + 1)) AS i, unnest({_TOKENS}) AS t FROM conversations),
b AS (SELECT *, {_BARE} AS token FROM w),
s AS (SELECT DISTINCT conv_id, turn, token FROM b WHERE regexp_matches(t, '\\p{{Nd}}') OR (regexp_matches(t, '^[A-Z]') AND token NOT IN ({_NOT})))
SELECT conv_id, turn, md5(string_agg(CASE WHEN s.token IS NULL THEN b.token ELSE '<v>' END, ' ' ORDER BY i)) AS template FROM b LEFT JOIN s USING (conv_id, turn, token) GROUP BY conv_id, turn""")
def statement_templates(spark, d):
    c = table(spark, d, "conversations").withColumn("template", X.statement_template("text")).where("template <> ''")
    return c.select("conv_id", "turn", F.md5("template").alias("template"))


@query(f"SELECT doc_id, {_TOK('text')}::BIGINT AS tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count("text").alias("tokens"))


@query(f"SELECT conv_id, (3 + sum(3 + {_TOK('role')} + {_TOK('text')}))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def session_chat_tokens(spark, d):
    return compress.chat_tokens(table(spark, d, "conversations").withColumnRenamed("text", "content"), "conv_id")


@query("SELECT doc_id, 'bel_' || left(sha256(text), 12) AS belief, 'bel_synth_' || left(sha256('synth:' || text), 12) AS synthesis FROM documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_id("bel_", "text").alias("belief"), X.content_id("bel_synth_", F.concat(F.lit("synth:"), "text")).alias("synthesis"))


@query("SELECT p_partkey, 'cluster_' || trim(regexp_replace(lower(trim(p_name)), '[^0-9a-z]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(trim(p_brand || ' #' || p_size)), '[^0-9a-z]+', '_', 'g'), '_') AS cluster FROM part")
def slug_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", X.cluster_id("p_name", F.concat("p_brand", F.lit(" #"), "p_size")).alias("cluster"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':05' ELSE '' END AS at FROM orders")
def spoken_dates(spark, d):
    h = F.col("o_orderkey") % 24
    clock = F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"), F.lit(":05 "), F.when(h >= 12, "pm").otherwise("am"))
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(clock, F.lit(" on "), F.date_format("o_orderdate", "d MMMM, yyyy"))).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return table(spark, d, "orders").select("o_orderkey", X.spoken_date(said).alias("at"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 02:21' AS at FROM orders")
def slashed_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.slashed_date(F.date_format("o_orderdate", "yyyy/MM/dd '(Sat) 02:21'")).alias("at"))


@query("""WITH e AS (SELECT event_id, epoch(TIMESTAMP '2026-06-01 12:00:00' - date_trunc('second', ts))::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s // 86400 > 0 THEN (s // 86400) || ' days, ' || (s % 86400 // 3600) || ' hours' ELSE (s // 3600) || ' hours, ' || (s % 3600 // 60) || ' minutes' END AS ago FROM e""")
def elapsed_texts(spark, d):
    return table(spark, d, "events").select("event_id", X.elapsed_text(F.date_trunc("second", "ts").cast("timestamp"), F.lit("2026-06-01 12:00:00").cast("timestamp")).alias("ago"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 3000 THEN left(text, 2000) || chr(10) || '...[truncated]...' || chr(10) || right(text, 800) ELSE text END) AS shown FROM documents")
def elided_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.elided("text")).alias("shown"))


@query("""WITH b AS (SELECT doc_id, regexp_replace('[2024-01-01] ' || text, '^\\[[0-9: -]+\\]\\s*', '') AS body FROM documents), s AS (SELECT nullif(regexp_extract(body, '^([A-Z][a-zA-Z]+)', 1), '') AS subject FROM b)
SELECT subject, count(*) AS n FROM s WHERE subject IS NOT NULL GROUP BY subject HAVING count(*) >= 2""")
def inferred_subjects(spark, d):
    s = table(spark, d, "documents").select(X.infer_subject(F.concat(F.lit("[2024-01-01] "), "text")).alias("subject"))
    return s.where("subject is not null").groupBy("subject").agg(F.count("*").alias("n")).where("n >= 2")


_HEADINGS = ("My goals and mission", "Tool use", "People I know", "Voice, tone", "Session log", "Glossary: term list", "", "House rule")
_SQL_RULES = " ".join(f"WHEN list_has_any(ws, [{', '.join(repr(k) for k in keys)}]) THEN '{c}'" for c, keys in importers.RULES)
_SQL_HEADINGS = "[" + ", ".join(repr(h) for h in _HEADINGS) + "]"


@query(f"""WITH h AS (SELECT p_partkey, {_SQL_HEADINGS}[p_partkey % 8 + 1] || ' ' || CASE WHEN p_size > 25 THEN p_type ELSE '' END AS heading, CASE WHEN p_partkey % 16 < 8 THEN 'hermes' ELSE 'generic' END AS kind FROM part),
w AS (SELECT *, regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM h)
SELECT p_partkey, CASE {_SQL_RULES} WHEN kind = 'hermes' AND trim(heading) = '' THEN 'premises' ELSE 'propositions' END AS category FROM w""")
def heading_categories(spark, d):
    p = F.col("p_partkey")
    heading = F.trim(F.concat(F.element_at(F.array(*map(F.lit, _HEADINGS)), (p % 8 + 1).cast("int")), F.lit(" "), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")))
    return table(spark, d, "part").select("p_partkey", importers.heading_category(heading, F.when(p % 16 < 8, "hermes").otherwise("generic")).alias("category"))


_NAMES = ("/a/.claude/notes.md", "/b/AGENTS.md", "/x/soul/me.md", "/x/y/identity.json", "/pi_agent/z.txt", "/q/readme.md")


@query("SELECT page_id, ['claudecode', 'codex', 'hermes', 'hermes', 'pi_agent', 'generic'][page_id % 6 + 1] AS framework FROM pages")
def frameworks(spark, d):
    path = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", importers.framework(path).alias("framework"))


@query("""WITH s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g') AS t FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM s)
SELECT conv_id, turn, len(ps) AS n_sentences, md5(array_to_string(ps, '|')) AS pieces FROM p""")
def sentence_pieces(spark, d):
    c = table(spark, d, "conversations").withColumn("ps", X.sentences("text"))
    return c.select("conv_id", "turn", F.size("ps").cast("long").alias("n_sentences"), F.md5(F.array_join("ps", "|")).alias("pieces"))


@query("SELECT doc_id, (CASE WHEN lang = 'en' THEN 2 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END)::INTEGER AS overlap FROM documents")
def tag_overlaps(spark, d):
    q = F.array(*map(F.lit, ("en", "en", "src1", "other")))
    return table(spark, d, "documents").select("doc_id", retrieval.tag_overlap(q, F.array("lang", "source", "lang", "lang")).alias("overlap"))


# --- vectors


_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))"


def _first_vector(spark, d):
    v = table(spark, d, "embeddings")
    return v, list(v.orderBy("vec_id").select("embedding").first()[0])


@query(f"WITH {_VEC} SELECT vec_id, round(list_cosine_similarity(e, qe), 6) AS similarity FROM v, q ORDER BY list_cosine_similarity(e, qe) DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    v, q = _first_vector(spark, d)
    return V.top_k(v, q, 20, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM p) SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def cosine_topk_batch(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return V.top_k_join(v.withColumnRenamed("id", "query_id"), v, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VEC} SELECT label, round(greatest(0.01, least(0.10, 1.5 * stddev_pop(list_cosine_similarity(e, qe)))), 6) AS nudge FROM v, q GROUP BY label")
def similarity_nudge(spark, d):
    v, q = _first_vector(spark, d)
    return v.withColumn("c", V.cosine("embedding", F.array(*map(F.lit, q)))).groupBy("label").agg(F.round(retrieval.nudge("c"), 6).alias("nudge"))


#: As queries, every vector whose number is divisible by 50, against all.
_PAIRS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id, list_cosine_similarity(e, qe) AS c FROM v, q)"""


def _vector_queries(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v


@query(f"""WITH {_PAIRS}, n AS (SELECT query_id, greatest(0.01, least(0.10, 1.5 * stddev_pop(c))) AS nudge FROM p GROUP BY query_id),
s AS (SELECT query_id, vec_id, c + nudge * ln(1 + vec_id % 5) + 0.5 * nudge * ln(1 + vec_id % 3) AS score FROM p JOIN n USING (query_id))
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 11 = 0, round(score, 9) DESC, vec_id % 7 DESC, vec_id) AS place FROM s""")
def fusion_rank(spark, d):
    """Every vector scored and ranked for every query: a stated query set against all rows, tile by tile; the pairs are the result."""
    q, v = _vector_queries(spark, d)
    n = F.col("vec_id")
    pool = V.all_pairs(q, v).select("query_id", F.col("id").alias("vec_id"), F.col("similarity").alias("cosine"))
    pool = pool.withColumns({"keyword_score": n % 5, "tag_score": n % 3, "blacklisted": n % 11 == 0, "relevance": (n % 7).cast("double"), "place": n})
    return retrieval.ranked(retrieval.scored(pool)).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("pool_rank").cast("long").alias("place"))


@query(f"""WITH {_PAIRS}, k AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY (vec_id + query_id) % 7 DESC, vec_id) AS place FROM p),
n AS (SELECT query_id, vec_id, 30 + row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS place FROM p)
SELECT query_id, vec_id, min(place) AS place FROM (SELECT * FROM k WHERE place <= 30 UNION ALL SELECT * FROM n WHERE place <= 60) GROUP BY query_id, vec_id""")
def candidate_union(spark, d):
    q, v = _vector_queries(spark, d)
    scores = v.select("id").crossJoin(F.broadcast(q.select("query_id"))).withColumn("keyword_score", ((F.col("id") + F.col("query_id")) % 7).cast("double"))  # the stated query set, against all
    words = retrieval.by_keywords(q, scores, v.select("id", F.lit(0.0).alias("relevance"), F.col("id").alias("seq")), 30)
    both = retrieval.united(words, V.top_k_join(q, v, 30), 30)
    return both.select("query_id", F.col("id").alias("vec_id"), F.col("place").cast("long").alias("place"))


@query()
def approximate_topk(spark, d):
    """Ten near vectors of every query by the inverted file; tests measure its recall."""
    q, v = _vector_queries(spark, d)
    return V.approximate_top_k_join(q, V.index(v, 32), 10, 12).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


# --- keywords


@query(f"""WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + max(n) / count(*)) / ln(1 + max(n)), 6) AS idf FROM p, n GROUP BY term""")
def document_frequency(spark, d):
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("body"))
    n = F.lit(float(b.count()))
    return retrieval.idf(retrieval.postings(b).withColumnRenamed("word", "term"), n).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH g AS (SELECT DISTINCT item_id AS query_id, length(w) AS grp, w AS term, length(w) % 2 = 0 AS direct FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w FROM benchmark)),
p AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
i AS (SELECT term, ln(1 + max(n) / count(*)) / ln(1 + max(n)) AS idf FROM p, n GROUP BY term),
b AS (SELECT query_id, grp, id, max(idf * CASE WHEN direct THEN 1.0 ELSE 0.3 END) AS best FROM g JOIN p USING (term) JOIN i USING (term) GROUP BY query_id, grp, id)
SELECT query_id, id, round(sum(best), 6) AS score FROM b GROUP BY query_id, id""")
def keyword_group_scores(spark, d):
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), 1)).alias("term")).distinct()
    g = w.select("query_id", F.length("term").alias("grp"), "term", (F.length("term") % 2 == 0).alias("direct"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("body"))
    return retrieval.keyword_scores(g, b, F.lit(float(b.count()))).select("query_id", "id", F.round("keyword_score", 6).alias("score"))


@query(f"""WITH l AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 6) AS ws FROM documents),
k AS (SELECT id, unnest([ws[1], ws[2] || ' ' || ws[3]]) AS key FROM l WHERE len(ws) >= 3),
q AS (SELECT item_id AS query_id, lower(text) AS low, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_ ]', ' | ', 'g') || ' ' AS spaced FROM benchmark),
s AS (SELECT DISTINCT query_id, {_STEM('w')} AS s FROM (SELECT query_id, regexp_replace(unnest(regexp_split_to_array(low, '\\s+')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g') AS w FROM q) WHERE w <> '')
SELECT DISTINCT query_id, id FROM (SELECT query_id, id FROM k JOIN s ON {_STEM('k.key')} = s.s WHERE k.key NOT LIKE '% %'
UNION ALL SELECT query_id, id FROM k JOIN q ON contains(spaced, ' ' || k.key || ' ') WHERE k.key LIKE '% %')""")
def lexicon_matches(spark, d):
    ws = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), lambda x: F.length(x) >= 6)
    b = table(spark, d, "documents").withColumn("ws", ws).where("size(ws) >= 3")
    b = b.select(F.col("doc_id").alias("id"), F.lit("premises").alias("category"), F.lit(2).alias("layer"), F.col("ws")[0].alias("term"), F.array(F.concat_ws(" ", F.col("ws")[1], F.col("ws")[2])).alias("aliases"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexicon_matches(q, learning.lexicon(b)).select("query_id", "id")


_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS | FILLER))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: x NOT IN ({_STOP})) AS ws, source AS term FROM documents),
f AS (SELECT doc_id, term, w, min(i) AS i FROM (SELECT doc_id, term, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w) GROUP BY doc_id, term, w),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
SELECT doc_id AS id, term AS key, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY i)) AS words FROM t WHERE rn <= 8 GROUP BY doc_id, term""")
def lexicon_words(spark, d):
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("premises").alias("category"), F.lit(2).alias("layer"), F.col("source").alias("term"), F.array().cast("array<string>").alias("aliases"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return learning.lexicon(b).where("size(words) > 0").select("id", "key", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words"))


# --- relations, decay, merging


@query(f"WITH {_BEL} SELECT category, r AS id, count(*) AS inbound FROM (SELECT category, unnest(relations) AS r FROM bel) GROUP BY category, r")
def inbound_degree(spark, d):
    return store.inbound(bel(spark, d))


_EDGES = _BEL + """, e AS (SELECT id AS a, unnest(relations) AS b FROM bel), k AS (SELECT a, b FROM e WHERE b IN (SELECT id FROM bel)), g AS (SELECT a, b FROM k UNION SELECT b, a FROM k)"""


@query(f"WITH {_EDGES} SELECT a AS seed, b AS id, 1 AS hop FROM g")
def related_one_hop(spark, d):
    b = bel(spark, d)
    return store.related(b, b, 1)


@query(f"""WITH {_EDGES}, two AS (SELECT x.a AS seed, y.b AS id FROM g x JOIN g y ON x.b = y.a WHERE x.a <> y.b)
SELECT a AS seed, b AS id, 1 AS hop FROM g UNION ALL SELECT DISTINCT seed, id, 2 FROM two WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.a = seed AND g.b = id)""")
def related_two_hops(spark, d):
    b = bel(spark, d)
    return store.related(b, b, 2)


_DECAY = _BEL + """, ib AS (SELECT category, r AS id, count(*) AS c FROM (SELECT category, unnest(relations) AS r FROM bel) GROUP BY category, r),
dk AS (SELECT bel.*, confidence + (least(1, (0.20 + 0.40 * least(1, log2(date_diff('day', created, DATE '2024-06-01') + 1) / log2(31)) + 0.20 * least(1, coalesce(c, 0) / 5.0) + 0.20 * least(1, verifications / 10.0)) * (0.5 + stability_index)) - confidence) * 0.30 AS new
       FROM bel LEFT JOIN ib USING (category, id)),
dw AS (SELECT *, CASE WHEN confidence < 0.60 THEN 'surface' WHEN confidence < 0.85 THEN 'deep' ELSE 'core' END AS w0, CASE WHEN new < 0.60 THEN 'surface' WHEN new < 0.85 THEN 'deep' ELSE 'core' END AS w1 FROM dk)"""


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"WITH {_DECAY} SELECT id, round(new, 3) AS confidence, CASE WHEN verifications > 0 THEN greatest(0, verifications - 0.05) ELSE verifications END AS verifications, CASE WHEN round(new, 3) < 0.60 THEN 'surface' WHEN round(new, 3) < 0.85 THEN 'deep' ELSE 'core' END AS weight FROM dw WHERE new >= 0.20")
def decay_pass(spark, d):
    return store.decay(bel(spark, d), _now()).select("id", "confidence", "verifications", "weight")


@query(f"WITH {_DECAY} SELECT count(*) FILTER (new < 0.20) AS pruned, count(*) FILTER (new >= 0.20 AND w0 <> 'surface' AND w1 = 'surface') AS demoted, count(*) FILTER (new >= 0.20 AND w0 = 'surface' AND w1 <> 'surface') AS promoted, count(*) FILTER (new >= 0.20) AS updated FROM dw")
def decay_stats(spark, d):
    return store.decay_stats(bel(spark, d), _now())


def event_statements(spark, d):
    """A statement for every event: its user and its value in hundredths."""
    e = table(spark, d, "events").select(F.concat(F.lit("event_"), "event_id").alias("id"), F.col("event_id").cast("long").alias("seq"), "user_id", F.round(F.col("value") * 100).cast("long").alias("v"), "event_type")
    return e.select("id", "seq", F.lit("preferences").alias("category"), F.format_string("User%d spent V%d on %s.", "user_id", "v", "event_type").alias("content"))


@query("""WITH b AS (SELECT 'event_' || event_id AS id, user_id AS u, round(value * 100)::BIGINT AS v, event_type AS t FROM events),
p AS (SELECT a.id, b.id AS other_id FROM b a JOIN b ON a.t = b.t AND a.u = b.u AND a.v <> b.v UNION ALL SELECT a.id, b.id FROM b a JOIN b ON a.t = b.t AND a.v = b.v AND a.u <> b.u),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other_id) AS n FROM p) SELECT id, other_id, 1 AS shared FROM r WHERE n = 1""")
def template_conflicts(spark, d):
    return merge.template_conflicts(event_statements(spark, d))


@query("""WITH old AS (SELECT 'doc_' || doc_id AS id, 0.5::DOUBLE AS confidence FROM documents WHERE doc_id % 2 = 0), new AS (SELECT 'doc_' || doc_id AS id, 0.9::DOUBLE AS confidence FROM documents)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)""")
def insert_if_absent(spark, d):
    b = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.lit(0.9).alias("confidence"), F.col("doc_id").alias("seq"))
    old = b.where("seq % 2 = 0").withColumn("confidence", F.lit(0.5))
    return store.insert_if_absent(old, b).select("id", "confidence")


@query("SELECT 'doc_' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents")
def upsert_latest(spark, d):
    b = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.lit(0.5).alias("confidence"), F.col("doc_id").alias("seq"))
    changed = b.where("seq % 3 = 0").withColumns({"confidence": F.lit(0.9), "seq": F.col("seq") + 1_000_000_000})
    return store.upsert(b, changed).select("id", "confidence")


@query("SELECT 'doc_' || doc_id AS id FROM documents WHERE doc_id % 4 <> 1")
def delete_by_id(spark, d):
    b = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("id"), "doc_id")
    return store.delete(b, b.where("doc_id % 4 = 1")).select("id")


# --- conversation positions


@query("""SELECT a.conv_id || '_' || a.turn AS anchor_id, b.conv_id || '_' || b.turn AS id, abs(a.turn - b.turn)::INTEGER AS distance, b.turn > a.turn AS after
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND b.turn BETWEEN a.turn - 2 AND a.turn + 2""")
def turn_adjacency(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_no"))
    return retrieval.turn_neighbours(c, c, 2)


@query("""SELECT a.l_orderkey || '_' || a.l_linenumber AS anchor_id, b.l_orderkey || '_' || b.l_linenumber AS id
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) = 1""")
def sibling_adjacency(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("chunk_index")).distinct().withColumn("id", F.concat_ws("_", "event_id", "chunk_index"))
    return retrieval.siblings(c, c)


@query(f"""WITH {_BEL}, p AS (SELECT n // 100 AS query_id, id, n % 10 = 0 AS merged, relations FROM bel), named AS (SELECT DISTINCT query_id, unnest(relations) AS id FROM p WHERE merged)
SELECT query_id, id FROM p WHERE NOT EXISTS (SELECT 1 FROM named WHERE named.query_id = p.query_id AND named.id = p.id)""")
def suppressed_constituents(spark, d):
    p = bel(spark, d).select(F.floor(F.col("seq") / 100).alias("query_id"), "id", "source", "relations")
    return retrieval.without_constituents(p).select("query_id", "id")


@query(f"""WITH {_BEL} SELECT n // 50 AS query_id, id, row_number() OVER (PARTITION BY n // 50 ORDER BY n % 9 = 0, n % 13 DESC, relevance DESC, n) AS place FROM rel""")
def blacklist_sort(spark, d):
    n = F.col("seq")
    pool = bel(spark, d).select(F.floor(n / 50).alias("query_id"), "id", "relevance", (n % 9 == 0).alias("blacklisted"), (n % 13).alias("score"), n.alias("place"))
    return retrieval.ranked(pool).select("query_id", "id", F.col("pool_rank").cast("long").alias("place"))


@query(f"""WITH u AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN NULL ELSE DATE '2024-01-01' + (turn * 7 % 5)::INTEGER END AS t FROM conversations WHERE turn % 4 <> 1)
SELECT conv_id, turn, row_number() OVER (ORDER BY t NULLS FIRST, turn, conv_id) AS place FROM u""")
def unreviewed_order(spark, d):
    c, t = table(spark, d, "conversations"), F.col("turn")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (t * 7 % 5).cast("int")), "yyyy-MM-dd")
    m = c.select("conv_id", "turn", F.lit("memory").alias("category"), F.when(t % 3 == 2, F.col("text")).otherwise(F.concat(F.lit("["), day, F.lit("] "), "text")).alias("content"), F.when(t % 4 == 1, _now()).alias("reviewed_at"), F.col("conv_id").alias("session_id"), _now().alias("ingested_at"), F.lit(0).alias("chunk_index"), t.alias("seq"), F.format_string("%012d", "conv_id").alias("id"))
    return consolidate.chronological(m).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query(f"""WITH RECURSIVE o AS (SELECT conv_id, turn, {_TOK('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, t AS used, 0 AS batch FROM o WHERE i = 1 UNION ALL
SELECT o.conv_id, o.turn, o.i, CASE WHEN used > 0 AND used + t > 300 THEN t ELSE used + t END, CASE WHEN used > 0 AND used + t > 300 THEN batch + 1 ELSE batch END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, turn, batch FROM r""")
def token_batches(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    b = consolidate.batches(c, "conv_id", ["turn"], "text", 300)
    return b.select("conv_id", F.explode("rows.turn").alias("turn"), "batch")


@query(f"""WITH RECURSIVE o AS (SELECT conv_id, turn, {_TOK('text')} AS t, row_number() OVER (ORDER BY turn, conv_id) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, t AS used, 0 AS batch FROM o WHERE i = 1 UNION ALL
SELECT o.conv_id, o.turn, o.i, CASE WHEN used > 0 AND used + t > 300 THEN t ELSE used + t END, CASE WHEN used > 0 AND used + t > 300 THEN batch + 1 ELSE batch END FROM r JOIN o ON o.i = r.i + 1)
SELECT conv_id, turn, batch::BIGINT AS batch FROM r""")
def review_batches(spark, d):
    """Batches over all sessions in one order, each as full as it gets."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return ordering.next_fit(c, [F.asc("turn"), F.asc("conv_id")], X.token_count("text"), 300).select("conv_id", "turn", "batch")


@query(f"""WITH RECURSIVE o AS (SELECT conv_id, turn, {_TOK('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, t AS used, true AS fits FROM o WHERE i = 1 UNION ALL
SELECT o.conv_id, o.turn, o.i, CASE WHEN used + t <= 250 THEN used + t ELSE used END, used + t <= 250 FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, turn, fits FROM r""")
def budget_first_fit(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", X.token_count("text").alias("t")))).alias("rows"))
    fits = retrieval.first_fit(F.transform("rows", lambda r: r["t"]), 250)
    return c.select("conv_id", F.explode(F.arrays_zip("rows", fits.alias("fits"))).alias("z")).select("conv_id", F.col("z.rows.turn").alias("turn"), F.col("z.fits").alias("fits"))


@query(f"""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, {_TOK('text')} AS t FROM conversations),
s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, floor(sum(t) OVER (PARTITION BY conv_id) * 0.10) AS most, sum(t) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM m)
SELECT conv_id::VARCHAR AS session_id, greatest(coalesce(min(CASE WHEN n - pos <= 10 AND pos >= 2 AND (pos = n - 1 OR back <= most) THEN pos END), max(n)), 3)::INTEGER AS tail_start FROM s GROUP BY conv_id""")
def tail_boundary(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("text").alias("content"))
    return compress.tails(c)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY hash_key, event_id) AS rn FROM (SELECT *, md5(event_id::VARCHAR) AS hash_key FROM events))
SELECT event_id, event_type, rn FROM r ORDER BY rn, event_type LIMIT 40""")
def stratified_sample(spark, d):
    e = table(spark, d, "events").withColumn("k", F.md5(F.col("event_id").cast("string")))
    return retrieval.sampled(e, ["event_type"], ["k", "event_id"], 40).select("event_id", "event_type", F.col("rn").cast("long").alias("rn"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, d):
    from ..streaming.memory import windowed_counts

    c = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return c.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query("""SELECT conv_id, turn, 'evt_' || left(sha256(strftime(DATE '2024-01-01' + conv_id::INTEGER, '%Y-%m-%d') || ' 00:00|' || CASE role WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'assistant_output' ELSE role END || '|' || upper(role) || '|' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 12) AS event_id FROM conversations WHERE trim(text) <> ''""")
def event_ids(spark, d):
    m = ingest.memory_chunks(mem(spark, d))
    return m.select((F.floor(F.col("seq") / 1000)).cast("long").alias("conv_id"), (F.col("seq") % 1000).cast("long").alias("turn"), "event_id").distinct()


@query("""SELECT conv_id, turn, strftime(DATE '2024-01-01' + conv_id::INTEGER, '%Y-%m-%d') AS ts, 'Speaker ' || role AS speaker, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM conversations WHERE trim(text) <> ''""")
def turn_prefixes(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")), "MMMM d, yyyy")
    c = table(spark, d, "conversations").where("trim(text) <> ''")
    t = c.select(F.concat(F.lit("Date: "), day, F.lit("\nSpeaker "), "role", F.lit(": "), F.regexp_replace("text", r"^\s+", "")).alias("content"), "role", F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), _now().alias("ingested_at"), F.col("turn").alias("seq"))
    return ingest.turn_events(t).select(F.col("session_id").alias("conv_id"), F.col("turn_id").alias("turn"), "ts", "speaker", F.md5("text").alias("body"))


# --- learning


@query(f"""WITH m AS (SELECT 'cluster_' || source || '_' || lang AS cluster_id, doc_id, {_TOK('text')} AS t FROM documents)
SELECT cluster_id, count(*) AS n_members, sum(t)::BIGINT AS tokens FROM m WHERE NOT starts_with(cluster_id, 'cluster_src1_') GROUP BY cluster_id HAVING count(*) >= 10 OR sum(t) >= 200""")
def due_clusters(spark, d):
    docs = table(spark, d, "documents")
    seen = docs.select(F.col("source").alias("subject"), F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("belief_id"), F.col("doc_id").alias("seq"))
    members = learning.tag_members(spark.createDataFrame([], "cluster_id string, belief_id string, seq long"), seen)
    b = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    done = members.where(F.col("cluster_id").startswith("cluster_src1_")).select("cluster_id").distinct()
    return learning.due_clusters(members, b, done)


@query("""WITH k AS (SELECT DISTINCT lower(c_mktsegment) AS category, lower(n_name) AS instance FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT category, count(*) AS n, md5(string_agg(instance, '|' ORDER BY instance)) AS instances FROM k GROUP BY category""")
def concept_expansions(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = c.select(F.col("c_mktsegment").alias("category"), F.col("n_name").alias("instance"), F.col("c_custkey").alias("seq"))
    known = learning.learn_concepts(spark.createDataFrame([], "category string, instance string, seq long"), seen)
    e = learning.concept_expansions(known)
    return e.select("category", F.size("instances").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("instances"), "|")).alias("instances"))


@query("""WITH k AS (SELECT lower(r_name) AS subject, upper(left(n_name, 1)) || translate(lower(substr(n_name, 2)), '0123456789_ ', 'abcdefghij') AS entity, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT subject, 'nations' AS relation, string_agg(entity, '|' ORDER BY n_nationkey) AS entities FROM k WHERE regexp_matches(entity, '^[A-Z][A-Za-z]*(\\s[A-Z][A-Za-z]*){0,2}$') GROUP BY subject""")
def relation_expansions(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.upper(F.substring("n_name", 1, 1)), F.translate(F.lower(F.substring("n_name", 2, 100)), "0123456789_ ", "abcdefghij"))
    seen = n.select(F.col("r_name").alias("subject"), F.lit("Nations ").alias("relation"), name.alias("entity"), F.col("n_nationkey").cast("long").alias("seq"))
    known = learning.learn_relations(spark.createDataFrame([], "subject string, relation string, entity string, seq long"), seen)
    return learning.relation_expansions(known).select("subject", F.explode("relations").alias("relation", "e")).select("subject", "relation", F.array_join("e", "|").alias("entities"))


@query("""WITH base AS (SELECT r_name AS category, n_name AS instance FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT 'ASIA' AS category, p_brand AS instance FROM part)
SELECT DISTINCT category, instance FROM (SELECT * FROM base WHERE category NOT IN (SELECT category FROM o) UNION ALL SELECT * FROM o)""")
def expansion_union(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = n.select(F.col("r_name").alias("category"), F.col("n_name").alias("instance"))
    more = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("category"), F.col("s_name").alias("instance"))
    return learning.expansion_table(base.unionByName(more), table(spark, d, "part").select(F.lit("ASIA").alias("category"), F.col("p_brand").alias("instance")))


@query("""WITH c AS (SELECT p_brand AS cluster_id, p_partkey AS member FROM part), x AS (SELECT p_partkey % 5 AS rollup_id, p_partkey AS member FROM part WHERE p_partkey % 3 > 0 OR p_size > 25 UNION SELECT 9, p_partkey FROM part WHERE p_brand < 'Brand#3'),
s AS (SELECT cluster_id, count(*) AS n FROM c GROUP BY cluster_id), o AS (SELECT cluster_id, rollup_id, count(*) AS k FROM c JOIN x USING (member) GROUP BY cluster_id, rollup_id)
SELECT DISTINCT cluster_id FROM o JOIN s USING (cluster_id) WHERE k::DOUBLE / n >= 0.7""")
def covered_clusters(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("member"))
    x = p.where("p_partkey % 3 > 0 or p_size > 25").select((F.col("p_partkey") % 5).alias("rollup_id"), F.col("p_partkey").alias("member")).unionByName(p.where("p_brand < 'Brand#3'").select(F.lit(9).cast("long").alias("rollup_id"), F.col("p_partkey").alias("member")))
    return learning.covered(c, x)


@query("""WITH m AS (SELECT o_orderkey AS group_id, l_linenumber AS place, o_orderkey || '_' || l_linenumber AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
, r AS (SELECT DISTINCT group_id, id, dense_rank() OVER (PARTITION BY group_id ORDER BY place) AS i FROM m)
SELECT group_id, id FROM r WHERE i IN (1, 3)""")
def linked_sources(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("place")).distinct()
    g = m.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("_", "group_id", "place").alias("id")))).alias("rows"))
    return consolidate.linked(g.withColumn("source_indices", F.array(*map(F.lit, ("1", "3", "99", "x")))))


# --- what SQL has no form for: order-dependent folds and models; tests hold these against plain Python


def vectors_of(spark, d) -> DataFrame:
    """Beliefs with vectors of their own: documents beside embeddings of the same number, cyclically."""
    b = bel(spark, d)
    v = table(spark, d, "embeddings")
    n = v.count()
    return b.drop("embedding").join(v.select(F.col("vec_id").alias("k"), "embedding"), (F.col("seq") % n) == F.col("k"), "left").drop("k").select(*b.columns)


def memory_table(spark, d) -> DataFrame:
    """Memory rows of all conversations, tagged and embedded."""
    m = store.conform(ingest.memory_chunks(mem(spark, d)))
    m = m.withColumns({"confidence": F.lit(1.0), "stability_index": F.lit(0.5), "verifications": F.lit(1.0)})
    m = store.normalize(m, tags_udf())
    return HashedStore(64).embed(m.withColumn("b", X.strip_prefix("content")), "b").drop("b")


def _chunk_sql(table: str, key: str, text: str) -> str:
    """(key, chunk_index, chunk) of a table's texts: whole sentences packed to 100 tokens, those above 150 split by words first."""
    return f"""RECURSIVE d AS (SELECT {key}, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') AS text FROM {table}),
long AS (SELECT * FROM d WHERE {_TOK('text')} > 100),
s AS (SELECT {key}, unnest(range(len(ps))) AS sn, unnest(ps) AS s FROM (SELECT {key}, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM long)),
w AS (SELECT {key}, sn, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {key}, sn, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS ws FROM s WHERE {_TOK('s')} > 150)),
wr AS (SELECT {key}, sn, i, w, greatest(1, {_TOK('w')})::BIGINT AS used, 0 AS b FROM w WHERE i = 1 UNION ALL
SELECT w.{key}, w.sn, w.i, w.w, CASE WHEN used + greatest(1, {_TOK('w.w')}) > 100 THEN greatest(1, {_TOK('w.w')}) ELSE used + greatest(1, {_TOK('w.w')}) END, CASE WHEN used + greatest(1, {_TOK('w.w')}) > 100 THEN b + 1 ELSE b END FROM wr JOIN w ON w.{key} = wr.{key} AND w.sn = wr.sn AND w.i = wr.i + 1),
pc AS (SELECT {key}, sn, 0 AS b, s AS p FROM s WHERE {_TOK('s')} <= 150 UNION ALL SELECT {key}, sn, b, string_agg(w, ' ' ORDER BY i) FROM wr GROUP BY {key}, sn, b),
o AS (SELECT {key}, p, {_TOK('p')} AS t, row_number() OVER (PARTITION BY {key} ORDER BY sn, b) AS i FROM pc),
r AS (SELECT {key}, i, p, t::BIGINT AS used, 0 AS n FROM o WHERE i = 1 UNION ALL
SELECT o.{key}, o.i, o.p, CASE WHEN used + t > 100 THEN t ELSE used + t END, CASE WHEN used + t > 100 THEN n + 1 ELSE n END FROM r JOIN o ON o.{key} = r.{key} AND o.i = r.i + 1),
chunks AS (SELECT {key}, n AS chunk_index, string_agg(p, ' ' ORDER BY i) AS chunk FROM r GROUP BY {key}, n UNION ALL SELECT {key}, 0, text FROM d WHERE text <> '' AND {_TOK('text')} <= 100)"""


@query(f"WITH {_chunk_sql('documents', 'doc_id', 'text')} SELECT doc_id, chunk_index, chunk FROM chunks")
def chunk_pack(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(ingest.chunk_text("text")).alias("chunk_index", "chunk"))


_MEM = """(SELECT conv_id * 1000 + turn AS seq, text, strftime(DATE '2024-01-01' + conv_id::INTEGER, '%Y-%m-%d') || ' 00:00' AS ts, upper(role) AS speaker, CASE role WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'assistant_output' ELSE role END AS source FROM conversations)"""


@query(f"""WITH {_chunk_sql(_MEM, 'seq', 'text')}, e AS (SELECT seq, 'evt_' || left(sha256(ts || '|' || source || '|' || speaker || '|' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 12) AS event_id, ts, speaker FROM {_MEM})
SELECT 'mem_' || left(sha256(event_id || ':' || chunk_index || ':' || chunk), 12) AS id, event_id, chunk_index, (count(*) OVER (PARTITION BY seq))::INTEGER AS chunk_count, '[' || ts || '] ' || speaker || ': ' || chunk AS content, seq FROM chunks JOIN e USING (seq)""")
def memory_rows(spark, d):
    return ingest.memory_chunks(mem(spark, d)).select("id", "event_id", "chunk_index", "chunk_count", "content", "seq")


@query()
def hashed_embeddings(spark, d):
    return HashedStore(64).embed(table(spark, d, "conversations"), "text").select("conv_id", "turn", "embedding")


@query()
def conceptual_tags(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tags_udf()("text").alias("tags"))


@query()
def search_heads(spark, d):
    @F.udf("array<string>", useArrow=True)
    def run(text):
        return heads(text, DEFAULT_EXPANSIONS, {})

    return table(spark, d, "benchmark").select("item_id", run("text").alias("heads"))


@query()
def retrieved(spark, d):
    """For every benchmark text, what goes into its context out of all conversations."""
    s = HashedStore(64)
    q = s.embed(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", "query_embedding")
    q = q.withColumns({"query_embedding": F.col("query_embedding").cast("array<double>"), "blacklist": F.array().cast("array<string>")})
    return retrieval.retrieve(q, checkpointed(memory_table(spark, d)))


@query()
def injected_contexts(spark, d):
    return retrieval.render(retrieved(spark, d), F.lit("2024-06-01 12:00"))


@query()
def structural_clusters(spark, d):
    b = vectors_of(spark, d).withColumn("content", F.concat(F.element_at(F.array(*map(F.lit, ("Anna", "Boris", "Carla", "Dmitri"))), (F.col("seq") % 4 + 1).cast("int")), F.lit(" "), "content"))
    return clusters.subject_clusters(b)


@query()
def merged_statements(spark, d):
    """The statements of every other event merged into those of the rest, vectors included."""
    s = event_statements(spark, d).withColumns({"confidence": F.lit(0.7), "source": F.lit("events")})
    s = checkpointed(store.normalize(HashedStore(64).embed(s, "content")))  # read once a part of the statements
    return merge.merge(s.where("seq % 2 = 0"), s.where("seq % 2 = 1")).select("id", "content", "confidence", "verifications", "stability_index", "previous_content")


@query()
def compressed_sessions(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), (F.row_number().over(w) - 1).alias("pos"), "role", F.col("text").alias("content"))
    return compress.compress_sessions(c, lambda p: f"{len(p)} characters", 400, datetime(2024, 6, 1, 12), end=True)


@query()
def reviewed_beliefs(spark, d):
    """A review of all conversations by a stand-in model that names each batch's first excerpt."""

    def model(prompt: str) -> str:
        return '{"beliefs": [{"content": "Reviewed %d characters.", "term": "review", "source_indices": [1, 99]}]}' % len(prompt)

    formed, _ = consolidate.review(ingest.memory_chunks(mem(spark, d)), model)
    return formed.select("id", "content", "memory_refs", "term")


def _plain_lines(prompt: str) -> str:
    """A stand-in model that gives each line of a prompt's turns as a fact, in small letters and without digits."""
    turns = prompt.split("\n", 1)[1].removesuffix(consolidate.EXTRACT_FORM)
    return json.dumps({"facts": [re.sub("[0-9]", "", x.lower()).strip() for x in turns.split("\n")]})


@query("""WITH l AS (SELECT unnest(string_split(regexp_replace(text, '^ +| +$', '', 'g'), chr(10))) AS x FROM conversations WHERE trim(text) <> ''), c AS (SELECT trim(regexp_replace(lower(x), '[0-9]', '', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS content FROM l)
SELECT 'bel_' || left(sha256(content), 12) AS id, count(*)::DOUBLE AS verifications FROM c WHERE content <> '' GROUP BY content""")
def turns_added(spark, d):
    """All turns as facts: the same fact said again verifies the belief that is there."""
    turns = table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("session_id"), F.col("text").alias("content"))
    known, _ = knowledge.add_turns(knowledge.empty(spark), turns, _plain_lines, HashedStore(32), _now(), synthesis=False)
    return known.beliefs.select("id", "verifications")


@query()
def night_reviewed(spark, d):
    """The beliefs after a nightly review of all conversations by a stand-in model that names each batch's first two excerpts."""

    def model(prompt: str) -> str:
        return '{"beliefs": [{"content": "A batch of %d characters was read.", "term": "batch", "source_indices": [1, 2]}]}' % len(prompt)

    empty = knowledge.empty(spark)
    memory = store.normalize(ingest.memory_chunks(mem(spark, d)))
    known, _ = knowledge.nightly_review(replace(empty, beliefs=empty.beliefs.unionByName(memory)), model, HashedStore(32), _now())
    return known.beliefs.select("id", "category", "content", "layer", "reviewed_at", "memory_refs")


@query()
def discovered_clusters(spark, d):
    """Rollups of the dense groups of four subjects' documents."""
    b = vectors_of(spark, d).withColumn("content", F.concat(F.element_at(F.array(*map(F.lit, ("Anna", "Boris", "Carla", "Dmitri"))), (F.col("seq") % 4 + 1).cast("int")), F.lit(" "), "content"))
    known, _ = knowledge.discover_clusters(replace(knowledge.empty(spark), beliefs=b), lambda prompt: f"{len(prompt)} characters in common.", HashedStore(64))
    return knowledge.structural_clusters(known)


def statement_vectors(spark, d) -> DataFrame:
    """(id, embedding) of every event's statement, 384 wide."""
    return HashedStore(384).embed(event_statements(spark, d), "content").select("id", "embedding")


@query()
def nearest_statements(spark, d):
    """Ten nearest of all events' statements for every fiftieth event's."""
    v = checkpointed(statement_vectors(spark, d))
    return V.top_k_join(v.where("cast(substring(id, 7) as long) % 50 = 0").withColumnRenamed("id", "query_id"), v, 10)
