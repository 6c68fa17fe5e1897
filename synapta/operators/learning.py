"""What the engine learns beside beliefs: concepts, relations and clusters, as narrow append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DEFAULT_EXPANSIONS, FILLER, STOPWORDS, Tunables

ENTITY = r"^[A-Z][a-zA-Z]*(\s[A-Z][a-zA-Z]*){0,2}$"


def _first(df: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def learn_concepts(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Add (category, instance, seq) pairs that aren't known, in lower case; blanks are dropped."""
    new = seen.select(F.lower(F.trim("category")).alias("category"), F.lower(F.trim("instance")).alias("instance"), "seq")
    new = _first(new.where((X.slug("category") != "") & (F.col("instance") != "")), "category", "instance")
    return known.unionByName(new.join(known, ["category", "instance"], "left_anti").select(*known.columns))


def concept_expansions(known: DataFrame) -> DataFrame:
    """(category, instances) with instances in the order they were learned."""
    return known.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "instance"))), lambda x: x["instance"]).alias("instances"))


def learn_relations(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Add (subject, relation, entity, seq) with proper names only; names differing in case are one."""
    rows = seen.select(F.lower(F.trim("subject")).alias("subject"), F.lower(F.trim("relation")).alias("relation"), F.trim("entity").alias("entity"), "seq")
    rows = rows.where((F.col("subject") != "") & (F.col("relation") != "") & F.col("entity").rlike(ENTITY) & (F.lower("entity") != F.col("subject")))
    rows = _first(rows.withColumn("name", F.lower("entity")), "subject", "relation", "name")
    have = known.select("subject", "relation", F.lower("entity").alias("name"))
    return known.unionByName(rows.join(have, ["subject", "relation", "name"], "left_anti").select(*known.columns))


def relation_expansions(known: DataFrame) -> DataFrame:
    """(subject, relations) with a map of relation to entities in order."""
    per = known.groupBy("subject", "relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entity"))), lambda x: x["entity"]).alias("entities"))
    return per.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "entities")))).alias("relations"))


def tag_members(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Add (cluster_id, belief_id, seq) from (subject, category, belief_id, seq)."""
    new = _first(seen.where("subject <> '' and category <> '' and belief_id <> ''").select(X.cluster_id("subject", "category").alias("cluster_id"), "belief_id", "seq"), "cluster_id", "belief_id")
    return known.unionByName(new.join(known, ["cluster_id", "belief_id"], "left_anti").select(*known.columns))


def due_clusters(members: DataFrame, beliefs: DataFrame, consolidated: DataFrame, t: Tunables = Tunables()) -> DataFrame:
    """(cluster_id, n_members, tokens) of clusters that have grown enough for a rollup; members without a belief don't count."""
    sizes = members.join(beliefs.select(F.col("id").alias("belief_id"), X.token_count("content").alias("t")), "belief_id").groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.sum("t").alias("tokens"))
    due = sizes.where((F.col("n_members") >= t.cluster_size) | (F.col("tokens") >= t.cluster_fraction * t.cluster_reference))
    return due.join(consolidated.select("cluster_id"), "cluster_id", "left_anti")


def covered(candidates: DataFrame, existing: DataFrame, overlap: float = Tunables().cluster_overlap) -> DataFrame:
    """cluster_id of candidates, (cluster_id, member), of which one existing (rollup_id, member) cluster has the given share."""
    size = candidates.groupBy("cluster_id").agg(F.count_distinct("member").alias("n"))
    both = candidates.distinct().join(existing.distinct(), "member").groupBy("cluster_id", "rollup_id").agg(F.count("*").alias("k"))
    return both.join(size, "cluster_id").where(F.col("k") / F.col("n") >= overlap).select("cluster_id").distinct()


def lexicon(beliefs: DataFrame, t: Tunables = Tunables()) -> DataFrame:
    """(key, id, seq, words): each term and alias of a reviewed belief, and its belief's telling words."""
    b = beliefs.where((F.col("category") != "concepts") & (F.col("layer") == 2)).withColumn("term", F.lower(F.trim("term"))).where("term <> ''")
    words = F.regexp_extract_all(F.lower(X.strip_prefix("content")), F.lit("([a-z]{4,})"), 1)
    words = F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(sorted(STOPWORDS | FILLER)))), 1, t.lexicon_words)
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))), lambda a: a != "")
    keys = F.posexplode(F.array_distinct(F.concat(F.array("term"), aliases)))
    out = b.withColumn("words", F.array_distinct(F.concat(F.array("term"), words))).select("id", "seq", "words", keys.alias("key_no", "key"))
    return out.withColumn("words", F.array_remove("words", F.col("key")))


def lexicon_expansions(lex: DataFrame) -> DataFrame:
    """(category, instances) that the lexicon adds to the expansion map."""
    rows = lex.select(F.col("key").alias("category"), "seq", "key_no", F.posexplode("words").alias("pos", "instance"))
    first = rows.groupBy("category", "instance").agg(F.min(F.struct("seq", "key_no", "pos")).alias("at"))
    return first.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "instance"))), lambda x: x["instance"]).alias("instances"))


def merged_expansions(learned: dict[str, list[str]], from_lexicon: dict[str, list[str]], override: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Built-in, learned and lexicon vocabularies united in this order; an override replaces its key."""
    out = {k: list(v) for k, v in DEFAULT_EXPANSIONS.items()}
    for source in (learned, from_lexicon):
        for key, words in source.items():
            out[key] = list(dict.fromkeys(out.get(key, []) + list(words)))
    return out | {k: list(v) for k, v in (override or {}).items()}


def expansion_table(expansions: DataFrame, override: DataFrame) -> DataFrame:
    """The same on tables of (category, instance, source, seq): the union, but an override's keys replace all others."""
    kept = expansions.join(override.select("category").distinct(), "category", "left_anti").select("category", "instance")
    return kept.unionByName(override.select("category", "instance")).distinct()
