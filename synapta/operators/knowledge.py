"""Everything that the engine knows, as tables, and the passes that write to it: turns, reviews, clusters, the index.

A pass takes the tables and gives new ones with its counts; nothing is changed in place, so a pass that fails leaves what
was there. ``save`` and ``load`` keep them as Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import checkpointed
from ..schema import BELIEF, Tunables
from ..sources.vector_store import VectorStore
from . import clusters, consolidate, learning, merge, store
from .consolidate import Model

_TABLES = {
    "concepts": "category string, instance string, seq long",
    "relations": "subject string, relation string, entity string, seq long",
    "members": "cluster_id string, belief_id string, seq long",
    "consolidated": "cluster_id string",
    "structural": "rollup_id string, member string",
}


@dataclass(frozen=True)
class Knowledge:
    """Beliefs, what was learned beside them, clusters by tag with a mark on those rolled up, and clusters by density with their rollups."""

    beliefs: DataFrame
    concepts: DataFrame
    relations: DataFrame
    members: DataFrame
    consolidated: DataFrame
    structural: DataFrame


def empty(spark: SparkSession) -> Knowledge:
    return Knowledge(spark.createDataFrame([], BELIEF), **{k: spark.createDataFrame([], v) for k, v in _TABLES.items()})


def save(k: Knowledge, folder: str) -> None:
    store.write(k.beliefs, f"{folder}/beliefs")
    for name in _TABLES:
        getattr(k, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Knowledge:
    return Knowledge(store.read(spark, f"{folder}/beliefs"), **{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in _TABLES.items()})


# --- the index


def embedded(beliefs: DataFrame, vectors: VectorStore) -> DataFrame:
    """Beliefs with a vector of their content, without its date, where they had none; rows that have one aren't sent to the embedder."""
    missing = F.col("embedding").isNull() | (F.size("embedding") == 0)
    new = vectors.embed(beliefs.where(missing & (F.col("category") != "concepts")).drop("embedding").withColumn("__text", X.strip_prefix("content")), "__text")
    have = beliefs.where(~missing | (F.col("category") == "concepts"))
    return have.unionByName(new.select(*[F.col(c).cast(beliefs.schema[c].dataType) for c in beliefs.columns]))


def vocabulary(k: Knowledge, override: DataFrame | None = None, t: Tunables = Tunables()) -> DataFrame:
    """(trigger, term) of all that widens a query: built in, learned and of the lexicon; an override replaces its trigger."""
    spark = k.beliefs.sparkSession
    built_in = spark.createDataFrame([(c, w) for c, ws in learning.DEFAULT_EXPANSIONS.items() for w in ws], "category string, instance string")
    lexicon = learning.lexicon(k.beliefs, t).select(F.col("key").alias("category"), F.explode("words").alias("instance"))
    every = built_in.unionByName(k.concepts.select("category", "instance")).unionByName(lexicon)
    every = learning.expansion_table(every, override) if override is not None else every.distinct()
    return every.select(F.col("category").alias("trigger"), F.lower("instance").alias("term")).distinct()


def sync(k: Knowledge, vectors: VectorStore, override: DataFrame | None = None, t: Tunables = Tunables()) -> tuple[Knowledge, DataFrame]:
    """(knowledge with all vectors, vocabulary): what retrieval needs to be up to date."""
    k = replace(k, beliefs=checkpointed(embedded(k.beliefs, vectors)))
    return k, vocabulary(k, override, t)


class Index:
    """What ``sync`` gives, kept until the version of the tables changes."""

    def __init__(self, vectors: VectorStore, t: Tunables = Tunables()):
        self.vectors, self.t = vectors, t
        self.version, self.synced = None, None

    def get(self, k: Knowledge, version) -> tuple[Knowledge, DataFrame]:
        if self.synced is None or version is None or version != self.version:
            self.synced, self.version = sync(k, self.vectors, None, self.t), version
        return self.synced


# --- accessors


def cluster_members(k: Knowledge, subject: str, category: str) -> DataFrame:
    """belief_id of a cluster's members, in the order in which they came."""
    return k.members.where(F.col("cluster_id") == X.cluster_id(F.lit(subject), F.lit(category))).orderBy("seq").select("belief_id")


def is_consolidated(k: Knowledge, subject: str, category: str) -> bool:
    return not k.consolidated.where(F.col("cluster_id") == X.cluster_id(F.lit(subject), F.lit(category))).isEmpty()


def mark_consolidated(k: Knowledge, cluster_ids: DataFrame) -> Knowledge:
    """With a mark on the given clusters; those that aren't known get none."""
    known = cluster_ids.select("cluster_id").distinct().join(k.members.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return replace(k, consolidated=k.consolidated.unionByName(known.join(k.consolidated, "cluster_id", "left_anti")))


def record_structural(k: Knowledge, members: DataFrame) -> Knowledge:
    """With the members, (rollup_id, member), of clusters that were rolled up."""
    return replace(k, structural=k.structural.unionByName(members.select("rollup_id", "member").distinct().join(k.structural.select("rollup_id").distinct(), "rollup_id", "left_anti")))


def structural_clusters(k: Knowledge) -> DataFrame:
    """(rollup_id, members) of every cluster that was recorded."""
    return k.structural.groupBy("rollup_id").agg(F.array_sort(F.collect_set("member")).alias("members"))


# --- passes


def _numbered(rows: DataFrame, beliefs: DataFrame, *order: str) -> DataFrame:
    """Rows with a seq after all that is stored, in the given order."""
    last = beliefs.agg(F.max("seq")).first()[0] or 0
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.lit(last + 1) + F.monotonically_increasing_id()))


def _learn(k: Knowledge, found: DataFrame) -> tuple[Knowledge, DataFrame]:
    """With the concepts, relations and cluster members of facts (category, instance, subject, relation, entities, belief_id, seq); and the clusters touched."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    concepts = learning.learn_concepts(k.concepts, found.where(some("category") & some("instance")))
    named = found.where(some("subject") & some("relation")).select("subject", "relation", F.posexplode("entities").alias("pos", "entity"), "seq")
    relations = learning.learn_relations(k.relations, named.withColumn("seq", F.col("seq") * 100 + F.col("pos")))
    tagged = found.where(some("category") & some("subject"))
    members = learning.tag_members(k.members, tagged)
    touched = tagged.select(X.cluster_id("subject", "category").alias("cluster_id")).distinct()
    return replace(k, concepts=checkpointed(concepts), relations=checkpointed(relations), members=checkpointed(members)), touched


def _roll_up(k: Knowledge, touched: DataFrame, model: Model, t: Tunables) -> Knowledge:
    """With a rollup of every touched cluster that has grown enough and has none; a failed call leaves the cluster for the next time."""
    due = learning.due_clusters(k.members.join(touched, "cluster_id", "left_semi"), k.beliefs, k.consolidated, t).select("cluster_id")
    groups = k.members.join(due, "cluster_id", "left_semi").select(F.col("cluster_id").alias("key"), F.col("belief_id").alias("id"))
    made = checkpointed(consolidate.rollups(groups, k.beliefs, model, "bel_rollup_", "cluster_consolidation"))
    k = _insert(k, made)
    return mark_consolidated(k, made.select(F.col("key").alias("cluster_id")))


def _insert(k: Knowledge, rows: DataFrame) -> Knowledge:
    new = store.normalize(_numbered(rows, k.beliefs, "id"))
    return replace(k, beliefs=checkpointed(store.insert_if_absent(k.beliefs, new)))


def _merge(k: Knowledge, statements: DataFrame, vectors: VectorStore, now: Column, t: Tunables) -> Knowledge:
    new = store.normalize(statements.withColumns({"category": F.lit("premises"), "created_at": now}))
    return replace(k, beliefs=checkpointed(merge.merge(k.beliefs, checkpointed(embedded(new, vectors)), t)))


def add_turns(k: Knowledge, turns: DataFrame, model: Model, vectors: VectorStore, now: Column, t: Tunables = Tunables(), synthesis: bool = True) -> tuple[Knowledge, dict]:
    """(knowledge, counts) after conversation turns (session_id, content): facts are extracted, merged and learned from, clusters rolled up, facts synthesised."""
    found = checkpointed(consolidate.extract(turns, model, t))
    facts = _numbered(found, k.beliefs, "session_id", "date", "batch", "pos")
    k = _merge(k, facts.select("id", "content", "confidence", "source", "session_id", "seq"), vectors, now, t)
    k, touched = _learn(k, facts.withColumn("belief_id", F.col("id")))
    k = _roll_up(k, checkpointed(touched), model, t)
    made = checkpointed(consolidate.synthesise(found, model)) if synthesis else None
    if made is not None:
        k = _insert(k, made.select("id", "category", "content", "confidence", "source", "relations"))
    return k, {"facts": facts.count(), "synthesised": made.count() if made is not None else 0}


def nightly_review(k: Knowledge, model: Model, vectors: VectorStore, now: Column, t: Tunables = Tunables()) -> tuple[Knowledge, dict]:
    """(knowledge, counts) after a review of all memory that none has seen: beliefs are merged and learned from, chunks marked."""
    memory = k.beliefs.where("category = 'memory'")
    every = checkpointed(consolidate.reviewed_batches(memory, model, t))
    asked = every.where("status <> 'failed'")
    formed = _numbered(consolidate.formed_beliefs(asked), k.beliefs, "batch", "pos")
    done = asked.select(F.explode("rows.id").alias("id"))
    stamped = consolidate.stamp(memory, done, now)
    k = replace(k, beliefs=checkpointed(k.beliefs.where("category <> 'memory'").unionByName(stamped)))
    k = _merge(k, formed.select("id", "content", "confidence", "source", "layer", "term", "aliases", "memory_refs", "seq"), vectors, now, t)
    k, touched = _learn(k, formed.withColumn("belief_id", F.col("id")))
    k = _roll_up(k, checkpointed(touched), model, t)
    totals = every.agg(
        F.sum(F.size("rows")).alias("pending"), F.sum(F.when(F.col("status") != "failed", F.size("rows"))).alias("reviewed"), F.count_if(F.col("status") != "failed").alias("batches"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    ).first()
    return k, {**{n: v or 0 for n, v in totals.asDict().items()}, "formed": formed.count()}


def discover_clusters(k: Knowledge, model: Model, vectors: VectorStore, t: Tunables = Tunables()) -> tuple[Knowledge, dict]:
    """(knowledge, counts) after dense groups of each subject's beliefs that no recorded cluster covers were rolled up and recorded; originals stay."""
    k = replace(k, beliefs=checkpointed(embedded(k.beliefs, vectors)))
    found = checkpointed(clusters.subject_clusters(k.beliefs, t))
    groups = found.groupBy("subject", "cluster").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    name = F.sha2(F.concat(F.lit("structrollup:"), "subject", F.lit(":"), F.array_join("ids", ",")), 256)
    named = groups.select(name.alias("cluster_id"), F.explode("ids").alias("member"))
    new = checkpointed(named.join(learning.covered(named.select("cluster_id", "member"), k.structural, t.cluster_overlap), "cluster_id", "left_anti"))
    made = checkpointed(consolidate.rollups(new.select(F.col("cluster_id").alias("key"), F.col("member").alias("id")), k.beliefs, model, "bel_structrollup_", "structural_cluster_discovery"))
    k = _insert(k, made)
    k = record_structural(k, made.select(F.col("id").alias("rollup_id"), F.explode("relations").alias("member")))
    subjects = clusters.eligible(k.beliefs).select(F.count_distinct("subject")).first()[0]
    return k, {"subjects_scanned": subjects, "clusters_found": found.select("subject", "cluster").distinct().count(), "rollups_created": made.count()}
