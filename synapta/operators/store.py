"""The belief table: reading and writing, derived columns, relations, decay.

The table is Parquet partitioned by category, so a category is read by pruning and
rewritten alone. Order of insertion is the column ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import BELIEF, CATEGORIES, DECAY_EXEMPT, Tunables


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BELIEF)


def conform(df: DataFrame) -> DataFrame:
    """All belief columns in order; those that are missing become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in BELIEF])


def write(beliefs: DataFrame, path: str) -> None:
    """Write by category; only the categories in ``beliefs`` are replaced."""
    conform(beliefs).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category").parquet(path)


def read(spark: SparkSession, path: str, *categories: str) -> DataFrame:
    """The whole table, or the given categories by partition pruning."""
    df = conform(spark.read.schema(BELIEF).parquet(path))
    return df.where(F.col("category").isin(*map(str, categories))) if categories else df


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """Import category files, one JSON array each, named by category; broken files give no rows."""
    raw = spark.read.schema(BELIEF).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.json$", 1)
    return raw.withColumn("category", name).where(F.col("category").isin(*CATEGORIES) & F.col("id").isNotNull()).withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))


def lookup(beliefs: DataFrame, belief_id: str) -> DataFrame:
    return beliefs.where(F.col("id") == belief_id).limit(1)


def normalize(beliefs: DataFrame, tagger=None) -> DataFrame:
    """Coerce, clamp and derive the computed columns. tagger: a function of the content's column that gives its tags."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.5))))
    distinct = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
    out = conform(beliefs).withColumns(
        {"category": X.canonical_category("category"), "confidence": unit("confidence"), "stability_index": unit("stability_index"), "verifications": F.coalesce("verifications", F.lit(1.0)), "relations": distinct("relations"), "memory_refs": distinct("memory_refs"), "tags": distinct("tags")}
    )
    if tagger is not None:
        out = out.withColumn("conceptual_tags", F.coalesce("conceptual_tags", tagger(X.strip_prefix("content"))))
    return out.withColumns({"weight": X.weight_tier("confidence"), "relevance": F.round(X.relevance("confidence", "stability_index", "relations"), 4)})


def insert_if_absent(beliefs: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows whose id isn't there; of rows that share an id the first counts."""
    w = Window.partitionBy("id").orderBy("seq")
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return beliefs.unionByName(first.join(beliefs.select("id"), "id", "left_anti").select(*beliefs.columns))


def upsert(beliefs: DataFrame, changed: DataFrame) -> DataFrame:
    """The latest row of each id."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return beliefs.unionByName(changed).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delete(beliefs: DataFrame, ids: DataFrame) -> DataFrame:
    return beliefs.join(ids.select("id"), "id", "left_anti")


def edges(beliefs: DataFrame) -> DataFrame:
    """(src, dst) of every relation."""
    return beliefs.select(F.col("id").alias("src"), F.explode(F.array_distinct("relations")).alias("dst"))


def related(beliefs: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, id, hop) of beliefs that a seed names or that name it, up to some hops away.

    Each hop is two equi-joins on the edges; a belief counts at the first hop that reaches it. Names without a
    belief are dropped.
    """
    e = edges(beliefs).join(beliefs.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    reached = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("hop", F.lit(0))
    found = reached
    for hop in range(1, hops + 1):
        reached = found.where(F.col("hop") == hop - 1).join(both, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id"), F.lit(hop).alias("hop")).distinct()
        found = found.unionByName(reached.join(found.select("seed", "id"), ["seed", "id"], "left_anti"))
    return found.where("hop > 0")


def inbound(beliefs: DataFrame) -> DataFrame:
    """(category, id, inbound): how often beliefs of the same category name each id."""
    return beliefs.select("category", F.explode("relations").alias("id")).groupBy("category", "id").agg(F.count("*").alias("inbound"))


def decayed(beliefs: DataFrame, now: Column, t: Tunables = Tunables()) -> DataFrame:
    """One step of decay: (all columns, old_confidence, new_confidence, pruned); exempt categories aren't in it."""
    live = beliefs.where(~F.col("category").isin(*DECAY_EXEMPT))
    b = live.join(inbound(live), ["category", "id"], "left")
    days = F.greatest(F.lit(0), F.coalesce(F.datediff(now, F.to_date("created_at")), F.lit(30))).cast("double")
    old = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    v = F.coalesce("verifications", F.lit(1.0))
    age = 0.40 * F.least(F.lit(1.0), F.log2(days + 1) / F.log2(F.lit(31.0)))
    names = 0.20 * F.least(F.lit(1.0), F.coalesce("inbound", F.lit(0)) / 5.0)
    proof = 0.20 * F.least(F.lit(1.0), v / 10.0)
    target = F.least(F.lit(1.0), (t.decay_base + age + names + proof) * (0.5 + F.coalesce("stability_index", F.lit(0.5))))
    new = F.least(F.lit(1.0), old + (target - old) * t.decay_rate)
    return b.withColumns({"old_confidence": old, "new_confidence": new, "pruned": new < t.prune_below, "verifications": F.when(v > 0, F.greatest(F.lit(0.0), v - 0.05)).otherwise(v)}).drop("inbound")


def decay(beliefs: DataFrame, now: Column, t: Tunables = Tunables()) -> DataFrame:
    """The table after one pass: exempt rows as they were, the others aged, weak ones pruned."""
    aged = decayed(beliefs, now, t).where(~F.col("pruned")).withColumn("confidence", F.round("new_confidence", 3))
    aged = aged.withColumns({"weight": X.weight_tier("confidence"), "relevance": F.round(X.relevance("confidence", "stability_index", "relations"), 4)})
    return beliefs.where(F.col("category").isin(*DECAY_EXEMPT)).unionByName(aged.select(*beliefs.columns))


def decay_stats(beliefs: DataFrame, now: Column, t: Tunables = Tunables()) -> DataFrame:
    """(pruned, demoted, promoted, updated) of one pass."""
    d = decayed(beliefs, now, t)
    was, is_ = X.weight_tier("old_confidence"), X.weight_tier("new_confidence")
    stays = ~F.col("pruned")
    return d.agg(
        F.count_if("pruned").alias("pruned"),
        F.count_if(stays & (was != "surface") & (is_ == "surface")).alias("demoted"),
        F.count_if(stays & (was == "surface") & (is_ != "surface")).alias("promoted"),
        F.count_if(stays).alias("updated"),
    )
