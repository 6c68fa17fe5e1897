"""The belief table: columns, categories and tunables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CATEGORIES = ("premises", "propositions", "preferences", "people", "skills", "desires", "concepts", "memory")
SINGULAR = {
    "concept": "concepts",
    "desire": "desires",
    "memories": "memory",
    "person": "people",
    "preference": "preferences",
    "premise": "premises",
    "proposition": "propositions",
    "skill": "skills",
}
DECAY_EXEMPT = ("memory",)

BELIEF = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("stability_index", T.DoubleType()),
        T.StructField("verifications", T.DoubleType()),
        T.StructField("relations", T.ArrayType(T.StringType())),
        T.StructField("memory_refs", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("conceptual_tags", T.ArrayType(T.StringType())),
        T.StructField("weight", T.StringType()),
        T.StructField("relevance", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_accessed", T.TimestampType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("previous_content", T.StringType()),
        T.StructField("layer", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("event_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("reviewed_at", T.TimestampType()),
        T.StructField("extra", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Tunables:
    """Defaults of the engine; override what a job needs."""

    prune_below: float = 0.20
    decay_base: float = 0.20
    decay_rate: float = 0.30
    merge_similarity: float = 0.80
    rewording_similarity: float = 0.90
    duplicate_similarity: float = 0.90
    duplicate_margin: float = 0.01
    expanded_weight: float = 0.3
    max_keywords: int = 4
    max_heads: int = 16
    max_concept_heads: int = 8
    max_relation_heads: int = 6
    max_lexicon: int = 5
    lexicon_words: int = 8
    reserve: float = 0.20
    anchors: int = 3
    turn_window: int = 1
    top_turn_window: int = 2
    blacklist_size: int = 15
    context_limit: int = 8192
    budget_fraction: float = 0.15
    budget_means: float = 15.0
    max_injected_tokens: float | None = None
    chunk_tokens: int = 100
    chunk_overshoot: float = 1.5
    extraction_tokens: int = 1500
    review_tokens: int = 3000
    cluster_size: int = 10
    cluster_fraction: float = 0.25
    cluster_reference: int = 800
    min_cluster_size: int = 5
    cluster_overlap: float = 0.7

    @property
    def ceiling(self) -> float:
        """The most tokens that a context may have."""
        return float(self.max_injected_tokens) if self.max_injected_tokens else self.context_limit * self.budget_fraction


#: Words that say little in a query.
STOPWORDS = frozenset(
    "about above after again against along and another are around been before behind being below beneath beside between beyond could did do does during first for from had has have here is other second shall should since that the their then there these third this those through under until was were what when where which while whose will with within without would you your".split()
)
QUESTION_WORDS = frozenset("how what when where which who whom whose why".split())
FILLER = frozenset("any both done had have item items kind kinds many much some sort sorts stuff thing things type types way ways".split())
#: Capitalised at the start of sentences, and no value of a statement.
NOT_SALIENT = frozenset("a also an assistant he her his i if it model my our remember she that the their then there these they this those user we when you".split())

_EXPANSIONS = """
achievement=finished|completed|accomplished|won|succeeded|milestone|proud
accomplishment=finished|completed|accomplished|won|succeeded|milestone
relationship status=single|married|dating|divorced|engaged|widowed|partner|boyfriend|girlfriend|husband|wife
interest=hobby|enjoys|passionate|likes|loves
hobby=enjoys|passionate about|likes|spends time
occupation=works as|job|career|profession|employed
career path=works as|job|profession|wants to become|studying
volunteering=volunteers|shelter|charity|donates|helps out
health=sick|diagnosed|illness|recovering|therapy|doctor
feeling=happy|sad|excited|anxious|proud|stressed|grateful
mood=happy|sad|excited|anxious|stressed
conflict=argument|disagreement|fight|struggle|tension
plan=going to|intends to|upcoming|planning to
living situation=lives|moved|apartment|house|roommate
education=studies|degree|school|college|university|enrolled
"""
DEFAULT_EXPANSIONS: dict[str, list[str]] = {k: v.split("|") for k, v in (line.split("=") for line in _EXPANSIONS.split("\n") if line)}
