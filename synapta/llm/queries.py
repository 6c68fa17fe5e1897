"""One query per operator of this subpackage, over whole tables, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..lineage import spread
from . import bitplanes, decontaminate, fingerprints, html_text, packing, quality, simhash_dedup, suffix_dedup, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of 64 weighted samples of every document."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds passages of."""
    return decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates, thousands of copies included."""
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, in the order of doc_id."""
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic, and the sentences that make it so."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability of being good."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compressed planes of token ids, in the order of doc_id."""
    return bitplanes.write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP1 = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
    SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50
), h AS (
    SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS bucket FROM g
), s AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, pos) = 1 AS kept,
           min(doc_id) OVER (PARTITION BY bucket) <> max(doc_id) OVER (PARTITION BY bucket) AS shared
    FROM h
), p AS (
    SELECT doc_id, pos, kept,
           CASE WHEN pos <= lag(pos) OVER d + 50 THEN 0 ELSE 1 END AS gap,
           max(CASE WHEN NOT kept THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later
    FROM s WHERE shared WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
    SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM p
)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word,
       CAST(sum(CASE WHEN kept THEN 0 ELSE least(50, coalesce(pos - later, 50)) END) AS INTEGER) AS n_removed
FROM r GROUP BY doc_id, run
"""

# words as the operator's normalisation makes them, then passages of 13 words or the whole of a shorter item
_OP4 = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS ws FROM benchmark
), bs AS (
    SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(0, greatest(len(ws) - 12, 1))) AS pos FROM b WHERE len(ws) > 0
), p AS (
    SELECT DISTINCT item_id, n, array_to_string(ws[pos + 1 : pos + n], ' ') AS passage FROM bs
), sizes AS (
    SELECT DISTINCT n FROM p
), ds AS (
    SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS pos FROM d, sizes WHERE len(ws) >= n
), g AS (
    SELECT doc_id, n, array_to_string(ws[pos + 1 : pos + n], ' ') AS passage FROM ds
)
SELECT doc_id, item_id, count(*) AS n_hits FROM g JOIN p USING (n, passage) GROUP BY doc_id, item_id
"""

ORACLES = {"op4_decontamination": _OP4, "op1_suffix_array_dedup": _OP1}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
