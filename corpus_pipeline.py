"""A training corpus from the table documents, in five stages: quality rules, language identification, line
deduplication, near-duplicates, packing. Each stage works on all that its predecessor kept.

Columns that documents has besides its own, whatever their names, pass through all stages but the last. Null and empty
texts fail the quality rules; rows without an id are linked with nothing; repeated rows are judged alike; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import checkpointed, fresh, quoted, table, written
from meritgraph.llm.language import classify, learn, least_scores
from meritgraph.llm.lines import deduplicate
from meritgraph.llm.neardup import BROADCAST_IDS, near_duplicates
from meritgraph.llm.packing import pack
from meritgraph.llm.quality import judge


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie within the thresholds of their language and source."""
    stats, verdict = (fresh(x, docs.columns) for x in ("stats", "quality"))
    return judge(docs, stats=stats, quality=verdict).where(F.col(verdict)["kept"]).select(*quoted(docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents themselves name: their cosine with its prototype is no less
    than the limit that the scores of that language's documents give."""
    prototypes = learn(docs)
    limits = least_scores(docs, prototypes)
    if not limits:
        return docs.limit(0)
    pred, score = (fresh(x, docs.columns) for x in ("lang_pred", "lang_score"))
    least = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col(pred)]
    return classify(docs, prototypes, docs.columns, pred, score).where((F.col(pred) != "und") & (F.col(score) >= least)).select(*quoted(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated lines; those of which nothing is left go."""
    lines, removed = (fresh(x, docs.columns) for x in ("n_lines", "n_removed"))
    left = deduplicate(docs, n_lines=lines, n_removed=removed).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, and all that have none. Repeated rows are one document."""
    gone_id, gone_text = (fresh(x, docs.columns) for x in ("gone_id", "gone_text"))
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text)).distinct()
    gone = checkpointed(gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_text)), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in length buckets and token-budget batches."""
    return pack(docs, ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing),
]

#: Prototypes, sketches and dynamic programming are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
