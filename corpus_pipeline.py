"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result to the shared scratch folder and reads it back as the next docs.

Every stage but the last returns the columns of its input, extra ones included,
whatever their names; it keeps null ids and repeated rows apart as stated, takes
very long texts whole, and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import near_dup, packing, personal, quality, substring
from wardspark.llm._shared import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and blank texts and those under 50 words among them; repeated rows are judged alike."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays.

    Rows without id, and texts without words, are nobody's copy and stay; rows
    that share an id stay or go together (a tie in the least id keeps all of
    them).
    """
    kept = near_dup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in their first document, the one of the least id that holds them; null and empty texts and rows without id stay as they are, and rows that share an id count as one document."""
    return substring.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; a null text stays null, and no row goes."""
    return personal.redact(docs, personal.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence; a null or empty text is one piece of the end token, and repeated rows are packed each by itself."""
    return packing.packed(packing.pieces_of(docs, packing.public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Chunk boundaries, the span classifier and packing have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
