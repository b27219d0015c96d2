"""A corpus from documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontam, langid, packing, simhash, suffixdedup, toxicity
from tracewell.llm.common import col, scratch, table

TOXIC_SCORE = 0.7
SHINGLE, SIMILARITY = 5, 0.8
LEAST_REPEAT = 100
BENCHMARK_WORDS = 10
SEQUENCE, END_ID = 1024, 2


def _with_length(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars, where there is one, of the new text."""
    length = F.length("text").cast("bigint")
    return found.select(*[(length.alias(c) if c == "n_chars" else col(c)) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger scores below the threshold; it learns from the labels of two of three folds.

    Null and empty texts have the score of a text without words and stay; every row is judged by its own text, repeated rows alike; all columns stay; an empty table
    gives no rows, and without labels of both kinds all rows stay.
    """
    known = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(known, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~langid.held_out(F.col("doc_id"), 3, 1))
    return toxicity.reject(docs, model, TOXIC_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of SimHash near-duplicates, each verified by its shingles.

    Null, empty and wordless texts are one group; rows that share a doc_id stay or go together, rows without one stay; all columns stay; an empty table gives no rows.
    """
    dropped = simhash.similar_groups(docs.select("doc_id", "text"), SHINGLE, SIMILARITY).select("doc_id")
    return docs.alias("d").join(dropped.alias("x"), F.col("d.doc_id") == F.col("x.doc_id"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long strings that occur earlier; those that only repeat others go.

    Null and empty texts stay; rows that repeat a doc_id are one document; a null doc_id counts as the smallest; all columns stay, n_chars follows the text.
    """
    return _with_length(suffixdedup.cut_repeats(docs, LEAST_REPEAT), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages.

    Null and empty texts stay, a text of nothing but passages goes; every row is judged by its own text; all columns stay, n_chars follows the text.
    """
    cleaned = decontam.remove_spans(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), BENCHMARK_WORDS)
    return _with_length(cleaned, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Null and empty texts are one end-of-text id; repeated rows are packed each; other columns are left behind; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: No SQL for the stages that fit models or search; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None
