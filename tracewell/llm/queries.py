"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from rows of four of five folds."""
    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    found = identify(docs, train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by windows of 10 words of every benchmark item."""
    from .decontam import contamination

    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), n=10)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license of every document, with coverage, and how many stretches cover a template."""
    from .licenses import scan_documents

    found = scan_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "license", "coverage", "n_matches")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised, cut and packed into sequences of at most 1024 ids."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 4-word shingles of every document and the components of links at 4 bits or fewer."""
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, max_bits=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into archives in the shared folder, then read back from them."""
    from .warc import round_trip

    found = round_trip(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labelled rows of two of three folds."""
    from .langid import held_out
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    found = score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~out))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of at least 0.93 cosine between vectors of a label, for every vector, and their components."""
    from .vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.93)[0]


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier in the corpus."""
    from .suffixdedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"), least=100)


QUERIES = {
    "op1_langid": op1_langid,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_vectors": op9_vectors,
    "op10_suffix_dedup": op10_suffix_dedup,
}
