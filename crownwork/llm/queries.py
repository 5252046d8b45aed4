"""One query for each operator, over the whole of its table, and SQL for those that SQL expresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def vocabulary() -> str:
    """The path of the vocabulary that the queries use; operators take any."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as Huffman codes in order of doc_id and read back: doc_id, start, n_tokens, ids_crc32."""
    from .huffman import read_ids, write_ids

    return read_ids(spark, write_ids(table(spark, sf_dir, "documents"), vocabulary()), digest=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 ids."""
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out: doc_id, held_out, lang_pred, score."""
    from .langid import identified

    return identified(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, learned from the labelled ones: doc_id, expected_severity, severity, toxic_chance, toxic."""
    from .toxicity import fit, graded, severity_labels

    docs = table(spark, sf_dir, "documents")
    return graded(docs, fit(severity_labels(docs, table(spark, sf_dir, "labels"))))


#: The rules of op8's contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and short licenses in all documents: doc_id, license, line, dice."""
    from .licenses import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all documents that hold parts of benchmark items."""
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each query among all vectors: query_id, rank, vec_id, score."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of all pages: page_id, host, path, rule, verdict."""
    from .urls import judged

    return judged(table(spark, sf_dir, "pages"), URL_RULES)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of all documents by links of 0.9 over sets of three words: doc_id, n_shingles, component_id."""
    from .ngram_join import classed

    return classed(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes take from all documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    from .suffix_dedup import deduplicated

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) doc_id", "text")
    return deduplicated(docs, digest=True).selectExpr("kept.doc_id", "n_bytes", "n_removed", "n_spans", "left kept_sha256")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of all documents by fingerprints that differ in two bits at most: doc_id, fingerprint, component_id."""
    from .simhash import classed

    return classed(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors among all rows: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    from .hard_negatives import mined, shifted_labels

    return mined(shifted_labels(table(spark, sf_dir, "embeddings")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    from .conversations import damaged, repaired

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    every = rows.select(F.col("conv_id").alias("its")).distinct()
    found = repaired(damaged(rows), digest=True)
    joined = every.join(found, F.col("its").eqNullSafe(F.col("conv_id")), "left")
    none = hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("its").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit(none)).alias("repaired_sha256"))


def queries() -> dict:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_license_scan": op2_license_scan,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_toxicity": op5_toxicity,
        "op6_decontamination": op6_decontamination,
        "op7_nearest": op7_nearest,
        "op8_url_filter": op8_url_filter,
        "op9_ngram_join": op9_ngram_join,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_simhash": op11_simhash,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    from . import conversations, hard_negatives, licenses

    return {"op2_license_scan": licenses.oracle_sql(), "op12_hard_negatives": hard_negatives.oracle_sql(), "op13_conversation_repair": conversations.oracle_sql()}
