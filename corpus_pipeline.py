"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and BPE ids, each stage on what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's docs. All
but the last return the columns of documents; n_chars follows the text. The mix is the order of the fourth stage's files,
and of slot and offset in the last one's rows.

Defined results, in every stage: a null text is an empty text, and stays null where it isn't changed; a null id, source or
other column is a value like others; empty texts fail the quality rules and hold neither secrets nor ids; very long texts
are worked on whole; repeated rows get equal results, and near_duplicates keeps one of them; of documents equally good for
a class the one of the least id stays; an empty table gives an empty table of the same columns; extra columns are kept
up to the fourth stage, whatever their names, and dropped by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.llm import bpe, common, mixing, near_dedup, quality_rules, secret_scan
from caselake.llm.queries import TARGETS, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their source share."""
    return _counted(quality_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    words = tokenizer_path("word_bpe_49k.json")
    return _counted(secret_scan.redacted(docs, secret_scan.made_model(spark, words), words))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixing.in_order(docs, TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the mix's slot and offset, n_tokens, ids, and whether the ids decode to the text.

    The last stage gave all of its rows, so the mix has the same places for them again.
    """
    common.small_batches(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    placed = mixing.with_places(docs.select("doc_id", "source", "text"), TARGETS, "place")
    hashed = placed.select("doc_id", "source", "place.slot", "place.offset", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("given"))
    made = bpe.round_trip(hashed, path, keep=("doc_id", "source", "slot", "offset", "given"))
    return made.select("doc_id", "source", "slot", "offset", "n_tokens", "ids", (F.col("decoded_sha256") == F.col("given")).alias("exact"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("source_mix", mix), ("bpe_ids", token_ids)]

#: Signatures, the forest and merges are beyond SQL; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.passing(spark):  # a stage's own tables go when its result is written
            docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
