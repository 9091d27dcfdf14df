"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, jpeg, merkle, mixing, near_dedup, packed_ids, packing, quality_model, quality_rules, secret_scan, structure_repair, substring_dedup, warc
from .oracles import ORACLES as ORACLES

#: Shares of the mix, one for each source of the tables; null and unforeseen sources share `other`.
TARGETS = mixing.Targets({"src0": 12, "src1": 9, "src2": 7, "src3": 6, "src4": 5} | {f"src{k}": 4 for k in range(5, 20)}, other=1)


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary lies, on this machine and every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenizer_path("word_bpe_49k.json")
    return secret_scan.scan(common.table(spark, sf_dir, "documents"), secret_scan.made_model(spark, words), words)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    profiled = common.written(quality_rules.profiles(docs, "text", ["doc_id", "source"]), "op2-profiles")
    return quality_rules.judged(profiled, "doc_id", "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.with_features(jpeg.with_media(common.table(spark, sf_dir, "documents")))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return substring_dedup.factors(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixed(common.table(spark, sf_dir, "documents"), TARGETS)
    return made.select("doc_id", "source", "slot", "block", "offset")


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return packed_ids.round_trip(docs, common.shared_folder(spark, "op8-ids"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), path, with_ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"), common.shared_folder(spark, "op10-warc"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents are met with their capital letters in lower case."""
    capitals = "".join(map(chr, range(65, 91)))
    lowered = {"text": F.translate("text", capitals, capitals.lower())}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(common.table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), tampered=lowered, where=hit)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired(structure_repair.damaged(common.table(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_media_columns": op3_media_columns,
    "op4_quality_model": op4_quality_model,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_probminhash": op7_probminhash,
    "op8_packed_ids": op8_packed_ids,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_merkle": op11_merkle,
    "op12_structure_repair": op12_structure_repair,
    "op13_packing": op13_packing,
}
