"""Registered corpus queries: name to callable, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pourstat.llm import decontaminate, langid, lm, mainpage, merkle, passages, pieces, quality, secrets, simhash, substrings, talk, toxicity
from pourstat.llm.common import documents, prepare


def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The piece table of the encoding query.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_pieces(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    return pieces.encode_texts(documents(spark, sf_dir), model).drop("decoded")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores_of_documents(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(documents(spark, sf_dir)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of_documents(documents(spark, sf_dir))


def op11_talk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return talk.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mainpage.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_passage_dedup,
        op2_quality_rules,
        op3_pieces,
        op4_simhash,
        op5_decontamination,
        op6_lm_score,
        op7_secret_scan,
        op8_suffix_dedup,
        op9_toxicity,
        op10_language_id,
        op11_talk_repair,
        op12_main_text,
        op13_merkle_manifest,
    )
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.oracle(),
    "op11_talk_repair": talk.oracle(),
    "op13_merkle_manifest": merkle.oracle(),
}
