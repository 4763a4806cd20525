"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import (
    chat,
    decontam,
    hardneg,
    jaccard,
    langid,
    mixing,
    packing,
    quality,
    shards,
    spelling,
    substrings,
    templates,
    url_rules,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_report(_read(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_report(_read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_read(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(spark, _read(spark, sf_dir, "conversations"))
    return chat.chat_report(chat.format_chats(turns))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.manifest(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_report(_read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_read(spark, sf_dir, "documents")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.negatives_report(_read(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary`` names a file of ranks; the public byte-level one of 50,000 tokens if not told otherwise.  It
    gives the ids of ``byte_bpe_50k.json``."""
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return packing.pack_report(_read(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_mix,
        op3_jaccard,
        op4_lines,
        op5_language,
        op6_chat,
        op7_urls,
        op8_shards,
        op9_quality,
        op10_substrings,
        op11_spelling,
        op12_negatives,
        op13_packing,
    )
}

SQL = {
    "op2_mix": mixing.SQL,
    "op7_urls": url_rules.SQL,
    "op8_shards": shards.SQL,
    "op9_quality": quality.SQL,
    "op11_spelling": spelling.SQL,
    "op12_negatives": hardneg.SQL,
}
