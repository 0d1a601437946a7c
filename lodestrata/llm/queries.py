"""The opN_ queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, html_text, langid, lm, mixing, neardup, toxicity, warc
from .common import table
from .sql import LEAKS_SQL, WARC_SQL, chat_sql


def op1_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), root)
    return warc.read_records(index, root, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_chats(chat.format_chats(rows)).drop("error")


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op7_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_factorization_machine": op1_factorization_machine,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_temperature_mix": op3_temperature_mix,
    "op4_warc_archive": op4_warc_archive,
    "op5_chat_format": op5_chat_format,
    "op6_cross_parsing": op6_cross_parsing,
    "op7_composite_text_density": op7_composite_text_density,
    "op8_weighted_minhash": op8_weighted_minhash,
    "op9_collision_counting": op9_collision_counting,
    "op10_context_mixing": op10_context_mixing,
}

#: The other queries have none: their models, samples and approximate searches are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op2_spaced_seeds": LEAKS_SQL,
    "op3_temperature_mix": mixing.mix_sql(),
    "op4_warc_archive": WARC_SQL,
    "op5_chat_format": chat_sql(),
}
