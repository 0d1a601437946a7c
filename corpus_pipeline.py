"""A training corpus from raw documents: five stages, each an operator of lodestrata.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads back as the next stage's docs. All stages but the last return the columns of
documents; the last returns the drawings of the mix (doc_id, source, n_tokens, epoch, mix_key).

Defined cases: a null or empty text, or one without a letter, is in no language and goes at the second
stage; a text of a few words or of 100,000 is treated as any other; repeated rows and texts that are
alike leave one document, that with the smallest doc_id (a null doc_id is larger than any other; of rows
alike in id and text that which is smallest in all columns); null languages and sources are kept, a null
source is the source '' of the mix; other columns, whatever their names, are handed on untouched up to
the mix; an empty table gives no rows; without labels nothing is toxic, without benchmark items nothing
leaks, without languages no text is in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, langid, mixing, neardup, toxicity
from lodestrata.llm.common import done, staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the factorization machine calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in no learned language go."""
    return langid.drop_unknown(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near-duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def reject_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold benchmark items go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the kept documents, drawn by the tempered weights of their sources."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("language ID", reject_unknown_language),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", reject_benchmark_leaks),
    ("mixing sources to target weights", mix),
]

#: The first four stages cannot be written in SQL; the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{i}")
        done(before)
    return docs
